"""Toxicity from a learned lexicon, matched through Levenshtein automata, weighed by context.

Terms and stems that mark toxic rows are learned from labelled rows. The
lexicon is a trie; the automaton that accepts every string within some edits of
a term is intersected with it and made deterministic as words ask for it, so a
word costs a dictionary lookup a character and most words die early. Every term
may be misspelt: short ones by one other letter, middle ones by one edit, long
ones by two. Hits are weighed by term, by distance and by their window:
quotation marks around a hit and other hits near it. Misspellings that may well
be another word have numbers of their own. A logistic model over these turns them into a score.
"""

from __future__ import annotations

import bisect
import dataclasses
import functools
import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborflow.llm.common import crc_mod, map_columns, materialize
from arborflow.llm.quality import labelled_sample, one_of_each

#: Labelled rows used for fitting at most, those of least hash.
FIT_ROWS = 30_000
#: Terms and stems kept at most, the most telling first.
TERMS = 4_000
#: Terms of fewer than EDIT_LETTERS letters may have one letter replaced, terms of LONG_LETTERS or more two edits, the others one.
EDIT_LETTERS, LONG_LETTERS = 5, 10
STEMS = (3, 4, 5, 6, 7, 8)
#: Share of the lexicon that may be chance.
CHANCE = 0.1
WINDOW = 8
THRESHOLD = 0.7
WORD = re.compile(r"[\w@$*]+")
#: Letters of scripts written without blanks (South-East Asian, kana, Han): their runs are read as overlapping pairs and triples.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
#: Quotations, by pairs of marks within a line; an apostrophe between letters is none. What stands in them is reported speech and teaches no terms.
QUOTED = re.compile("|".join([*(f"{a}[^{a}{b}\n]{{1,200}}{b}" for a, b in ('""', "“”", "„“", "„”", "«»", "»«", "‹›")), r"(?<!\w)['‘](?:[^'‘’\n]|(?<=\w)['’](?=\w)){1,200}['’](?!\w)"]))
SHINGLE = 5
MEMORY = 300_000
#: Trie nodes that an automaton's states may hold.
NODES = 500_000


class LevenshteinTrie:
    """Trie of terms, and its intersection with the automata of `edits` edits (or replaced letters only), determinised on demand.

    A state is a set of (trie node, edits so far), held by number. Node 0 is the
    root; ends[node] is the term that ends there.
    """

    def __init__(self, terms: list[str], edits: int = 1, replace_only: bool = False):
        self.edits, self.replace_only, self.children, self.ends = edits, replace_only, [{}], [None]
        for term in terms:
            node = 0
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = nxt
            self.ends[node] = term
        self.alphabet = {c for kids in self.children for c in kids}
        self.reset()

    def reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.moves: list[dict[str, int]] = []
        self.held = 0
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of the closure of nodes under skipped term letters; -1 if empty."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if e < self.edits and not self.replace_only:
                for kid in self.children[node].values():
                    if nodes.get(kid, self.edits + 1) > e + 1:
                        nodes[kid] = e + 1
                        todo.append((kid, e + 1))
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(nodes)
            self.held += len(nodes)
            self.moves.append({})
            found = [(e, self.ends[n]) for n, e in nodes.items() if self.ends[n] is not None]
            self.accepts.append((lambda b: (b[1], b[0]))(min(found)) if found else None)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.sets[state].items():
            kid = self.children[node].get(c)
            if kid is not None:
                after[kid] = min(e, after.get(kid, e))
            if e < self.edits:
                for other in (*self.children[node].values(), *(() if self.replace_only else (node,))):
                    after[other] = min(e + 1, after.get(other, e + 1))
        to = self.moves[state][c] = self._state(after)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within reach, ties to the first in order of letters."""
        if self.held > NODES:
            self.reset()
        state, moves, alphabet = self.start, self.moves, self.alphabet
        for c in word:
            if c not in alphabet:
                c = "\0"
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = self._move(state, c)
            if nxt < 0:
                return None
            state = nxt
        return self.accepts[state]


@dataclasses.dataclass
class Lexicon:
    terms: dict[str, float]  # term -> weight
    stems: dict[str, float]

    def __post_init__(self):
        self.automata: list[LevenshteinTrie] | None = None
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}

    def __getstate__(self):
        return self.terms, self.stems

    def __setstate__(self, x):
        self.terms, self.stems = x
        self.__post_init__()

    def misspelt(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term that the word may be, ties to the longest. Terms of one or two letters and pieces of unspaced scripts have no misspellings."""
        if self.automata is None:
            size = lambda least, stop: [t for t in self.terms if least <= len(t) < stop and not UNSPACED.match(t)]
            self.automata = [LevenshteinTrie(size(LONG_LETTERS, 1 << 30), 2), LevenshteinTrie(size(EDIT_LETTERS, LONG_LETTERS)), LevenshteinTrie(size(3, EDIT_LETTERS), replace_only=True)]
        found = [x for a in self.automata if (x := a.match(word))]
        return min(found, key=lambda x: x[1], default=None)

    def look(self, word: str) -> tuple[float, int] | None:
        """(weight, kind) of a word: kind 0 a term, 1 a stem, 2 misspelt, 3 misspelt so that it may be another word."""
        if (w := self.terms.get(word)) is not None:
            return w, 0
        stem = max((self.stems[word[:k]] for k in STEMS if word[:k] in self.stems), default=None)
        if stem is not None:
            return stem, 1
        near = self.misspelt(word)
        if not near:
            return None
        term, edits = near
        sure = term.isalpha() and not word.isalpha() or edits == 1 and min(len(term), len(word)) >= EDIT_LETTERS
        return self.terms[term], 2 if sure else 3

    def find(self, words: list[str]) -> dict[str, tuple[float, int]]:
        distinct = set(words)
        for w in distinct - self.clean:
            if w not in self.hits:
                if (x := self.look(w)) is None:
                    self.clean.add(w)
                else:
                    self.hits[w] = x
        found = {w: self.hits[w] for w in distinct if w in self.hits}
        if len(self.clean) > MEMORY:
            self.clean.clear()
            self.hits.clear()
        return found


def words_of(low: str) -> list[tuple[str, int, int]]:
    """(word, start, stop) in order of start; a run of an unspaced script gives its overlapping pairs and triples, or itself if it is one letter."""
    out = []
    for m in WORD.finditer(low):
        at, word = m.start(), m.group()
        if word.isascii() or not UNSPACED.search(word):
            out.append((word, at, m.end()))
            continue
        done = 0
        for run in UNSPACED.finditer(word):
            if done < run.start():
                out.append((word[done : run.start()], at + done, at + run.start()))
            i, done = run.span()
            out.extend((word[k : k + n], at + k, at + k + n) for k in range(i, done) for n in (2, 3) if k + n <= done)
            if done == i + 1:
                out.append((word[i], at + i, at + done))
        if done < len(word):
            out.append((word[done:], at + done, m.end()))
    return out


def context(text: str | None, lexicon: Lexicon) -> list[float]:
    """Numbers about the hits of a text, all zero without hits."""
    low = (text or "").lower()
    spans = words_of(low)
    words = [w for w, _, _ in spans]
    found = lexicon.find(words)
    if not found:
        return [0.0] * 12
    doubtful = {w: x[0] for w, x in found.items() if x[1] == 3}
    weak = [max(doubtful.values(), default=0.0), math.log1p(len(doubtful))]
    found = {w: x for w, x in found.items() if w not in doubtful}
    if not found:
        return [0.0] * 10 + weak
    at = [(i, span, *found[span[0]]) for i, span in enumerate(spans) if span[0] in found]
    place = [a[0] for a in at]
    quotes = [m.span() for m in QUOTED.finditer(low)]
    opened = [q[0] for q in quotes]
    quoted = sum((k := bisect.bisect_right(opened, start)) > 0 and stop <= quotes[k - 1][1] for _, (_, start, stop), _, _ in at)
    near = max(sum(abs(p - q) <= WINDOW for q in place[max(0, k - WINDOW) : k + WINDOW + 1]) - 1 for k, p in enumerate(place))
    kinds = [{word for _, (word, _, _), _, kind in at if kind == k} for k in range(3)]
    best = [max((w for _, _, w, kind in at if kind == k), default=0.0) for k in range(3)]
    return [best[0], best[1], best[2], *(math.log1p(len(k)) for k in kinds), math.log1p(len(at)), quoted / len(at), math.log1p(near), math.log(len(at) / len(words)), *weak]


@dataclasses.dataclass
class ToxicityModel:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = (np.array([context(t, self.lexicon) for t in texts]) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _sketch(words: list[str]) -> int:
    """Least hash of SHINGLE words in a row, which near copies mostly share."""
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - SHINGLE + 1))) - (1 << 63)


def _terms(ids, labels, texts):
    """Distinct words outside quotations, and stems marked by a trailing blank; with the sketch of all words."""
    sketches, out = [], []
    for t in texts:
        low = (t or "").lower()
        sketches.append(_sketch(WORD.findall(low)))
        words = {w for w, _, _ in words_of(QUOTED.sub(" ", low))}
        out.append([*words, *{w[:k] + " " for w in words for k in STEMS if len(w) >= k}])
    return ids, labels, sketches, out


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms whose smoothed log-odds of toxic rows, less two standard errors, exceed 1.5, and whose toxic rows chance does not explain.

    Of rows with one sketch and label, near copies, only the first by id teaches, so
    that a copied text is no evidence of its words. Chernoff's bound on the chance
    that a term of n rows has t toxic ones is held, by Benjamini and Hochberg, to the
    number of candidates, so that at most CHANCE of the terms are expected to be
    chance. sample: doc_id, __label, text.
    """
    rows = map_columns(sample, ["doc_id", "__label", "text"], lambda: _terms, "id long, y int, sketch long, words array<string>")
    first = rows.groupBy("sketch", "y").agg(F.min_by("words", "id").alias("words"))
    first = materialize(first, "teaching-rows")
    counts = first.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    toxic, rest = int(counts.t or 0), int(counts.n - (counts.t or 0))
    if not toxic or not rest:
        return Lexicon({}, {})
    terms = materialize(first.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("t"), F.count("*").alias("n")), "terms")
    many = terms.count()
    t, o = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(t / (toxic + 1)) - F.log(o / (rest + 1))
    share, p = F.col("t") / F.col("n"), toxic / (toxic + rest)
    chance = F.col("t") * F.log(share / p) + F.when(share < 1, (F.col("n") - F.col("t")) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    rows = (
        terms.where((F.col("t") > 0) & (share > p))
        .select("w", odds.alias("odds"), (odds - 2 * F.sqrt(1 / t + 1 / o)).alias("sure"), chance.alias("chance"))
        .where("sure > 1.5").orderBy(F.desc("chance"), "w").limit(TERMS).collect()
    )
    rows = rows[: max((k for k, r in enumerate(rows, 1) if r.chance >= math.log(many / (CHANCE * k))), default=0)]
    terms = {r.w: r.odds for r in rows if not r.w.endswith(" ")}
    stems = {r.w[:-1]: r.odds for r in rows if r.w.endswith(" ")}
    return Lexicon(terms, stems)


def _features(lexicon: Lexicon):
    return lambda ids, label, texts: (ids, label, [context(t, lexicon) for t in texts])


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel | None:
    """Lexicon from two thirds of the training rows, weights from the rest, so that chance terms get no trust.

    Rows with crc32(doc_id) mod 3 = 1 are held out. None without both labels.
    """
    sample = materialize(labelled_sample(docs, labels, "toxic", rows, 3, 1), "toxicity-sample").withColumn("__third", F.pmod(F.xxhash64(F.col("text"), F.lit(3)), F.lit(3)) == 0)
    lexicon = learn_lexicon(sample.where(~F.col("__third")))
    got = one_of_each(map_columns(sample.where("__third"), ["doc_id", "__label", "text"], functools.partial(_features, lexicon), "id long, y int, x array<double>"))
    y = np.array([r[1] for r in got], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([r[0] for r in got])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 0.3)
    ridge[-1] = 1e-6
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
    return ToxicityModel(lexicon, mean, scale, w)


def _scores(model: ToxicityModel | None):
    def fn(ids, held, texts):
        s = model.score(texts) if model else np.zeros(len(ids))
        return ids, held, s.tolist(), (s >= THRESHOLD).astype(int).tolist()

    return fn


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts score like texts without hits; without labels of both
    kinds every score is 0. Repeated rows give repeated results; ids may be null.
    """
    model = fit_toxicity(docs, labels, rows)
    held = (crc_mod("doc_id", 3) == 1).alias("held_out")
    return map_columns(docs, ["doc_id", held, "text"], functools.partial(_scores, model), "doc_id long, held_out boolean, score double, predicted int")
