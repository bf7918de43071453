"""Language of every word by a linear-chain conditional random field, and of texts by its marginals.

A word's features are its affixes, the n-grams of its letters and, if the
learned lexicon has it, itself; each is a row of weights by language. Learned
transitions link neighbouring words. Forward-backward gives each word's
posterior, so code-switched text is labelled word by word; a text's language is
the one with the most expected words and its score that share. Scripts without
blanks have long runs of letters; such a run is cut into several words, so that
all of it is read and it counts by its length.
"""

from __future__ import annotations

import dataclasses
import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborflow.llm.common import crc_mod, map_columns, materialize

#: Rows used for fitting, shared evenly by the languages, those of least hash of each; LANGUAGE_ROWS is the least share.
FIT_ROWS, LANGUAGE_ROWS = 1_200, 100
#: Words used for fitting at most: in all, shared evenly by the languages and then by the texts of each, and of a text.
FIT_WORDS, TEXT_WORDS = 500_000, 5_000
#: Weight rows; features share them by hash.
BUCKETS = 1 << 16
LEXICON = 20_000
SPAN = (6, 40)
STEPS = 25
#: Words that form one step of the blocked recursions.
BLOCK = 64
#: Numbers in the expected transitions held at once in fitting.
CELLS = 1 << 23
MEMORY = 250_000
#: Longer runs of letters, as in scripts without blanks, are consecutive words of this many letters.
LETTERS = 40
WORD = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case, long ones in pieces of at most LETTERS; none if the text has no letter."""
    words = WORD.findall((text or "").lower())
    return words if any(any(map(str.isalpha, w)) for w in words) else []


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every feature of the words: affixes of one to four letters, pairs and triples of letters with the word's ends, and the word if the lexicon has it."""
    length = np.array([len(w) + 2 for w in words], np.int64)
    code = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    stop = np.cumsum(length)
    start, of = stop - length, np.repeat(np.arange(len(words)), length)
    index, bucket = [], []

    def add(owner: np.ndarray, hashed: np.ndarray, kind: int) -> None:
        index.append(owner)
        bucket.append(_mix(hashed, kind))

    prime = np.uint64(1_000_003)
    gram, size = code, len(code)
    for k in (2, 3):
        gram = gram[: size - k + 1] * prime + code[k - 1 :]
        same = of[: size - k + 1] == of[k - 1 :]
        add(of[: size - k + 1][same], gram[same], k)
    for side in (0, 1):
        hashed, owner = np.zeros(len(words), np.uint64), np.arange(len(words))
        for k in range(1, 5):
            has = length[owner] - 2 >= k
            owner = owner[has]
            hashed = hashed[has] * prime + code[start[owner] + k if side == 0 else stop[owner] - 1 - k]
            add(owner, hashed, 10 + 4 * side + k)
    listed = [i for i, w in enumerate(words) if w in lexicon]
    add(np.array(listed, np.int64), np.array([zlib.crc32(words[i].encode("utf-8", "surrogatepass")) for i in listed], np.uint64), 30)
    return np.concatenate(index), np.concatenate(bucket)


def _emission_scores(index: np.ndarray, bucket: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """exp of the words' summed weights, each row scaled by its largest."""
    scores = np.stack([np.bincount(index, weights[:, k][bucket], minlength=n) for k in range(weights.shape[1])], axis=1)
    return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """Posteriors of each word, for sequences laid end to end; with pairs, also the expected counts of transitions.

    emission: words x labels, positive. The recursions run over blocks of BLOCK
    words of all sequences at once: block products first, then the states at
    block borders, then the inside of all blocks together, so the number of
    steps doesn't grow with the length of a text.
    """
    labels = transition.shape[0]
    blocks = np.maximum(1, -(-lengths // BLOCK))
    n, first = int(blocks.sum()), np.concatenate([[0], np.cumsum(blocks)[:-1]])
    owner = np.repeat(np.arange(len(lengths)), blocks)
    inner = np.arange(n) - first[owner]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[owner] + inner * BLOCK
    size = np.clip(lengths[owner] - inner * BLOCK, 0, BLOCK)
    steps = int(size.max(initial=0))
    at = np.minimum(starts[:, None] + np.arange(steps), max(len(emission) - 1, 0))
    live = np.arange(steps) < size[:, None]
    e = emission[at]
    product = np.broadcast_to(np.eye(labels), (n, labels, labels)).copy()
    for s in range(steps):
        new = (product.reshape(-1, labels) @ transition).reshape(n, labels, labels) * e[:, s, None, :]
        new /= new.sum(axis=(1, 2), keepdims=True)
        product = np.where(live[:, s, None, None], new, product)
    enter = np.full((n, labels), 1.0 / labels)
    leave = np.full((n, labels), 1.0)
    last = int(blocks.max(initial=0))
    for k in range(1, last):
        b = first[blocks > k] + k
        x = np.einsum("bi,bij->bj", enter[b - 1], product[b - 1])
        enter[b] = x / x.sum(axis=1, keepdims=True)
    for k in range(last - 2, -1, -1):
        b = first[blocks > k + 1] + k
        x = np.einsum("bij,bj->bi", product[b + 1], leave[b + 1])
        leave[b] = x / x.sum(axis=1, keepdims=True)
    alpha = np.empty((n, steps, labels))
    a = enter
    for s in range(steps):
        x = (a @ transition) * e[:, s]
        a = np.where(live[:, s, None], x / x.sum(axis=1, keepdims=True), a)
        alpha[:, s] = a
    beta = np.empty((n, steps, labels))
    b = leave
    for s in range(steps - 1, -1, -1):
        beta[:, s] = b
        x = (e[:, s] * b) @ transition.T
        b = np.where(live[:, s, None], x / x.sum(axis=1, keepdims=True), b)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    if not pairs:
        return gamma[live]
    before = np.concatenate([enter[:, None], alpha[:, :-1]], axis=1)
    after = e * beta
    joint = before[..., :, None] * transition * after[..., None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return gamma[live], joint[live].sum(axis=0)


@dataclasses.dataclass
class ChainModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, float32
    transition: np.ndarray  # positive
    lexicon: frozenset[str]

    def __post_init__(self):
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)), np.float32)

    def __getstate__(self):
        return self.languages, self.weights, self.transition, self.lexicon

    def __setstate__(self, x):
        self.languages, self.weights, self.transition, self.lexicon = x
        self.__post_init__()

    def _emissions(self, docs: list[list[str]]) -> np.ndarray:
        if len(self.rows) > MEMORY:
            self.rows, self.table = {}, self.table[:0]
        new = list(set().union(*docs).difference(self.rows))
        if new:
            scores = _emission_scores(*features(new, self.lexicon), self.weights, len(new))
            self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, scores.astype(np.float32)])
        rows = self.rows
        return self.table[np.array([rows[w] for d in docs for w in d], np.int64)].astype(float)

    def label_words(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """(words, posteriors) of each text."""
        docs = [words_of(t) for t in texts]
        lengths = np.array([len(d) for d in docs])
        if not lengths.sum():
            return [(d, np.zeros((0, len(self.languages)))) for d in docs]
        has = lengths > 0
        gamma = forward_backward(self._emissions(docs), lengths[has], self.transition)
        cuts = np.cumsum(lengths)[:-1]
        return list(zip(docs, np.split(gamma, cuts)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for words, gamma in self.label_words(texts):
            if not words:
                out.append((UNKNOWN, 0.0))
            else:
                share = gamma.mean(axis=0)
                k = int(share.argmax())
                out.append((self.languages[k], float(min(1.0, share[k]))))
        return out


def fair_cap(sizes: list[int], total: int) -> int:
    """The largest cap with which the sizes add up to at most total; at least 1."""
    left, cap = total, 0
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) > left:
            return max(1, left // (len(sizes) - k))
        left, cap = left - size, size
    return max(1, cap)


def spread(spans: list[list[str]], words: int) -> list[list[str]]:
    """Spans of about `words` words in all, at least one, from all over the list."""
    total = sum(map(len, spans))
    if total <= words:
        return spans
    n = max(1, len(spans) * words // total)
    return [spans[i] for i in np.linspace(0, len(spans) - 1, n).astype(int)]


def _spans(words: list[str], rng: np.random.Generator) -> list[list[str]]:
    out, i = [], 0
    while i < len(words):
        k = int(rng.integers(*SPAN))
        out.append(words[i : i + k])
        i += k
    return out


def fit_chain(rows: list[tuple[str, str]], seed: int = 5) -> ChainModel | None:
    """Model of (language, text) rows; None without any word.

    Texts carry one language each, so training sequences are spliced: spans of
    random length, dealt in random order, let the transitions learn switching.
    Beyond FIT_WORDS each language keeps an even share of words, and within it
    each text, so no language is lost to others or to long texts.
    """
    languages, rng = sorted({lang for lang, _ in rows}), np.random.default_rng(seed)
    texts: list[list[list[list[str]]]] = [[] for _ in languages]
    for lang, text in rows:
        texts[languages.index(lang)].append(_spans(words_of(text), rng))
    sizes = [[sum(map(len, t)) for t in of] for of in texts]
    cap = fair_cap([sum(n) for n in sizes], FIT_WORDS)
    spans = [(k, s) for k, of in enumerate(texts) for t in of for s in spread(t, fair_cap(sizes[k], cap))]
    if not spans:
        return None
    spans = [spans[i] for i in rng.permutation(len(spans))]
    labels = np.concatenate([np.full(len(w), k) for k, w in spans])
    index: dict[str, int] = {}
    seq = np.array([index.setdefault(w, len(index)) for _, ws in spans for w in ws])
    distinct = list(index)
    count = np.bincount(seq, minlength=len(distinct))
    common = np.argsort(-count, kind="stable")[:LEXICON]
    lexicon = frozenset(distinct[i] for i in common if count[i] > 1)
    word_of, flat = features(distinct, lexicon)
    n_lang = len(languages)
    lengths = np.full(-(-len(seq) // BLOCK), BLOCK)
    lengths[-1] = len(seq) - BLOCK * (len(lengths) - 1)
    size = max(1, CELLS // (BLOCK * n_lang * n_lang))  # sequences at once
    inside = np.arange(1, len(seq)) % BLOCK != 0
    seen = np.bincount(labels[:-1][inside] * n_lang + labels[1:][inside], minlength=n_lang * n_lang).reshape(n_lang, n_lang)
    w, t = np.zeros((BUCKETS, n_lang)), np.zeros((n_lang, n_lang))
    state = [np.zeros_like(w), np.zeros_like(t)]
    for _ in range(STEPS):
        scores = _emission_scores(word_of, flat, w, len(distinct))
        diff, joint = np.empty((len(seq), n_lang)), np.zeros((n_lang, n_lang))
        for i in range(0, len(lengths), size):
            part = slice(i * BLOCK, (i + size) * BLOCK)
            gamma, some = forward_backward(scores[seq[part]], lengths[i : i + size], np.exp(t), pairs=True)
            diff[part] = -gamma
            joint += some
        diff[np.arange(len(seq)), labels] += 1
        by_word = np.stack([np.bincount(seq, diff[:, k], minlength=len(distinct)) for k in range(n_lang)], axis=1)
        grad = np.stack([np.bincount(flat, by_word[word_of, k], minlength=BUCKETS) for k in range(n_lang)], axis=1) - 0.5 * w
        gt = seen - joint - 0.5 * t
        for x, g, s in ((w, grad, state[0]), (t, gt, state[1])):
            s += g * g
            x += 0.5 * g / np.sqrt(s + 1e-8)
    return ChainModel(languages, w.astype(np.float32), np.exp(t), lexicon)


def _training_words():
    """Texts of more than TEXT_WORDS words reduced to spans from all over them."""

    def fn(langs, ids, digests, texts):
        out = []
        for digest, text in zip(digests, texts):
            words = words_of(text)
            if len(words) > TEXT_WORDS:
                text = " ".join(w for s in spread(_spans(words, np.random.default_rng(int(digest, 16))), TEXT_WORDS) for w in s)
            out.append(text)
        return langs, ids, digests, out

    return fn


def fit_languages(docs: DataFrame, rows: int = FIT_ROWS) -> ChainModel | None:
    """Model from lang of documents outside the held-out fold (crc32(doc_id) mod 3 = 1): of each language rows / languages, at least LANGUAGE_ROWS."""
    some = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 3) != 1))
        .select("lang", F.xxhash64("doc_id").alias("__h"), F.substring(F.sha2("text", 256), 1, 16).alias("__s"), "text")
    )
    each = materialize(some.select("lang", "__h", "__s").distinct(), "language-rows")
    share = max(LANGUAGE_ROWS, rows // max(1, each.select("lang").distinct().count()))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("__h", "__s"))  # limited before the shuffle
    ids = each.withColumn("__k", place).where(F.col("__k") <= share).drop("__k")
    taken = some.join(F.broadcast(ids), ["lang", "__h", "__s"], "left_semi")  # `share` ids a language
    got = map_columns(taken, ["lang", "__h", "__s", "text"], _training_words, "lang string, h long, s string, text string").dropDuplicates(["lang", "h", "s"]).collect()
    return fit_chain([(r.lang, r.text) for r in sorted(got, key=lambda r: (r.h, r.s, r.lang))])


def _predict(model: ChainModel | None):
    def fn(ids, held, texts):
        got = model.predict(texts) if model else [(UNKNOWN, 0.0)] * len(ids)
        return ids, held, [g[0] for g in got], [g[1] for g in got]

    return fn


def predict_language(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs.

    `und` with score 0 where the text is null or has no letter, or nothing could
    be learned. Repeated rows give repeated results; ids may be null.
    """
    model = fit_languages(docs, rows)
    held = (crc_mod("doc_id", 3) == 1).alias("held_out")
    return map_columns(docs, ["doc_id", held, "text"], functools.partial(_predict, model), "doc_id long, held_out boolean, lang_pred string, score double")


def _words(model: ChainModel | None):
    def fn(ids, texts):
        got = model.label_words(texts) if model else [([], np.zeros((0, 1)))] * len(ids)
        return ids, [w for w, _ in got], [[model.languages[k] for k in g.argmax(axis=1)] if len(g) else [] for _, g in got]

    return fn


def label_code_switching(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, words, langs: each word of each text with its most likely language."""
    model = fit_languages(docs, rows)
    return map_columns(docs, ["doc_id", "text"], functools.partial(_words, model), "doc_id long, words array<string>, langs array<string>")
