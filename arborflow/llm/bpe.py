"""BPE encoding by speculation: greedy longest match proposes, pair checks verify, exact merging repairs.

A sequence of tokens is the BPE encoding of a word exactly when each token
encodes to itself and each adjacent pair of tokens encodes to that pair. New
words of a batch are matched greedily; the distinct adjacent pairs of all of
them are checked at once against a sorted array of known verdicts; words with a
failing pair, and only those, go through exact merging.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborflow.llm.common import map_columns

END = "</w>"
#: Symbols up to which a plain list merges faster than a heap.
SHORT = 64
#: Words that one generation of a worker's memory holds; the generation before is kept as well.
CACHE_WORDS = 300_000
#: Below this code point no character composes, so NFC changes nothing.
PLAIN_LIMIT = 0x250
PLAIN = re.compile(f"[\\0-{chr(PLAIN_LIMIT - 1)}]*\\Z")
#: The endings that the vocabulary's pre-tokenizer splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: White_Space below PLAIN_LIMIT (Python's \\s also has 1C-1F, which Unicode's property lacks).
SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_LIMIT + 0xB8) if unicodedata.category(chr(c))[0] == kind)


def _plain_words() -> re.Pattern:
    letter, number = _class("L"), _class("N")
    return re.compile("|".join([*CONTRACTIONS, f"[{letter}]+", f"[{number}]", f"[^{re.escape(SPACE)}{letter}{number}]+"]))


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself if printable Latin-1, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class SpeculativeBPE:
    """Encoder and decoder of a word-end BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in {**self.vocab, **self.special}.items()}
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank_of: dict[int, int] = {}  # a << 32 | b -> rank
        self.made: list[int] = []  # rank -> the joined token
        for rank, (a, b) in enumerate(pairs):
            self.rank_of[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.symbols_of: dict[int, list[int]] = {}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes_to_chars = _byte_chars()
        self.plain_words = _plain_words()
        self.lengths: dict[str, list[int]] = {}  # first three characters -> lengths of the tokens that start so, longest first
        for t in self.vocab:
            bare = t.removesuffix(END) if t != END else t
            if len(bare) > 2:
                self.lengths.setdefault(bare[:3], set()).add(len(bare))
        self.lengths = {k: sorted(v, reverse=True) for k, v in self.lengths.items()}
        self.is_own: dict[int, bool] = {}
        self.known = np.zeros(0, np.uint64)  # sorted pairs a << 32 | b
        self.verdict = np.zeros(0, bool)
        self.words: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.repaired = self.proposed = 0
        self._pieces = None
        self._path = path

    # exact merging

    def symbols(self, chars: str) -> list[int]:
        return [self.vocab[c] for c in chars[:-1]] + [self.vocab[chars[-1] + END]]

    def merge(self, ids: list[int]) -> list[int]:
        """Join the adjacent pair of lowest rank, leftmost first, until none is left."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        ids, get, none = list(ids), self.rank_of.get, len(self.made)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """merge() over a heap of (rank, place) and linked places, so that n symbols cost n log n."""
        n, get, none = len(ids), self.rank_of.get, len(self.made)
        ids, before, after = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = [*(get(a << 32 | b, none) for a, b in zip(ids, ids[1:])), none]  # of the pair that starts at a place
        heap = [r * n + i for i, r in enumerate(ranks) if r < none]
        heapq.heapify(heap)
        while heap:
            least, i = divmod(heapq.heappop(heap), n)
            if ranks[i] != least:  # the pair was joined or changed since
                continue
            gone = after[i]
            ids[i], ids[gone], ranks[gone] = self.made[least], -1, none
            right, left = after[gone], before[i]
            after[i] = right
            ranks[i] = none
            if right < n:
                before[right] = i
                ranks[i] = get(ids[i] << 32 | ids[right], none)
            if left >= 0:
                ranks[left] = get(ids[left] << 32 | ids[i], none)
            for k in (left, i):
                if k >= 0 and ranks[k] < none:
                    heapq.heappush(heap, ranks[k] * n + k)
        return [t for t in ids if t >= 0]

    def _token_symbols(self, token: int) -> list[int]:
        if (x := self.symbols_of.get(token)) is None:
            t = self.text_of[token]
            x = self.symbols_of[token] = self.symbols(t.removesuffix(END)) if t.endswith(END) and t != END else [self.vocab[c] for c in t]
        return x

    # speculation

    def _own(self, token: int) -> bool:
        if (x := self.is_own.get(token)) is None:
            x = self.is_own[token] = self.merge(self._token_symbols(token)) == [token]
        return x

    def propose(self, chars: str) -> list[int]:
        """Longest token at each place, word-end tokens at the end only."""
        out, i, n, vocab, lengths, own, end = [], 0, len(chars), self.vocab, self.lengths, self.is_own, chars + END
        while i < n:
            for k in (*lengths.get(chars[i : i + 3], ()), 2, 1):
                stop = i + k
                if stop > n:
                    continue
                t = vocab.get(end[i:] if stop == n else chars[i:stop])
                if t is not None and (k == 1 or own.get(t) or self._own(t)):
                    out.append(t)
                    i = stop
                    break
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Verdicts of pairs a << 32 | b: does the merging of both tokens' symbols end in these two?"""
        distinct, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = distinct[(at >= len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != distinct)] if len(self.known) else distinct
        if len(new):
            said = np.fromiter((self.merge(self._token_symbols(a) + self._token_symbols(b)) == [a, b] for a, b in zip((new >> np.uint64(32)).tolist(), (new & np.uint64(0xFFFFFFFF)).tolist())), bool, len(new))
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.verdict = known[order], np.concatenate([self.verdict, said])[order]
        return self.verdict[np.searchsorted(self.known, distinct)][back]

    def _chars(self, word: str) -> str:
        if word.isascii():
            return word if word.isprintable() else "".join(map(self.bytes_to_chars.__getitem__, word.encode()))
        return "".join(map(self.bytes_to_chars.__getitem__, word.encode()))

    def learn(self, words: list[str]) -> None:
        """Encode distinct new words and keep them."""
        if not words:
            return
        proposals = [self.propose(self._chars(w)) for w in words]
        self.proposed += len(words)
        lengths = np.array([len(p) for p in proposals])
        flat = np.fromiter((t for p in proposals for t in p), np.uint64, int(lengths.sum()))
        bad = np.zeros(len(words), bool)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), lengths)
            inside = owner[1:] == owner[:-1]
            fails = ~self.compatible(((flat[:-1] << np.uint64(32)) | flat[1:])[inside])
            bad[owner[:-1][inside][fails]] = True
        self.repaired += int(bad.sum())
        for w, p, wrong in zip(words, proposals, bad.tolist()):
            ids = self.merge(self.symbols(self._chars(w))) if wrong else p
            self.words[w] = (np.array(ids, "<u4").tobytes(), " ".join([self.text_of[i] for i in ids]))

    # texts

    def split(self, text: str) -> list[str]:
        """Words after normalisation; characters beyond the plain range go through the library's own normaliser and splitter."""
        if PLAIN.match(text):
            return self.plain_words.findall(text.lower())
        if self._pieces is None:
            from tokenizers import Tokenizer, pre_tokenizers

            t = Tokenizer.from_file(self._path)
            spec = json.loads(open(self._path, encoding="utf-8").read())["pre_tokenizer"]["pretokenizers"][0]
            from tokenizers import Regex

            self._pieces = (t.normalizer, pre_tokenizers.Split(Regex(spec["pattern"]["Regex"]), "removed", invert=True))
        norm, cut = self._pieces
        return [p for p, _ in cut.pre_tokenize_str(norm.normalize_str(text))]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        cut = [[p for p in self.at_special.split(t) if p] if self.at_special and self.at_special.search(t) else [t] for t in texts]
        parts = [[[p] if p in self.special else self.split(p) for p in c] for c in cut]
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        for s, i in self.special.items():
            self.words[s] = (np.array([i], "<u4").tobytes(), s)
        docs = [[w for p in doc for w in p] if len(doc) != 1 else doc[0] for doc in parts]
        new = set().union(*docs).difference(self.words)
        if self.older:
            self.words.update((w, self.older[w]) for w in new if w in self.older)
            new = [w for w in new if w not in self.words]
        self.learn(list(new))
        out = []
        for words in docs:
            got = [self.words[w] for w in words]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text or ""])[0][0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: the vocabulary names no decoder, and this is what the library then does."""
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)


@functools.lru_cache(maxsize=2)
def load(path: str) -> SpeculativeBPE:
    return SpeculativeBPE(path)


def _full(path: str):
    bpe = load(path)

    def fn(ids, texts):
        got = bpe.encode_batch([t or "" for t in texts])
        return ids, [np.frombuffer(a, "<u4").astype(np.int32).tolist() for a, _ in got], [b for _, b in got]

    return fn


def _digest(path: str):
    bpe = load(path)

    def fn(ids, texts):
        got = bpe.encode_batch([t or "" for t in texts])
        return ids, [len(a) // 4 for a, _ in got], [hashlib.sha256(a).hexdigest() for a, _ in got], [hashlib.sha256(b.encode()).hexdigest() for _, b in got]

    return fn


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, decoded string.

    Null texts count as empty and give no ids. Rows are independent, so repeated
    rows give equal values; other columns are not read. path must be readable on
    every executor.
    """
    return map_columns(docs, [F.col(id_col), F.col(text_col)], functools.partial(_full, path), "doc_id long, ids array<int>, decoded string")


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_encode reduced in the same task to n_tokens and hashes of ids and decoded text."""
    return map_columns(docs, [F.col(id_col), F.col(text_col)], functools.partial(_digest, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
