"""Phrase collocations: compressed position bitmaps of words, extended depth-first by shift, AND and popcount.

A shard is a run of texts of one language, laid out as word positions with a gap
after every piece. A word's bitmap holds a mask of 16 bits for each block of 16
positions in which the word occurs. A phrase's bitmap, shifted by one position
and ANDed with a word's, is the bitmap of the longer phrase, and its popcount
the phrase's count in the shard. The counts of shards are summed by Spark, so a
lost task only repeats its own shards. Words and pairs come first; phrases of
three words grow only from pairs that are frequent over the whole corpus, by a
filter of fixed size that never fails a frequent pair.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborflow.llm.common import bound_batches, materialize
from arborflow.workers import ensure_importable

#: Bytes of texts that a task lays out at once; one text is never cut.
SHARD_BYTES = 6 << 20
#: Positions of a block.
BLOCK_BITS = 4
BLOCK = 1 << BLOCK_BITS
#: Bitmap rows that are extended at once, which bounds a task's memory.
ROWS = 1 << 18
#: 64-bit words of the filter of frequent pairs at most (32 MB).
FILTER_WORDS = 1 << 22
#: Bits by which the hash of a pair's first word is turned.
TURN = 17
#: Cells of a language in which its best phrases are found before they are ranked together.
CELLS = 64

_UPPER, _BREAKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _BREAKS + b"\t", _UPPER.lower() + b"\n" * len(_BREAKS) + b" ")


def layout(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(ids, names) of the texts' words in order, with a 0 after every piece; names[0] is no word."""
    spaced = pa.array([b"\n", *(t.translate(_TABLE).replace(b"\n", b" \n ") + b" \n" for t in texts)], pa.large_binary())
    words = pc.split_pattern(spaced, " ").values.dictionary_encode()
    ids, names = words.indices.to_numpy(), words.dictionary
    empty = pc.index(names, pa.scalar(b"", names.type)).as_py()
    return (ids if empty < 0 else ids[ids != empty]), names.cast(pa.binary()).cast(pa.string())


class Bitmaps:
    """The words' bitmaps of a shard: rows (word, block, mask), by word and again by block."""

    def __init__(self, ids: np.ndarray):
        at = np.flatnonzero(ids)
        blocks = (len(ids) >> BLOCK_BITS) + 2
        key = ids[at].astype(np.int64) * blocks + (at >> BLOCK_BITS)
        order = np.argsort(key, kind="stable")
        key, bit = key[order], np.left_shift(1, at[order] & (BLOCK - 1)).astype(np.uint16)
        starts = _starts(key)
        self.word, self.block = key[starts] // blocks, key[starts] % blocks
        self.mask = np.bitwise_or.reduceat(bit, starts) if len(starts) else bit
        by_block = np.argsort(self.block, kind="stable")
        self.words_at, self.masks_at = self.word[by_block], self.mask[by_block]
        self.first = np.searchsorted(self.block[by_block], np.arange(blocks + 1))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        return _sums(self.word, self.mask)

    def batches(self) -> Iterator[slice]:
        """Runs of whole words of about ROWS rows."""
        starts = np.append(_starts(self.word), len(self.word))
        lo = 0
        while lo < len(self.word):
            hi = max(starts[np.searchsorted(starts, lo + ROWS, side="right") - 1], starts[np.searchsorted(starts, lo, side="right")])
            yield slice(lo, int(hi))
            lo = int(hi)

    def extend(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, next word, block, mask): every phrase's bitmap moved one position on, ANDed with the words' there."""
        carry = mask >> (BLOCK - 1)
        over = np.flatnonzero(carry)
        phrase, block, mask = np.concatenate([phrase, phrase[over]]), np.concatenate([block, block[over] + 1]), np.concatenate([mask << 1, carry[over]]).astype(np.uint16)
        out = []
        for lo in range(0, len(mask), ROWS):
            part = slice(lo, lo + ROWS)
            first = self.first[block[part]]
            n = self.first[block[part] + 1] - first
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) + np.repeat(first - (np.cumsum(n) - n), n)
            both = self.masks_at[at] & mask[part][row]
            hit = np.flatnonzero(both)
            row = row[hit]
            out.append((phrase[part][row], self.words_at[at[hit]], block[part][row], both[hit]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (phrase, phrase, block, mask)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]).astype(np.int64) if len(key) else np.zeros(0, np.int64)


def _sums(key: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, popcounts) of rows sorted by key."""
    starts = _starts(key)
    bits = np.bitwise_count(mask).astype(np.int64)
    return key[starts], np.add.reduceat(bits, starts) if len(starts) else bits


def _grouped(key: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    return key[order], *(r[order] for r in rest)


def count_pairs(ids: np.ndarray, v: int) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """(words of phrases, counts) of a shard's words and pairs; v: how many words there are."""
    maps = Bitmaps(ids)
    word, n = maps.counts()
    yield (word,), n
    for part in maps.batches():
        a, b, _, mask = maps.extend(maps.word[part], maps.block[part], maps.mask[part])
        key, n = _sums(*_grouped(a * v + b, mask))
        yield (key // v, key % v), n


def count_triples(ids: np.ndarray, v: int, may_be_frequent) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """(words of phrases, counts) of a shard's phrases of three words whose two pairs both pass the test may_be_frequent(a, b)."""
    maps = Bitmaps(ids)
    for part in maps.batches():
        a, b, block, mask = maps.extend(maps.word[part], maps.block[part], maps.mask[part])
        keep = may_be_frequent(a, b)
        pairs, of = np.unique(a[keep] * v + b[keep], return_inverse=True)
        of, c, _, mask = maps.extend(of, block[keep], mask[keep])
        keep = may_be_frequent(pairs[of] % v, c) if len(of) else np.zeros(0, bool)
        key, n = _sums(*_grouped(of[keep] * v + c[keep], mask[keep]))
        pair = pairs[key // v] if len(key) else key
        yield (pair // v, pair % v, key % v), n


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """(language, ids, names) of runs of texts."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
            held.setdefault(lang, []).append(text.as_py() or b"")
            size += len(held[lang][-1])
            if size >= SHARD_BYTES:
                yield from ((k, *layout(x)) for k, x in held.items())
                held, size = {}, 0
    yield from ((k, *layout(x)) for k, x in held.items())


def _batch(lang: str, phrases: pa.Array, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(phrases), np.int32))), phrases, pa.array(n, pa.int64())], ["lang", "phrase", "a"])


def _named(names: pa.Array, words: tuple[np.ndarray, ...]) -> pa.Array:
    """The words of phrases, joined by blanks."""
    taken = [names.take(pa.array(w)) for w in words]
    return pc.binary_join_element_wise(*taken, " ") if len(taken) > 1 else taken[0]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, ids, names in _shards(batches):
        yield _batch(lang, pa.nulls(1, pa.string()), [int(np.count_nonzero(ids))])
        for words, n in count_pairs(ids, len(names)):
            yield _batch(lang, _named(names, words), n)


def _triples(bits: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = bits.value
    for lang, ids, names in _shards(batches):
        prefix = f"{lang}\t".encode()
        hashes = np.array([xxhash.xxh64_intdigest(prefix + w, seed=42) for w in names.cast(pa.binary()).to_pylist()], np.uint64)
        turned = (hashes << np.uint64(TURN)) | (hashes >> np.uint64(64 - TURN))

        def may_be_frequent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            h = turned[a] ^ hashes[b]  # noqa: B023  used before the next shard
            return (known[h & np.uint64(len(known) - 1)] >> (h >> np.uint64(58)) & np.uint64(1)).astype(bool)

        for words, n in count_triples(ids, len(names), may_be_frequent):
            yield _batch(lang, _named(names, words), n)


def frequent_filter(pairs: DataFrame) -> Broadcast:
    """A bit for each (lang, phrase of two words) of pairs, in at most FILTER_WORDS 64-bit words whatever their number; other phrases may share bits."""
    want = pairs.count() // 4
    size = 1
    while size < min(want, FILTER_WORDS):
        size *= 2
    word = lambda k: F.xxhash64(F.concat("lang", F.lit("\t"), F.split("phrase", " ")[k]))
    turned = pairs.select(word(0).alias("a"), word(1).alias("b"))
    hashed = turned.select(F.shiftleft("a", TURN).bitwiseOR(F.shiftrightunsigned("a", 64 - TURN)).bitwiseXOR(F.col("b")).alias("h"))
    set_bits = hashed.select(F.col("h").bitwiseAND(size - 1).alias("i"), F.expr("shiftleft(1L, int(shiftrightunsigned(h, 58)))").alias("bit"))
    found = set_bits.groupBy("i").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most `size` rows
    words = np.zeros(size, np.uint64)
    words[found["i"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return pairs.sparkSession.sparkContext.broadcast(words)


def phrase_counts(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, a): every phrase of one to three words found at least `least` times in its language, and a row with phrase null that counts all words.

    Null texts hold no words and null languages are `und`. Repeated rows count
    each time. Only the two named columns are read.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    bound_batches(spark)
    given = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    schema = "lang string, phrase string, a long"

    def summed(shards: DataFrame) -> DataFrame:
        return shards.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | F.col("phrase").isNull())

    short = materialize(summed(given.mapInArrow(_pairs, schema)), "phrases")
    bits = frequent_filter(short.where(F.instr("phrase", " ") > 0).select("lang", "phrase"))
    return short.unionByName(materialize(summed(given.mapInArrow(functools.partial(_triples, bits), schema)), "long-phrases"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in whole decimals; at most a million, for a phrase is no more frequent than its parts."""
    a, left, right = (c.cast("decimal(18,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a).cast("decimal(30,0)"), (left * right).cast("decimal(36,0)"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, share: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two or three words by score.

    A phrase found at least `least` times is cut where its parts' score is lowest
    (ties: earliest). It is left out if a longer such phrase that holds it has
    `share` percent of its occurrences. Ties of score go to the more frequent
    phrase, then to the smaller bytes. A table without words gives no rows.
    """
    counts = phrase_counts(docs, least, text_col, lang_col)
    given = counts.where("phrase is not null").withColumn("words", F.split("phrase", " "))
    w = F.col("words")
    join = lambda i, n: F.array_join(F.slice(w, i, n), " ")
    part = lambda cut, side, text: F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), text.alias("part"))
    two = F.array(part(1, "l", w[0]), part(1, "r", F.try_element_at(w, F.lit(2))))
    three = F.array(part(1, "l", w[0]), part(1, "r", join(2, 2)), part(2, "l", join(1, 2)), part(2, "r", F.try_element_at(w, F.lit(3))))
    longer = given.where(F.size(w) > 1)
    parts = longer.select("lang", "phrase", "a", F.inline(F.when(F.size(w) == 2, two).otherwise(three)))
    known = given.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    of = lambda cut, side: F.max(F.when((F.col("cut") == cut) & (F.col("side") == side), F.col("f"))).alias(f"{side}{cut}")
    cuts = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase").agg(F.max("a").alias("a"), of(1, "l"), of(1, "r"), of(2, "l"), of(2, "r"))
    scored = cuts.withColumns({"s1": _score(F.col("a"), F.col("l1"), F.col("r1")), "s2": _score(F.col("a"), F.col("l2"), F.col("r2"))})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    pick = lambda name, x: F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1")).alias(name)
    scored = scored.select("lang", "phrase", "a", pick("l", "l"), pick("r", "r"), pick("score", "s"))
    within = parts.where((F.col("cut") == 1) & (F.col("side") == "r") | (F.col("cut") == 2) & (F.col("side") == "l")).where(F.instr("part", " ") > 0)
    held = within.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longest"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a"))).drop("longest")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    cell = F.pmod(F.xxhash64("phrase"), F.lit(CELLS))
    first = kept.withColumn("cell", cell).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "cell").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)  # at most CELLS x top rows a language
    total = counts.where("phrase is null").select("lang", F.col("a").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
