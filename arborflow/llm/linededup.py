"""Exact line dedup in which only lines that two Bloom filters suspect are shuffled.

Scan 1 builds the filters from hashes of the lines' keys (see bloom). Scan 2 tests
every line against the twice-seen filter and emits the suspects, whose whole
keys are then grouped: keys that two documents hold are confirmed and their
least doc_id keeps them. The filter is broadcast while its size, BITS bits for
each line, is small; beyond that the lines are tested at the filter's segments.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborflow.llm import bloom
from arborflow.llm.common import HOT, bound_batches, fresh, join_hot, map_columns, materialize

LEAST = 10
BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = str.maketrans(UPPER, UPPER.lower())


def key_of(line: str) -> str:
    """The line without blanks at its ends, A-Z in lower case."""
    line = line.strip(BLANK)
    return line.lower() if line.isascii() else line.translate(_FOLD)


def keys_of(text: str | None) -> list[str]:
    """Distinct keys of at least LEAST code points, in order of first place."""
    return [k for k in dict.fromkeys(map(key_of, (text or "").split("\n"))) if len(k) >= LEAST]


def _hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys), np.uint64, len(keys))


def _line_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    for text in texts:
        if keys := keys_of(text):
            yield np.unique(_hashes(keys))


def _digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _suspects(filters):
    def fn(ids, texts):
        rows = [(doc, k) for doc, text in zip(ids, texts) for k in keys_of(text)]
        rows = [r for r, may in zip(rows, bloom.seen_twice(filters.value, _hashes([k for _, k in rows])).tolist()) if may]
        return [d for d, _ in rows], [_digest(k) for _, k in rows], [k for _, k in rows]

    return fn


def _all_keys(segments: int):
    def fn(ids, texts):
        rows = [(doc, k) for doc, text in zip(ids, texts) for k in keys_of(text)]
        segment, low = bloom.parts(_hashes([k for _, k in rows]), segments)
        return [d for d, _ in rows], [_digest(k) for _, k in rows], [k for _, k in rows], pa.array(segment), pa.array(low.view(np.int32))

    return fn


def suspected_lines(docs: DataFrame, broadcast_bytes: int = bloom.BROADCAST_BYTES) -> DataFrame:
    """(doc_id, digest, key) of every line key that may be in two documents; none that is goes missing."""
    known = docs.where(F.col("doc_id").isNotNull())
    lines = known.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
    segments = bloom.segments_for(lines)
    bound_batches(docs.sparkSession)
    filters = bloom.twice_seen(known.select("text"), _line_hashes, segments)
    if bloom.filter_bytes(segments) <= broadcast_bytes:
        return map_columns(known, ["doc_id", "text"], functools.partial(_suspects, bloom.broadcast(filters, segments)), "doc_id long, digest binary, key string")
    rows = map_columns(known, ["doc_id", "text"], functools.partial(_all_keys, segments), "doc_id long, digest binary, key string, segment int, residual int")
    return bloom.at_segments(rows, filters)


def _apply():
    def fn(ids, texts, drops):
        total, gone, kept = [], [], []
        for text, drop in zip(texts, drops):
            lines, lost = (text or "").split("\n"), set(drop or ())
            keep = [x for x in lines if len(k := key_of(x)) < LEAST or _digest(k) not in lost] if lost else lines
            total.append(len(lines))
            gone.append(len(lines) - len(keep))
            kept.append("\n".join(keep))
        return ids, total, gone, kept

    return fn


def _apply_digest():
    inner = _apply()

    def fn(ids, texts, drops):
        ids, total, gone, kept = inner(ids, texts, drops)
        return ids, total, gone, [hashlib.sha256(k.encode("utf-8", "surrogatepass")).hexdigest() for k in kept]

    return fn


def with_drops(docs: DataFrame, broadcast_bytes: int = bloom.BROADCAST_BYTES, hot: int = HOT, name: str = "__drops") -> DataFrame:
    """docs with the column `name`, which docs must not have: digests of the keys whose lines this document loses (null: none). Lines of more than `hot` documents are joined by broadcast."""
    suspects = materialize(suspected_lines(docs, broadcast_bytes), "suspected-lines")
    kept = (
        suspects.groupBy("key").agg(F.min("doc_id").alias("__least"), F.max("doc_id").alias("__most"), F.min("digest").alias("digest"), F.count("*").alias("__n"))
        .where("__least < __most").select("digest", "__least", "__n")
    )
    kept = materialize(kept, "repeated-lines")
    drops = (
        join_hot(suspects.select("doc_id", "digest"), kept.drop("__n"), ["digest"], kept.where(F.col("__n") > hot)).where(F.col("doc_id") != F.col("__least"))
        .groupBy("doc_id").agg(F.collect_set("digest").alias(name))
    )
    return docs.join(drops, docs["doc_id"] == drops["doc_id"], "left").select(*[docs[c] for c in docs.columns], drops[name])


def dedup_lines(docs: DataFrame, broadcast_bytes: int = bloom.BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept for each row of docs.

    A null or empty text is one empty line. Rows that repeat a doc_id count as
    one document: they never make each other's lines repeats, and lose the same
    keys. Rows without doc_id keep all lines and hold no first occurrence.
    """
    return map_columns(with_drops(docs.select("doc_id", "text"), broadcast_bytes), ["doc_id", "text", "__drops"], _apply, "doc_id long, n_lines long, n_dropped long, kept string")


def dedup_lines_digest(docs: DataFrame) -> DataFrame:
    """dedup_lines with the kept text reduced to its SHA-256 in the same task."""
    return map_columns(with_drops(docs.select("doc_id", "text")), ["doc_id", "text", "__drops"], _apply_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines_in_place(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with text reduced to its kept lines and n_chars, if there is one, to match."""
    @F.pandas_udf("string")
    def keep(texts: pd.Series, drops: pd.Series) -> pd.Series:
        drops = [None if d is None else list(d) for d in drops]
        return pd.Series(_apply()(range(len(texts)), texts.tolist(), drops)[3], dtype=object)

    name = fresh("__drops", docs)
    out = with_drops(docs, name=name)
    out = out.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(keep("text", name))).drop(name)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
