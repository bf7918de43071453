"""Once-seen and twice-seen Bloom filters in segments, for keys that are 64-bit hashes.

Each task ships 32 bits for every hash that is new to its buffer, by segment of
the filter; a segment inserts them into its once-seen filter and, where all
bits were set already, into its twice-seen filter. Hashes are then tested
against the twice-seen filter: in place where the whole filter, whose size
follows from the number of keys, may be broadcast, and otherwise at the
segment, to which only rows to be tested travel. Segments with very many rows
are dealt to several tasks. No repeated hash ever fails the test.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborflow.llm.common import HOT, materialize

BITS, HASHES = 16, 4
SEGMENT_BITS = 1 << 20
#: Size up to which a filter is broadcast.
BROADCAST_BYTES = 64 << 20
#: Hashes that a task holds before it ships them.
BUFFER = 1 << 18


def segments_for(keys: int) -> int:
    """Segments of a filter for that many keys, repeated ones counted each time."""
    return max(1, -(-keys * BITS // SEGMENT_BITS))


def filter_bytes(segments: int) -> int:
    return segments * SEGMENT_BITS // 8


def parts(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, residual) of hashes."""
    return ((h >> np.uint64(32)) % np.uint64(segments)).astype(np.int32), (h & np.uint64(0xFFFFFFFF)).astype("<u4")


def _places(residual: np.ndarray) -> np.ndarray:
    """Bit positions in a segment: HASHES for each 32-bit residual, by double hashing."""
    x = residual.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(SEGMENT_BITS)).astype(np.int64)


def _build(segments: int, hashes_of: Callable[[list], Iterator[np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buffers of hashes as sorted residuals by segment: those seen, those of them seen twice in the buffer, and how many there were with repeats."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        seg, low = parts(h, segments)
        order = np.argsort(seg, kind="stable")
        n, seg, low = n[order], seg[order], low[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(seg)) + 1])
        lows, counts = np.split(low, starts[1:]), np.split(n, starts[1:])
        columns = [pa.array(seg[starts], pa.int32()), pa.array([x.tobytes() for x in lows], pa.binary()), pa.array([x[c > 1].tobytes() for x, c in zip(lows, counts)], pa.binary()), pa.array(np.add.reduceat(n, starts), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["segment", "seen", "again", "n"])

    held, size = [], 0
    for b in batches:
        for h in hashes_of(b.column(0).to_pylist()):
            if len(h):
                held.append(h)
                size += len(h)
            if size >= BUFFER:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def _merge(key, group):
    """Insert the buffers of one segment in turn: once-seen, then twice-seen."""
    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for seen, again in zip(group["seen"], group["again"]):
        p = _places(np.frombuffer(seen, "<u4"))
        twice[p[once[p].all(axis=1)].ravel()] = True
        once[p.ravel()] = True
        twice[_places(np.frombuffer(again, "<u4")).ravel()] = True
    return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(twice).tobytes()], "n": [int(group["n"].sum())]})


def twice_seen(source: DataFrame, hashes_of: Callable[[list], Iterator[np.ndarray]], segments: int) -> DataFrame:
    """(segment, bits, n): the twice-seen filter of the hashes that hashes_of yields for lists of source's only column, and the keys of each segment."""
    built = source.mapInArrow(functools.partial(_build, segments, hashes_of), "segment int, seen binary, again binary, n long")
    return built.groupBy("segment").applyInPandas(_merge, "segment int, bits binary, n long")


def broadcast(filters: DataFrame, segments: int) -> Broadcast:
    """All segments as one array; for filters of at most BROADCAST_BYTES."""
    bits = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for r in filters.select("segment", "bits").collect():
        bits[r.segment] = np.frombuffer(r.bits, np.uint8)
    return filters.sparkSession.sparkContext.broadcast(bits)


def seen_twice(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the twice-seen filter of all segments."""
    seg, low = parts(h, len(bits))
    return _test(bits.reshape(-1), _places(low) + seg.astype(np.int64)[:, None] * SEGMENT_BITS)


def _test(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1)


def _test_segment(rows: pa.Table, filters: pa.Table) -> pa.Table:
    if not rows.num_rows or not filters.num_rows:
        return rows.slice(0, 0)
    low = rows["residual"].to_numpy().astype(np.int32).view("<u4")
    return rows.filter(pa.array(_test(np.frombuffer(filters["bits"][0].as_py(), np.uint8), _places(low))))


def at_segments(rows: DataFrame, filters: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows (segment, residual, ...) that pass the test, made where their segment is; a segment of more than `hot` keys is dealt to several tasks."""
    filters = materialize(filters, "twice-seen")
    salts = F.ceil(F.col("n") / hot).cast("int")
    many = filters.where(F.col("n") > hot).select("segment", salts.alias("salts"))  # at most one for each `hot` rows
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(many), "segment", "left").withColumn("salt", salt).select(*rows.columns, "salt")
    copies = filters.select("segment", "bits", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    kept = dealt.groupBy("segment", "salt").cogroup(copies.groupBy("segment", "salt")).applyInArrow(_test_segment, dealt.schema)
    return kept.drop("salt", "segment", "residual")
