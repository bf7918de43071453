"""Removal of repeated strings through a sparse suffix array, sorted deep-shallow.

Every string of LENGTH bytes holds an anchor: the place of the least 16-byte
hash among its first REACH + 1 places. Equal strings have equal anchors, so only
suffixes at anchors need order. Two Bloom filters (see bloom) drop anchors whose
next CORE bytes (which all strings with this anchor share) are nowhere else.
Anchors whose whole surroundings (REACH bytes before, LENGTH after) repeat are
covered outright. The others, one for each different surrounding, are sorted:
multikey quicksort over eight-byte words down to SHALLOW bytes, then a blind
trie for each group that is still equal. Common prefixes of neighbours, and
hashes of the bytes before the anchor, tell which strings around it repeat. A
core with more than SORT_ROWS places would be too much for one sort; the strings
around its anchors are counted by hash, for each offset, with a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborflow.llm import bloom
from arborflow.llm.common import HOT, bound_batches, join_hot, map_columns, materialize
from arborflow.llm.minhash import _B, _B_INV, _powers, mix

LENGTH, GRAM, REACH = 400, 16, 127
CORE = LENGTH - REACH
SHALLOW = 24
#: Bytes of surroundings that one sorting task should hold, places of a core that are sorted, and bytes of a table that may be broadcast.
SORT_BYTES, SORT_ROWS, BROADCAST_BYTES = 24 << 20, 4096, 64 << 20
#: Bytes of texts hashed at once.
CHUNK = 1 << 22
_U = np.uint64


class _Tables:
    """Powers of the hash base, grown on demand."""

    def __init__(self):
        self.up = self.down = np.zeros(0, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = _powers(_B, n), _powers(_B_INV, n)
        return self.up, self.down


_tables = _Tables()


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = _tables.get(len(data) + 1)
    return np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])])


def _hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = _tables.get(len(sums))
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(_U))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, _U(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, hash of the core, hash of the surroundings) of the texts' anchors, in order."""
    size = np.array([len(t) for t in texts], np.int64)
    long = np.flatnonzero(size >= LENGTH)
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    size = size[long]
    stop = np.cumsum(size)
    start, n = stop - size, size - LENGTH + 1
    sums = _sums(np.concatenate([texts[i] for i in long]))
    places = np.arange(stop[-1] - GRAM + 1)
    least = _window_min((_hash(sums, places, places + GRAM) & _U(0xFFFFFFFF00000000)) | places.astype(_U), REACH + 1)
    windows = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)  # within one text each; their minima don't go back
    at = (least[windows] & _U(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate([[True], np.diff(at) != 0])]
    of = np.searchsorted(stop, at, side="right")
    lo, hi = np.maximum(at - REACH, start[of]), np.minimum(at + LENGTH, stop[of])
    return long[of], at - start[of], _hash(sums, at, at + CORE), mix(_hash(sums, lo, hi) + (at - lo).astype(_U))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first, texts as bytes), about CHUNK bytes at a time."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(_bytes(text))
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _core_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    for _, some in _chunks(texts):
        yield anchors(some)[2]


def _suspects(filters, segments: int):
    """Rows of equal core and surroundings in one text; without filters all of them, with the core's segment and residual."""

    def fn(rids, texts):
        rids, found = np.array(rids, np.int64), []
        for first, some in _chunks(texts):
            of, at, core, around = anchors(some)
            if filters is not None and len(at):
                keep = bloom.seen_twice(filters.value, core)
                of, at, core, around = of[keep], at[keep], core[keep], around[keep]
            after = np.minimum(LENGTH, np.array([len(t) for t in some], np.int64)[of] - at)
            order = np.lexsort((at, around, core, of))
            found.append([x[order] for x in (of + first, at, core, around, after)])
        of, at, core, around, after = (np.concatenate(x) for x in zip(*found))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(core) != 0) | (np.diff(around) != 0)])[: len(at)])
        places = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)), pa.int32()), pa.array(at))
        out = pa.array(rids[of[new]]), pa.array(core[new].view(np.int64)), pa.array(around[new].view(np.int64)), places, pa.array(after[new])
        if filters is not None:
            return out
        segment, low = bloom.parts(core[new], segments)
        return *out, pa.array(segment), pa.array(low.view(np.int32))

    return fn


def _wanted_places(texts, wanted):
    """(bytes, places, whether each surrounding occurs more than once) of each text."""
    for text, codes in zip(texts, wanted):
        codes = np.sort(np.array(codes, np.int64))
        yield _bytes(text), codes >> 1, codes & 1


def _surroundings():
    def fn(texts, wanted):
        out = [[], [], [], [], []]
        for data, at, many in _wanted_places(texts, wanted):
            sums, raw = _sums(data), data.tobytes()
            lo, hi = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, len(data))
            around = mix(_hash(sums, lo, hi) + (at - lo).astype(_U))
            columns = _hash(sums, at, at + CORE).view(np.int64), around.view(np.int64), many.astype(bool), at - lo
            for col, v in zip(out, (*(c.tolist() for c in columns), [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())])):
                col.extend(v)
        return out

    return fn


def _strings_around():
    """For each wanted place: core, surroundings, whether those occur more than once, and the offsets and hashes of the strings around it."""

    def fn(texts, wanted):
        out = [[], [], [], [], []]
        back = np.arange(REACH + 1)
        for data, at, many in _wanted_places(texts, wanted):
            sums = _sums(data)
            lo, hi = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, len(data))
            around = mix(_hash(sums, lo, hi) + (at - lo).astype(_U))
            start = at[:, None] - back
            ok = (start >= 0) & (start + LENGTH <= len(data))
            h = np.zeros(start.shape, _U)
            h[ok] = _hash(sums, start[ok], start[ok] + LENGTH)
            columns = _hash(sums, at, at + CORE).view(np.int64), around.view(np.int64), many.astype(bool)
            rows = *(c.tolist() for c in columns), [back[k].tolist() for k in ok], [x[k].view(np.int64).tolist() for x, k in zip(h, ok)]
            for col, v in zip(out, rows):
                col.extend(v)
        return out

    return fn


# sorting


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def multikey_quicksort(strings: list[bytes], depth: int = SHALLOW) -> list[list[int]]:
    """Groups of indices in order; the strings of a group agree in their first `depth` bytes."""
    words = np.array([np.frombuffer(s[:depth].ljust(depth, b"\0"), ">u8") for s in strings]).reshape(len(strings), -1).astype(_U)
    out, todo = [], [(np.arange(len(strings)), 0)]
    while todo:
        idx, k = todo.pop()
        if k == words.shape[1] or len(idx) < 2:
            if len(idx):
                out.append(idx.tolist())
            continue
        w = words[idx, k]
        pivot = np.sort(w[:: max(1, len(w) // 15)])
        pivot = pivot[len(pivot) // 2]
        less, more = w < pivot, w > pivot
        todo += [(idx[more], k), (idx[~less & ~more], k + 1), (idx[less], k)]
    return out


class BlindTrie:
    """Orders strings by branching bytes alone; one full comparison an insertion."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]  # a leaf: equal strings
            return
        node, path = self.root, []
        while isinstance(node, tuple):  # (depth, {byte: node})
            path.append(node)
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        lcp = common_prefix(s, other)
        if lcp == len(s) == len(other):
            node.append(i)
            return
        k = next((k for k, p in enumerate(path) if p[0] >= lcp), len(path))
        if k < len(path) and path[k][0] == lcp:
            path[k][1][self._byte(s, lcp)] = [i]
            return
        below = path[k] if k < len(path) else node
        fork = (lcp, {self._byte(other, lcp): below, self._byte(s, lcp): [i]})
        if k:
            above = path[k - 1]
            above[1][self._byte(s, above[0])] = fork
        else:
            self.root = fork

    def order(self) -> Iterator[tuple[int, int]]:
        """(index, common prefix with the one before), the first with 0."""
        todo, lcp = [(self.root, 0)], 0
        while todo:
            node, lcp = todo.pop()
            if isinstance(node, tuple):
                kids = [node[1][b] for b in sorted(node[1])]
                todo += [(kid, node[0]) for kid in reversed(kids[1:])] + [(kids[0], lcp)]
            else:
                for k, i in enumerate(node):
                    yield i, (len(self.strings[i]) if k else lcp)


def deep_shallow_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix of each with the one before it in that order)."""
    order, lcps = [], []
    for group in multikey_quicksort(strings):
        trie = BlindTrie(strings)
        for i in group:
            trie.insert(i)
        got = list(trie.order())
        if order:
            got[0] = (got[0][0], common_prefix(strings[order[-1]], strings[got[0][0]]))
        order += [i for i, _ in got]
        lcps += [n for _, n in got]
    return np.array(order, np.int64), np.array(lcps, np.int64)


def covered(contexts: list[bytes], before: list[int], many: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after each anchor that repeated strings around it cover; (0, 0) if none.

    contexts: bytes around each anchor, `before` of them before it; many: whether
    the whole context occurs more than once.
    """
    n = len(contexts)
    before = np.array(before)
    order, lcp = deep_shallow_sort([c[b:] for c, b in zip(contexts, before.tolist())])
    after = np.array([len(c) for c in contexts]) - before
    left = np.zeros((n, REACH), np.uint8)
    for i, (c, b) in enumerate(zip(contexts, before.tolist())):
        left[i, :b] = np.frombuffer(c[:b], np.uint8)[::-1]
    left, before_o, after_o = left[order], before[order], after[order]
    first, last = np.full(n, -1), np.full(n, -1)
    h = np.zeros(n, _U)
    for o in range(REACH + 1):
        if o:
            h = mix(h + left[:, o - 1].astype(_U) + _U(1))
        can = (before_o >= o) & (after_o >= LENGTH - o)
        key = mix(h + np.cumsum(lcp < LENGTH - o).astype(_U) * _U(_B))[can]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(can)[count[at] > 1]
        last[hit] = o
        first[hit] = np.where(first[hit] < 0, o, first[hit])
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    some = last >= 0
    lo[order[some]], hi[order[some]] = last[some], LENGTH - first[some]
    whole = np.array(many, bool) & (before + after >= LENGTH)
    lo[whole], hi[whole] = before[whole], after[whole]
    return lo, hi


def _sort_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    f = pd.concat([*frames, pd.DataFrame(columns=["core", "around", "many", "before", "context"])])
    if len(f):
        lo, hi = covered([bytes(c) for c in f["context"]], f["before"].tolist(), f["many"].tolist())
        yield pd.DataFrame({"core": f["core"].astype("int64"), "around": f["around"].astype("int64"), "lo": lo, "hi": hi})[hi > 0]


def _counted(strings: DataFrame, hot: int) -> DataFrame:
    """(core, around, lo, hi) for rows (core, around, many, back, h): bytes before and after the anchor that strings cover which another row has too, or the row's own repetition."""
    each = materialize(strings.select("core", "around", "many", F.inline(F.arrays_zip("back", "h"))), "strings")
    repeated = materialize(each.groupBy("core", "back", "h").agg(F.count("*").alias("n"), F.max("many").alias("any")).where("n > 1 or any").drop("any"), "repeated-strings")
    hits = join_hot(each, repeated.drop("n"), ["core", "back", "h"], repeated.where(F.col("n") > hot))
    return hits.groupBy("core", "around").agg(F.max("back").cast("long").alias("lo"), (LENGTH - F.min("back")).cast("long").alias("hi"))


# removal


def spans(n: int, lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the union of [lo, hi)."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo, hi)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def _cut(raw: bytes, cover) -> tuple[list[tuple[int, int]], bytes]:
    runs = spans(len(raw), [c["lo"] for c in cover or ()], [c["hi"] for c in cover or ()])
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return runs, b"".join([*kept, raw[at:]])


def _apply(digest: bool):
    def fn(ids, texts, covers):
        size, runs, kept = [], [], []
        for text, cover in zip(texts, covers):
            raw = _bytes(text).tobytes()
            r, k = _cut(raw, cover)
            size.append(len(raw))
            runs.append(r)
            kept.append(hashlib.sha256(k).hexdigest() if digest else k)
        if digest:
            return ids, size, [sum(b - a for a, b in r) for r in runs], [len(r) for r in runs], kept
        return ids, size, [[a for a, _ in r] for r in runs], [[b for _, b in r] for r in runs], kept

    return fn


def _row_id() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("__rid")


def _texts_with(texts: DataFrame, wanted: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(text, wanted) of the texts in which something is wanted, each once where rows repeat; wanted: __rid, codes."""
    packed = materialize(wanted.groupBy(F.col("__rid").alias("__want")).agg(F.collect_list("code").alias("wanted")), "wanted")
    size = packed.select(F.sum(8 * F.size("wanted") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        return texts.join(F.broadcast(packed), texts["__rid"] == packed["__want"])
    return texts.join(packed, texts["__rid"] == packed["__want"]).dropDuplicates(["__rid"])


def repeated_cover(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, sort_rows: int = SORT_ROWS, hot: int = HOT) -> DataFrame:
    """(__rid, __cover array<struct<lo,hi>>): bytes of each row of docs that repeated strings cover."""
    spark = docs.sparkSession
    texts = docs.where(F.octet_length("text") >= LENGTH).select(_row_id(), "text")
    size = texts.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    segments = bloom.segments_for(size * 2 // (REACH + 2))
    bound_batches(spark)
    filters = bloom.twice_seen(texts.select("text"), _core_hashes, segments)
    schema = "__rid long, core long, around long, places array<long>, after long"
    if bloom.filter_bytes(segments) <= broadcast_bytes:
        found = map_columns(texts, ["__rid", "text"], functools.partial(_suspects, bloom.broadcast(filters, segments), segments), schema)
    else:
        found = bloom.at_segments(map_columns(texts, ["__rid", "text"], functools.partial(_suspects, None, segments), schema + ", segment int, residual int"), filters)
    found = materialize(found, "anchors")  # places of equal surroundings in one text share a row
    cores = found.groupBy("core").agg(F.sum(F.size("places")).alias("n"), F.count("*").alias("rows"), (F.min("around") != F.max("around")).alias("mixed")).where("n > 1").select("core", "mixed", "rows")
    cores = materialize(cores, "cores")
    found = materialize(join_hot(found, cores, ["core"], cores.where(F.col("rows") > hot)), "repeats")
    whole = found.where("not mixed").select("__rid", "after", F.explode("places").alias("at")).select("__rid", F.greatest(F.col("at") - REACH, F.lit(0)).alias("lo"), (F.col("at") + F.col("after")).alias("hi"))
    mixed = found.where("mixed").drop("mixed", "after")
    one = mixed.groupBy("core", "around").agg(F.min(F.struct("__rid", F.col("places")[0].alias("at"))).alias("one"), F.sum(F.size("places")).alias("n"), F.count("*").alias("same"), F.first("rows").alias("rows"))
    one = materialize(one.select("core", "around", "one.__rid", (2 * F.col("one.at") + (F.col("n") > 1).cast("int")).alias("code"), "n", "same", "rows"), "surroundings")
    small, large = one.where(F.col("rows") <= sort_rows), one.where(F.col("rows") > sort_rows)
    contexts = map_columns(_texts_with(texts, small, broadcast_bytes), ["text", "wanted"], _surroundings, "core long, around long, many boolean, before int, context binary")
    tasks = max(1, -(-small.count() * (REACH + LENGTH) // SORT_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = contexts.repartition(tasks, "core").mapInPandas(_sort_partition, "core long, around long, lo long, hi long")
    if not large.isEmpty():
        ranges = ranges.unionByName(_counted(map_columns(_texts_with(texts, large, broadcast_bytes), ["text", "wanted"], _strings_around, "core long, around long, many boolean, back array<int>, h array<long>"), hot))
    ranges = ranges.groupBy("core", "around").agg(F.max("lo").alias("l"), F.max("hi").alias("h"))
    partly = join_hot(mixed, ranges, ["core", "around"], one.where(F.col("same") > hot)).select("__rid", F.explode("places").alias("at"), "l", "h").select("__rid", (F.col("at") - F.col("l")).alias("lo"), (F.col("at") + F.col("h")).alias("hi"))
    return whole.unionByName(partly).distinct().groupBy("__rid").agg(F.collect_list(F.struct("lo", "hi")).alias("__cover"))


def _with_cover(docs: DataFrame, broadcast_bytes: int) -> DataFrame:
    cover = repeated_cover(docs, broadcast_bytes).withColumnRenamed("__rid", "__row")
    own = docs.select("doc_id", "text", _row_id())
    return own.join(cover, own["__rid"] == cover["__row"], "left")


def remove_repeats(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_bytes, starts, stops (removed runs), kept (remaining bytes) for each row of docs.

    Every row counts as a text of its own, so a repeated row of LENGTH bytes or
    more loses all of them. Null and shorter texts lose nothing unless they
    hold a repeated string, which needs LENGTH bytes. Ids may be null.
    """
    return map_columns(_with_cover(docs, broadcast_bytes), ["doc_id", "text", "__cover"], functools.partial(_apply, False), "doc_id long, n_bytes long, starts array<long>, stops array<long>, kept binary")


def remove_repeats_digest(docs: DataFrame) -> DataFrame:
    """remove_repeats reduced in the same task to counts and the SHA-256 of the remaining bytes."""
    return map_columns(_with_cover(docs, BROADCAST_BYTES), ["doc_id", "text", "__cover"], functools.partial(_apply, True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
