"""Nearest neighbours by an inverted file of centroids with product-quantised residuals.

Vectors are scaled to unit length and equal rows kept once, with the least ids
of each. Centroids and codebooks are fitted on a bounded sample; every vector
is coded into its list. A query probes its nearest lists, ranks their codes by
asymmetric distance tables, and the best are ranked exactly, by cosine in
double precision on the original vectors. What that finds bounds the search:
a second look goes to every list that may hold a nearer vector, judged by the
list's radius, and there to every code that may be one, judged by the error of
its code. So no nearest vector is missed, whatever the vectors look like.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborflow.llm.common import materialize

#: Distinct vectors used for fitting at most, those of least hash.
FIT_ROWS = 20_000
SUBSPACES, CODES = 16, 256
#: Share of the lists that a query probes first, and its least number; codes of a list block that then get an exact look, for each query. They set the bounds, not the result.
PROBE_SHARE, PROBE_LEAST, RERANK = 0.1, 8, 24
#: Rounding allowed for in bounds of distances between unit vectors, and in cosines by matrix product.
FAR_SLACK, COS_SLACK = 1e-6, 1e-12
#: Distances held at once in one task, and pairs of vectors.
CELLS, PAIRS = 1 << 21, 1 << 15
#: Vectors of one list, and queries that probe it, that one task holds; more are cut by hash into blocks.
BLOCK, QUERIES = 20_000, 4_096


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 11) -> np.ndarray:
    """At most k centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c * c).sum(axis=1) - 2 * x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


@dataclasses.dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]  # by subspace: codes x width
    cuts: list[slice]

    @property
    def probes(self) -> int:
        return min(len(self.centroids), max(PROBE_LEAST, int(np.ceil(PROBE_SHARE * len(self.centroids)))))

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance from the list's centroid, distance from what the codes say) of unit vectors."""
        near = nearest(unit, self.centroids)
        left = unit - self.centroids[near]
        codes = np.stack([nearest(left[:, s], b) for s, b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)
        told = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)
        return near, codes, np.sqrt((left**2).sum(axis=1)), np.sqrt(((left - told) ** 2).sum(axis=1))

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """queries x codes: squared distances from asymmetric tables of the queries' residuals in list `at`."""
        left = queries - self.centroids[at]
        out = np.zeros((len(queries), len(codes)))
        for k, (s, b) in enumerate(zip(self.cuts, self.books)):
            table = (left[:, s] ** 2).sum(axis=1)[:, None] - 2 * left[:, s] @ b.T + (b * b).sum(axis=1)
            out += table[:, codes[:, k]]
        return out


def fit_index(unit: np.ndarray) -> Index:
    lists = int(np.clip(np.sqrt(len(unit)), 1, 256))
    centroids = kmeans(unit, lists)
    left = unit - centroids[nearest(unit, centroids)]
    width = unit.shape[1]
    edges = np.unique(np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int))
    cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
    return Index(centroids, [kmeans(left[:, s], CODES, 8) for s in cuts], cuts)


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of query, or of its row for each row, and each row, in double precision on the given components."""
    return (rows * query).sum(axis=-1) / (np.sqrt((rows * rows).sum(axis=-1)) * np.sqrt((query * query).sum(axis=-1)))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<double>) of the rows that take part: not null, not zero, every component finite."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull()).select("vec_id", x.alias("x")).where(F.col("x").isNotNull() & ~bad & F.exists("x", lambda v: v != 0))


def _unit(x) -> np.ndarray:
    a = np.stack(x.to_numpy() if isinstance(x, pd.Series) else x).astype(float)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def _code(index: Index, frames):
    for f in frames:
        if len(f):
            at, codes, off, miss = index.encode(_unit(f["x"]))
            yield pd.DataFrame({"list": at, "codes": [c.tobytes() for c in codes], "off": off, "miss": miss, "rep": f["rep"], "ids": f["ids"], "x": f["x"]})


def _to_centroids(index: Index, unit: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip((unit**2).sum(axis=1)[:, None] + (index.centroids**2).sum(axis=1) - 2 * unit @ index.centroids.T, 0, None))


def _portions(index: Index, frames):
    """The frames in pieces that give at most about PAIRS rows, were each row to meet every list."""
    step = max(1, PAIRS // len(index.centroids))
    for f in frames:
        for at in range(0, len(f), step):
            yield f.iloc[at : at + step]


def _probe(index: Index, frames):
    """The nearest lists of each query."""
    for f in _portions(index, frames):
        lists = np.argsort(_to_centroids(index, _unit(f["x"])), axis=1, kind="stable")[:, : index.probes]
        yield pd.DataFrame({"list": lists.ravel(), "query_id": np.repeat(f["vec_id"].to_numpy(), lists.shape[1]), "x": [x for x in f["x"] for _ in range(lists.shape[1])]})


def _limit(known: np.ndarray) -> np.ndarray:
    """The distance beyond which no unit vector has the cosine `known` or more; without end where none is known."""
    return np.where(np.isnan(known), np.inf, np.sqrt(np.clip(2 - 2 * known, 0, None)) + FAR_SLACK)


def _reach(index: Index, radii: np.ndarray, frames):
    """The lists that may hold a vector as near as the cosine `known` of each query."""
    for f in _portions(index, frames):
        known = f["known"].to_numpy(float)
        q, lists = np.nonzero(_to_centroids(index, _unit(f["x"])) - radii <= _limit(known)[:, None])
        yield pd.DataFrame({"list": lists, "query_id": f["vec_id"].to_numpy()[q], "x": f["x"].to_numpy()[q], "known": known[q]})


def _steps(queries: pd.DataFrame, block: pd.DataFrame):
    """(query ids, their vectors, the queries' rows) in steps of at most CELLS distances."""
    step = max(1, CELLS // len(block))
    for at in range(0, len(queries), step):
        part = queries.iloc[at : at + step]
        yield part["query_id"].tolist(), np.stack(part["x"].to_numpy()).astype(float), part


def _codes(block: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(block["codes"]), np.uint8).reshape(len(block), -1)


def _first_look(index: Index, top: int, key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """For the queries of one list block: rank the codes, then the best RERANK exactly."""
    out: list[tuple[int, int, float]] = []
    if len(queries) and len(block):
        codes, rows, ids = _codes(block), np.stack(block["x"].to_numpy()).astype(float), block["ids"].to_numpy()
        for names, x, part in _steps(queries, block):
            distance = index.distances(_unit(part["x"]), key[0], codes)
            best = np.argpartition(distance, RERANK, axis=1)[:, :RERANK] if len(block) > RERANK else np.tile(np.arange(len(block)), (len(x), 1))
            for q, v, b in zip(names, x, best):
                out += _cut([(q, int(i), c) for c, r in zip(cosines(v, rows[b]).tolist(), b) for i in ids[r] if i != q], top)
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _search(index: Index, top: int, key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """For the queries of one list block: rows whose codes may be as near as `known`, the best of them ranked exactly."""
    out: list[tuple[int, int, float]] = []
    if len(queries) and len(block):
        codes, miss = _codes(block), block["miss"].to_numpy(float)
        rows, unit, ids = np.stack(block["x"].to_numpy()).astype(float), _unit(block["x"]), block["ids"].to_numpy()
        least = np.array([i[0] for i in ids])
        for names, x, part in _steps(queries, block):
            u, known = _unit(part["x"]), part["known"].to_numpy(float)
            distance = np.sqrt(np.clip(index.distances(u, key[0], codes), 0, None))
            some = np.flatnonzero((distance - miss <= _limit(known)[:, None]).any(axis=0))
            if not len(some):
                continue
            cos = u @ unit[some].T
            floor = np.where(np.isnan(known), -np.inf, known)
            if len(some) > top + 1:  # one more than the query's own vector may use up
                floor = np.maximum(floor, np.partition(cos, -top - 1, axis=1)[:, -top - 1])
            q, r = np.nonzero(cos >= floor[:, None] - COS_SLACK)
            r = some[r]
            score = np.concatenate([cosines(x[q[i : i + PAIRS]], rows[r[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)] or [np.zeros(0)])
            order = np.lexsort((least[r], -score, q))
            place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
            order = order[place <= top]
            out += _cut([(names[a], int(i), c) for a, b, c in zip(q[order], r[order], score[order].tolist()) for i in ids[b] if i != names[a]], top)
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _cut(rows: list, top: int) -> list:
    """The first `top` of each query."""
    kept, seen = [], {}
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        if seen.get(r[0], 0) < top:
            seen[r[0]] = seen.get(r[0], 0) + 1
            kept.append(r)
    return kept


def nearest_neighbours(vectors: DataFrame, query_modulus: int = 50, top: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest of each query (vec_id divisible by query_modulus).

    Vectors that are null, zero, or hold null or non-finite components take no
    part; of repeated rows of one vec_id one does; vectors of another length
    than the most common take no part. Fewer candidates give fewer rows. Equal
    vectors are searched once and stand for their top + 1 least ids, so ties and
    hot vectors cost nothing more.
    """
    spark = vectors.sparkSession
    good = valid_vectors(vectors).groupBy("vec_id").agg(F.min("x").alias("x"))
    good = materialize(good, "vectors")
    width = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    good = good.where(F.size("x") == width.n)
    rank = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))  # limited before the shuffle
    least = good.withColumn("rank", rank).where(F.col("rank") <= top + 1)
    distinct = materialize(least.groupBy("x").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")
    sample = distinct.orderBy(F.xxhash64("x"), "rep").limit(FIT_ROWS).select("rep", "x").collect()
    index = fit_index(_unit([r.x for r in sorted(sample, key=lambda r: r.rep)]))
    coded = materialize(distinct.mapInPandas(functools.partial(_code, index), "list int, codes binary, off double, miss double, rep long, ids array<long>, x array<double>"), "codes")
    lists = coded.groupBy("list").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect()  # a row for each of at most sqrt(FIT_ROWS) lists
    radii = np.full(len(index.centroids), -np.inf)
    radii[[r.list for r in lists]] = [r.radius for r in lists]
    blocks = F.coalesce(*[F.when(F.col("list") == r.list, F.lit(-(-r.n // BLOCK))) for r in lists if r.n > BLOCK], F.lit(1))
    asked = good.where(F.col("vec_id") % query_modulus == 0)
    asks = max(1, -(-asked.count() // QUERIES))  # no list is probed by more than all queries
    items = coded.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    cell, order = ["list", "block", "ask"], Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def look(queries: DataFrame, search) -> DataFrame:
        queries = queries.withColumn("ask", F.pmod(F.xxhash64("query_id"), F.lit(asks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
        found = queries.groupBy(*cell).cogroup(items.groupBy(*cell)).applyInPandas(functools.partial(search, index, top), "query_id long, vec_id long, score double")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    first = look(asked.mapInPandas(functools.partial(_probe, index), "list int, query_id long, x array<double>"), _first_look)
    known = first.where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    reached = asked.join(known, "vec_id", "left").select("vec_id", "x", "known").mapInPandas(functools.partial(_reach, index, radii), "list int, query_id long, x array<double>, known double")
    return look(reached, _search).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
