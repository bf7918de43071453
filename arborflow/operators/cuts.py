"""Candidate cuts of features and binning. Cuts descend: bid 0 is the largest."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborflow.operators.layout import hash_number
from arborflow.operators.ranks import cells_of
from arborflow.workers import ensure_importable

SLACK = 1e-6
#: Distinct values of a feature beyond which one task doesn't rank them all.
LARGE = 1 << 20


def feature_range(long: DataFrame, by: tuple[str, ...] = ("fid",)) -> DataFrame:
    """(fid[, party_id], lo, hi) of present values."""
    return long.groupBy(*by).agg(F.min("val").alias("lo"), F.max("val").alias("hi"))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Global ranges from those of parties."""
    return ranges.groupBy("fid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def range_cuts(ranges: DataFrame, max_bins: int) -> DataFrame:
    """(fid, bid, cut): hi - i (hi - lo) / n for i < n. The least value is never a cut.

    n is max_bins; while a step is under SLACK the step doubles and n halves, to 1
    at least. A single value gives one cut; an infinite range none.
    """
    finite = ranges.where((F.col("hi") < float("inf")) & (F.col("lo") > float("-inf")))
    step = (F.col("hi") - F.col("lo")) / max_bins
    n = F.lit(max_bins)
    for k in range(int(math.log2(max_bins)) + 1, 0, -1):  # k halvings are needed below SLACK / 2^(k-1)
        n = F.when((step < SLACK / 2 ** (k - 1)) & (n == max_bins), max(1, max_bins >> k)).otherwise(n)
    sized = finite.withColumn("n", F.when(F.col("hi") == F.col("lo"), 1).otherwise(n).cast("int"))
    return sized.select("fid", "lo", "hi", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bid")).select("fid", "bid", (F.col("hi") - F.col("bid") * (F.col("hi") - F.col("lo")) / F.col("n")).alias("cut"))


def distinct_cuts(long: DataFrame, max_bins: int, by: tuple[str, ...] = ("fid",)) -> DataFrame:
    """(fid[, party_id], bid, cut): every floor(distinct / max_bins)-th distinct value from the largest; all if there are fewer.

    A feature's distinct values are ranked in one task up to about LARGE of them;
    those of a larger feature, of which there is at most one for each LARGE
    values, are dealt to cells of approximate quantiles first, and their places
    follow from the cells' sizes.
    """
    values = long.select(*by, "val").where("val is not null").distinct()
    large = [tuple(r)[:-1] for r in long.groupBy(*by).agg(F.approx_count_distinct("val").alias("n")).where(F.col("n") > LARGE).collect()]
    whole = Window.partitionBy(*by)
    if not large:
        ranked = values.select(*by, "val", (F.row_number().over(whole.orderBy(F.desc("val"))) - 1).alias("place"), F.count("*").over(whole).alias("n"))
        return _every_gap(ranked, max_bins, by)
    cells = cells_of(long)
    named = long.sparkSession.createDataFrame(large, values.select(*by).schema)
    bounds = values.join(F.broadcast(named), list(by)).groupBy(*by).agg(F.percentile_approx("val", [k / cells for k in range(1, cells)] or [0.5], 10 * cells).alias("bounds"))
    edges = {tuple(r)[:-1]: np.unique(r.bounds) for r in bounds.collect()}
    schema = T.StructType([*values.schema, T.StructField("cell", T.IntegerType())])
    ensure_importable(long.sparkSession)
    tagged = values.mapInArrow(functools.partial(_cells, edges, by), schema)
    sizes = tagged.groupBy(*by, "cell").count()  # a row for each feature and cell
    start = sizes.select(*by, "cell", (F.sum("count").over(whole.orderBy("cell")) - F.col("count")).alias("start"), F.sum("count").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*by, "cell").orderBy(F.desc("val"))) - 1
    ranked = tagged.withColumn("inside", inside).join(start, [*by, "cell"]).select(*by, "val", (F.col("start") + F.col("inside")).alias("place"), "n")
    return _every_gap(ranked, max_bins, by)


def _every_gap(ranked: DataFrame, max_bins: int, by: tuple[str, ...]) -> DataFrame:
    """Of values by place, the places that are multiples of the gap."""
    ranked = ranked.withColumn("gap", F.greatest(F.floor(F.col("n") / max_bins), F.lit(1)))
    kept = ranked.where((F.col("place") % F.col("gap") == 0) & ((F.col("place") / F.col("gap") < max_bins) | (F.col("n") < max_bins)))
    return kept.select(*by, (F.col("place") / F.col("gap")).cast("int").alias("bid"), F.col("val").alias("cut"))


def _cells(edges: dict, by: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the number of bounds above each value, 0 for features without bounds."""
    for b in batches:
        value = b.column("val").to_numpy(zero_copy_only=False)
        cell = np.zeros(b.num_rows, np.int32)
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in by])
        for key, own in edges.items():
            here = np.flatnonzero((keys == np.array(key)[:, None]).all(axis=0))
            cell[here] = len(own) - np.searchsorted(own, value[here], side="right")
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])


def party_sketches(long: DataFrame, k: int = 2000) -> DataFrame:
    """(party_id, fid, sketch): a KLL sketch of each party's values of a feature, a few kB whatever their number; values are not compared one by one, nor made distinct."""
    return long.where("val is not null").groupBy("party_id", "fid").agg(F.kll_sketch_agg_double("val", F.lit(k)).alias("sketch"))


def sketch_cuts(sketches: DataFrame, max_bins: int) -> DataFrame:
    """(fid, bid, cut) at even ranks of the merged sketches (party_id, fid, sketch), the largest value first.

    A cut's rank is off by about 1.7 / k of the values at most, with k of
    party_sketches, in 99 of 100 cases; sketches draw at random, so runs differ
    within that. Equal quantiles give one cut.
    """
    merged = sketches.groupBy("fid").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    ranks = F.array(*[F.lit(1 - k / max_bins) for k in range(max_bins)])
    q = merged.select("fid", F.array_distinct(F.kll_sketch_get_quantile_double("sketch", ranks)).alias("q"))
    return q.select("fid", F.posexplode(F.reverse(F.array_sort("q"))).alias("bid", "cut"))


def sample_party_cuts(party_cuts: DataFrame, max_bins: int, seed: int = 0) -> DataFrame:
    """(fid, bid, cut): the pooled distinct cuts of parties; the largest and, in hash order, others until max_bins."""
    pooled = party_cuts.select("fid", "cut").distinct()
    top = F.max("cut").over(Window.partitionBy("fid"))
    order = Window.partitionBy("fid").orderBy(F.desc("top"), hash_number(seed, F.col("fid"), F.round(F.col("cut") * 1000).cast("long")), "cut")
    kept = pooled.withColumn("top", F.col("cut") == top).withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_bins)
    bid = F.row_number().over(Window.partitionBy("fid").orderBy(F.desc("cut"))) - 1
    return kept.select("fid", bid.cast("int").alias("bid"), "cut")


def collect_cuts(cuts: DataFrame, n_features: int) -> list[list[float]]:
    """Descending cuts of each feature, on the driver: at most n_features x max_bins numbers."""
    out: list[list[float]] = [[] for _ in range(n_features)]
    for r in sorted(cuts.collect(), key=lambda r: (r.fid, r.bid)):
        out[r.fid].append(r.cut)
    return out


def bin_of(value: Column, cuts: Column) -> Column:
    """The first bin with cut - SLACK <= value; below every cut the last; null for null or without cuts."""
    above = F.size(F.filter(cuts, lambda c: c - SLACK > value))
    return F.when(value.isNull() | (F.size(cuts) == 0), None).otherwise(F.least(above, F.size(cuts) - 1)).cast("int")


def bin_long(long: DataFrame, cuts: DataFrame) -> DataFrame:
    """(row_id, fid, bid) of present values, by a join with the cuts as one array a feature."""
    arrays = cuts.groupBy("fid").agg(F.transform(F.reverse(F.array_sort(F.collect_list("cut"))), lambda c: c).alias("cuts"))
    return long.join(arrays, "fid").select("row_id", "fid", bin_of(F.col("val"), F.col("cuts")).alias("bid"))


def _bin_batches(cuts: list, keep: list[str], by: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = max(map(len, cuts), default=0) if by else len(cuts)
    flat_cuts = [c for own in cuts for c in (*own, *[[]] * (width - len(own)))] if by else cuts
    bounds = [np.array(c[::-1], float) - SLACK for c in flat_cuts]
    for b in batches:
        column = b.column("features")
        flat = column.flatten()
        fid, value = flat.field("fid").to_numpy(zero_copy_only=False), flat.field("val")
        row = np.repeat(np.arange(b.num_rows), np.diff(column.offsets.to_numpy()))
        known = np.asarray(value.is_valid()) & (fid >= 0) & (fid < width)
        fid, value, row = fid[known].astype(np.int64), value.to_numpy(zero_copy_only=False)[known], row[known]
        key = fid + width * b.column(by).to_numpy(zero_copy_only=False).astype(np.int64)[row] if by else fid
        bins = np.full((b.num_rows, width), -1, np.int32)
        order = np.argsort(key, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else ():
            own = bounds[key[part[0]]]
            n = len(own)
            if n:
                bins[row[part], fid[part]] = np.minimum(n - np.searchsorted(own, value[part], side="right"), n - 1)
        cells = pa.array(bins.reshape(-1), mask=bins.reshape(-1) < 0)
        offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.ListArray.from_arrays(offsets, cells)], [*keep, "bins"])


def bin_rows(rows: DataFrame, cuts: list, keep: list[str], by: str | None = None) -> DataFrame:
    """keep columns of rows and bins ARRAY<INT>, null where missing; no shuffle.

    Features of an Arrow batch are looked up together by binary search, so the
    cost follows the values present and not width x bins; the same as generated
    comparisons took twice the time at 6 features and 16 bins. by: one of keep,
    which numbers the cuts of a row, and cuts has a list for each number.
    """
    ensure_importable(rows.sparkSession)
    given = rows.select(*keep, F.coalesce("features", F.array().cast(rows.schema["features"].dataType)).alias("features"))
    schema = T.StructType([*(given.schema[k] for k in keep), T.StructField("bins", T.ArrayType(T.IntegerType()))])
    return given.mapInArrow(functools.partial(_bin_batches, cuts, keep, by), schema)
