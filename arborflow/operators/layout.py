"""Row and column layouts, label mapping and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_columns(rows: DataFrame) -> DataFrame:
    """(fid, row_id, val): the long form of sparse rows."""
    return rows.select("row_id", F.inline("features")).select("fid", "row_id", "val")


def to_rows(long: DataFrame) -> DataFrame:
    """(row_id, features): the inverse of to_columns; rows without features do not come back."""
    return long.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("fid", "val"))).alias("features"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few files dealt to all cores, one of many as it is; only for plans without an exchange."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def width(rows: DataFrame) -> int:
    """Largest feature id plus one."""
    top = rows.select(F.max(F.array_max(F.transform("features", lambda c: c["fid"])))).first()[0]
    return 0 if top is None else top + 1


def dense(features: Column, n: int) -> Column:
    """ARRAY<DOUBLE> of n values, null where absent."""
    return values_of(features, range(n))


def values_of(features: Column, fids: Sequence[int]) -> Column:
    """ARRAY<DOUBLE> of the values of some features, in the order given, null where absent; of a feature's several entries the last counts."""
    if not len(fids):
        return F.array().cast("array<double>")
    return F.array(*[F.try_element_at(F.filter(features, lambda c: c["fid"] == f), F.lit(-1))["val"] for f in fids])  # noqa: B023  called at once


def with_values(rows: DataFrame, n: int) -> DataFrame:
    """rows with x, the dense array of features."""
    return rows.withColumn("x", dense(F.col("features"), n))


def subset(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose row_id is in ids."""
    return rows.join(ids.select("row_id"), "row_id", "left_semi")


def group_labels(rows: DataFrame) -> DataFrame:
    """(y, label): classes by first appearance in order of row_id."""
    first = rows.where(F.col("y").isNotNull()).groupBy("y").agg(F.min("row_id").alias("first"))
    return first.select("y", (F.row_number().over(Window.orderBy("first")) - 1).alias("label"))  # a row for each class


def reorder_labels(rows: DataFrame) -> DataFrame:
    """rows with y replaced by its class index."""
    return rows.join(F.broadcast(group_labels(rows)), "y", "left").drop("y").withColumn("y", F.col("label").cast("double")).drop("label")


def check_labels(rows: DataFrame, classes: int | None = None) -> None:
    """Refuse labels that are negative, fractional or, with classes, too large; one early-stopping job."""
    bad = (F.col("y") < 0) | (F.col("y") != F.ceil("y"))
    if classes is not None:
        bad = bad | (F.col("y") >= classes)
    row = rows.where(bad).select("row_id", "y").take(1)
    if row:
        raise ValueError(f"row {row[0].row_id} has label {row[0].y}")


def sort_columns(long: DataFrame) -> DataFrame:
    """Columns one after the other, each in descending order of value; a long column is cut into ranges, one for each task."""
    return long.repartitionByRange("fid", F.desc("val"), "row_id").sortWithinPartitions("fid", F.desc("val"), "row_id")


def hash_rank(seed: int, key: str = "row_id") -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def hash_number(seed: int, *key: Column) -> Column:
    """A number of 48 bits from the MD5 of key and seed, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key, F.lit(seed))), 1, 12), 16, 10).cast("long")


def train_test_split(rows: DataFrame, portion: float = 0.75, seed: int = 42) -> DataFrame:
    """rows with is_train: the first floor(n * portion) in hash order, found by a threshold on the hash and not by a sort of all rows."""
    n = rows.count()
    k = int(n * portion)
    if k in (0, n):
        return rows.withColumn("is_train", F.lit(k == n))
    return rows.withColumn("__h", hash_rank(seed)).withColumn("is_train", _first_k(rows, k, seed)).drop("__h")


def _first_k(rows: DataFrame, k: int, seed: int) -> Column:
    """Whether (__h, row_id) is among the k least, from counts in ever finer ranges of the hash."""
    hashed = rows.select(hash_rank(seed).alias("h"), "row_id")
    lo, hi, before = -(1 << 63), 1 << 63, 0
    while hi - lo > 1:
        step = max(1, (hi - lo) >> 8)
        inside = hashed.where((F.col("h") >= lo) & (F.col("h") <= hi - 1))
        counts = {int(r.b): r.n for r in inside.groupBy(F.expr(f"cast((cast(h as decimal(38,0)) - {lo}) div {step} as bigint)").alias("b")).agg(F.count("*").alias("n")).collect()}
        for b in sorted(counts):
            if before + counts[b] >= k:
                lo, hi = lo + b * step, min(hi, lo + (b + 1) * step)
                break
            before += counts[b]
        if before + counts[b] == k:
            return F.col("__h") <= hi - 1
        if counts[b] <= 100_000:
            rest = sorted((r.h, r.row_id) for r in hashed.where((F.col("h") >= lo) & (F.col("h") <= hi - 1)).collect())
            h, row = rest[k - before - 1]
            return (F.col("__h") < h) | ((F.col("__h") == h) & (F.col("row_id") <= row))
    return F.col("__h") <= hi - 1
