"""Readers of text formats into frames (row_id, y, features ARRAY<STRUCT<fid,val>>)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborflow.operators.layout import width
from arborflow.operators.ranks import running_sum

FEATURES = "array<struct<fid:int,val:double>>"
#: Row ids that one task gives their groups.
RUN_BLOCK = 1 << 18
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _scanned(spark: SparkSession, paths: str | Sequence[str], read, make) -> DataFrame:
    """make(read(path)) of every path with __file (its place, or its name in a folder) and __at (of the part of the file)."""
    out = None
    for k, p in enumerate([paths] if isinstance(paths, str) else paths):
        one = read(p)
        one = make(one.select("*", F.struct(F.lit(k).alias("k"), F.col("_metadata.file_path").alias("path")).alias("__file"), F.col("_metadata.file_block_start").alias("__at")))
        out = one if out is None else out.unionByName(one)
    return out


def _numbered(lines: DataFrame) -> DataFrame:
    """lines (value, __file, __at) as (row_id, value): the place among all lines, in order of paths, of file names in a folder, and of places in a file.

    Spark packs parts of files in an order of its own, so ids come from a count
    by part of a file; no single task sees all rows.
    """
    tagged = lines.select("value", "__file", "__at", F.monotonically_increasing_id().alias("__m"))
    sizes = tagged.groupBy("__file", "__at").agg(F.count("*").alias("n"), F.min("__m").alias("base"))
    before = F.sum("n").over(Window.orderBy("__file", "__at").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part of a file
    starts = sizes.select("__file", "__at", "base", F.coalesce(before, F.lit(0)).alias("start"))
    return tagged.join(F.broadcast(starts), ["__file", "__at"]).select((F.col("start") + F.col("__m") - F.col("base")).alias("row_id"), "value")  # starts: a row for 128 MB of text


def read_libsvm(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """`label fid:val ...` with ids from 1; ids become 0-based and sorted.

    `#` starts a comment; blank lines are skipped; a line that begins with a pair
    is unlabelled (y null); later tokens that are not number:number are ignored.
    """
    lines = _scanned(spark, path, spark.read.text, lambda t: t.withColumn("value", F.trim(F.regexp_replace("value", "#.*$", ""))).where("value <> ''"))
    tokens = F.split("value", r"\s+")
    numbered = _numbered(lines).withColumn("tokens", tokens)
    label = F.col("tokens")[0]
    pairs = F.filter("tokens", lambda t: t.rlike(r"^[0-9]+:[^:]+$") & F.split(t, ":")[1].rlike(NUMBER))
    features = F.transform(pairs, lambda t: F.struct((F.split(t, ":")[0].cast("int") - 1).alias("fid"), F.split(t, ":")[1].cast("double").alias("val")))
    return numbered.select("row_id", F.when(label.contains(":"), None).otherwise(label.try_cast("double")).alias("y"), F.array_sort(features).alias("features"))


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with a header `id,y,...`, `id,...` (unlabelled) or `Class,...` (label first). Empty cells are missing."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    head = raw.columns
    if head[0] not in ("id", "Class"):
        raise ValueError("the header must begin with id or Class")
    labelled = head[0] == "Class" or (len(head) > 1 and head[1] == "y")
    skip = 1 if head[0] == "Class" else 2 if labelled else 1
    label = (F.col(f"`{head[0]}`") if head[0] == "Class" else F.col("y")).cast("double") if labelled else F.lit(None).cast("double")
    cells = F.array(*[F.struct(F.lit(k).alias("fid"), F.col(f"`{c}`").cast("double").alias("val")) for k, c in enumerate(head[skip:])])
    features = F.filter(cells, lambda c: c["val"].isNotNull()) if len(head) > skip else F.array().cast(FEATURES)
    if head[0] == "id":
        return raw.select(F.col("id").cast("long").alias("row_id"), label.alias("y"), features.alias("features"))
    cells = lambda t: t.select(F.struct(label.alias("y"), features.alias("features")).alias("value"), "__file", "__at")
    return _numbered(_scanned(spark, path, lambda p: spark.read.csv(p, header=True, inferSchema=False), cells)).select("row_id", "value.*")


def read_csc(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The LibSVM text as columns: (fid, row_id, val)."""
    return read_libsvm(spark, path).select("row_id", F.inline("features")).select("fid", "row_id", "val")


def from_sparse(spark: SparkSession, values: Sequence[float], row_ptr: Sequence[int], columns: Sequence[int], y: Sequence[float] | None = None) -> DataFrame:
    """A CSR matrix in memory."""
    rows = [(i, None if y is None else float(y[i]), [(int(columns[k]), float(values[k])) for k in range(row_ptr[i], row_ptr[i + 1])]) for i in range(len(row_ptr) - 1)]
    return spark.createDataFrame(rows, f"row_id long, y double, features {FEATURES}")


def from_columns(df: DataFrame, row_id: str, y: str | None, features: Sequence[str], zero_as_missing: bool = False) -> DataFrame:
    """Columns of a table as features, in the given order; nulls (and zeros, if asked) are missing."""
    value = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0)) if zero_as_missing else F.col(c).cast("double")
    cells = F.array(*[F.struct(F.lit(k).alias("fid"), value(c).alias("val")) for k, c in enumerate(features)])
    return df.select(F.col(row_id).cast("long").alias("row_id"), (F.col(y).cast("double") if y else F.lit(None).cast("double")).alias("y"), F.filter(cells, lambda c: c["val"].isNotNull()).alias("features"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """A file of run lengths as (group_id, start, stop): rows start <= row_id < stop belong together."""
    runs = _numbered(_scanned(spark, path, spark.read.text, lambda t: t)).select("row_id", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "n")).where("n <> ''")
    runs = runs.select("row_id", "at", F.col("n").cast("long").alias("n"), F.lit(1).alias("one"))
    numbered = running_sum(running_sum(runs, "row_id", "one", ["at"], "group_id"), "row_id", "n", ["at"], "start")
    return numbered.select("group_id", "start", (F.col("start") + F.col("n")).alias("stop"))


def assign_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with group_id, by the run that holds row_id; null outside all runs.

    Runs are cut at multiples of RUN_BLOCK, and within a block each row takes the
    last run that starts at or before it: one exchange, and no pairs.
    """
    block = lambda c: F.floor(c / RUN_BLOCK).cast("long")
    first, last = block(F.col("start")), block(F.col("stop") - 1)
    cut = groups.where("stop > start").select("group_id", "start", "stop", F.explode(F.sequence(first, last)).alias("__block"))
    starts = cut.select("__block", F.greatest("start", F.col("__block") * RUN_BLOCK).alias("__at"), F.lit(0).alias("__row"), F.struct("group_id", "stop").alias("__run"), F.lit(None).cast(rows.schema).alias("__data"))
    data = rows.select(block(F.col("row_id")).alias("__block"), F.col("row_id").alias("__at"), F.lit(1).alias("__row"), F.lit(None).cast(starts.schema["__run"].dataType).alias("__run"), F.struct(*rows.columns).alias("__data"))
    order = Window.partitionBy("__block").orderBy("__at", "__row")
    found = starts.unionByName(data).withColumn("__run", F.last("__run", ignorenulls=True).over(order)).where("__row = 1")
    inside = F.when(F.col("__at") < F.col("__run.stop"), F.col("__run.group_id"))
    return found.select("__data.*", inside.alias("group_id"))


def read_parties(spark: SparkSession, paths: Sequence[str], reader=read_libsvm, groups: bool = False) -> DataFrame:
    """One file for each party, tagged party_id. Ids of rows (and of groups, from `<path>.group`) go on where the file before ended."""
    out, rows_before, groups_before = None, 0, 0
    for k, p in enumerate(paths):
        frame = reader(spark, p)
        if groups:
            frame = assign_groups(frame, read_groups(spark, p + ".group"))
            frame = frame.withColumn("group_id", F.col("group_id") + F.lit(groups_before))
        frame = frame.withColumn("row_id", F.col("row_id") + F.lit(rows_before)).withColumn("party_id", F.lit(k))
        top = frame.agg(F.max("row_id").alias("row"), *([F.max("group_id").alias("group")] if groups else [])).first()
        rows_before = rows_before if top.row is None else top.row + 1
        groups_before = top.group + 1 if groups and top.group is not None else groups_before
        out = frame if out is None else out.unionByName(frame)
    return out


def join_parties(parts: Sequence[DataFrame], widths: Sequence[int]) -> DataFrame:
    """Features that parties hold apart as one table: rows that all parties have, by row_id, y from the first party that knows it, features shifted past those of the parties before."""
    out, offset = None, 0
    for k, (part, n) in enumerate(zip(parts, widths)):
        moved = F.transform("features", lambda c: F.struct((c["fid"] + F.lit(offset)).cast("int").alias("fid"), c["val"].alias("val")))  # noqa: B023  called at once
        label = F.col("y") if "y" in part.columns else F.lit(None).cast("double")
        part = part.select("row_id", label.alias(f"y{k}"), F.coalesce(moved, F.array().cast(FEATURES)).alias(f"f{k}"))
        out = part if out is None else out.join(part, "row_id")
        offset += n
    return out.select("row_id", F.coalesce(*[f"y{k}" for k in range(len(parts))]).alias("y"), F.concat(*[f"f{k}" for k in range(len(parts))]).alias("features"))


def read_vertical(spark: SparkSession, paths: Sequence[str], reader=read_libsvm, widths: Sequence[int] | None = None) -> tuple[DataFrame, list[int]]:
    """(joined table, features of each party) of one file for each party; widths: as a training run found them."""
    parts = [reader(spark, p) for p in paths]
    widths = list(widths) if widths else [width(p) for p in parts]
    return join_parties(parts, widths), widths


def concat_files(spark: SparkSession, paths: Sequence[str], reader=read_libsvm) -> DataFrame:
    """Files one after the other as one table, rows numbered through."""
    return read_parties(spark, paths, reader).drop("party_id")
