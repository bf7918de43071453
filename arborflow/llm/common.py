"""What the operators share: the shared folder, Arrow batch mapping, table reading."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arborflow.workers import ensure_importable

#: Rows that cross to Python at once; long texts make larger batches costly.
ROWS_PER_BATCH = 512
#: Rows of one key beyond which the key is hot: such keys are few, at most one for each HOT rows.
HOT = 100_000
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine that has none (`local` master) gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="arborflow-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, computes once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.partitionBy(*partition_by).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one, as a URI, for files that are not tables; deleted at exit."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that is no longer needed."""
    spark = df.sparkSession
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for entry in [e for e in _written if any(e[1].split(":", 1)[-1].lstrip("/") in r for r in roots)]:
        _delete(*entry)
        _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(_clean)


def fresh(name: str, df: DataFrame) -> str:
    """name, with underscores behind it until no column of df is called so (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_hot(rows: DataFrame, table: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    """Inner join of rows with table, which has each key once. hot: the keys with very many rows, at most one for each HOT rows; their part of the table is broadcast, so they gather nowhere."""
    on = list(on)
    tagged = rows.join(F.broadcast(hot.select(*on, F.lit(True).alias("__hot"))), on, "left")
    few = table.join(F.broadcast(hot.select(*on)), on, "left_semi")
    spread = tagged.where("__hot").drop("__hot").join(F.broadcast(few), on)
    return spread.unionByName(tagged.where("__hot is null").drop("__hot").join(table, on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id written as text, mod n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % n, F.lit(-1))


def bound_batches(spark: SparkSession) -> None:
    """Let at most ROWS_PER_BATCH rows cross to Python at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def map_columns(df: DataFrame, cols: Sequence[str | Column], make: Callable[[], Callable], schema: str) -> DataFrame:
    """Map Arrow batches through make()(*column lists) -> output column lists; make() runs once a task."""
    spark = df.sparkSession
    ensure_importable(spark)
    bound_batches(spark)
    struct = T._parse_datatype_string(schema)
    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if not b.num_rows:
                continue
            out = fn(*[c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(out, target)], schema=target)

    return df.select(*cols).mapInArrow(run, struct)
