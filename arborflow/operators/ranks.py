"""Places and running sums in order of a key, for any number of rows: cells of the key first, then the inside of each cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a key at most; their bounds become code.
CELLS = 256


def bucket(x: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending bounds are <= x, by halving. NaN exceeds all."""

    def walk(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]), walk(lo, mid)).otherwise(walk(mid + 1, hi))

    return walk(0, len(bounds))


def cells_of(rows: DataFrame) -> int:
    return min(CELLS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_sum(rows: DataFrame, key: str, weight: str, order: Sequence[str] = (), name: str = "before") -> DataFrame:
    """rows with `name`: the sum of weight over the rows with a smaller key, those of equal key by `order`.

    Bounds of cells are approximate quantiles of the key, read once to the
    driver, so a task sorts about one cell and only a row a cell is summed in one place.
    """
    n = cells_of(rows)
    found = rows.select(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    tagged = rows.withColumn("__cell", bucket(F.col(key), sorted(set(found))))
    sums = tagged.groupBy("__cell").agg(F.sum(weight).alias("__sum"))
    start = sums.select("__cell", (F.sum("__sum").over(Window.orderBy("__cell")) - F.col("__sum")).alias("__start"))  # a row for each cell
    inside = F.sum(weight).over(Window.partitionBy("__cell").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(weight)
    return tagged.withColumn("__in", inside).join(F.broadcast(start), "__cell").withColumn(name, F.col("__start") + F.col("__in")).drop("__cell", "__in", "__start")
