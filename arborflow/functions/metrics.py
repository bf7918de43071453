"""Metrics as aggregations over (y, margin or margins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborflow.functions.objectives import argmax
from arborflow.operators.ranks import running_sum


def rmse(rows: DataFrame) -> DataFrame:
    """One row: rmse of margin against y."""
    d = F.col("margin") - F.col("y")
    return rows.agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def auc(rows: DataFrame) -> DataFrame:
    """One row: auc with ties at their average rank; -1 if one class only.

    Scores are counted by value before they are ranked, and ranks are running
    sums over ranges of scores, so no task sorts all rows.
    """
    by_score = rows.groupBy("margin").agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("p"))
    ranked = running_sum(by_score, "margin", "n")
    rank_sum = F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2))
    p, n = F.sum("p"), F.sum("n")
    one = ranked.agg(rank_sum.alias("r"), p.alias("p"), n.alias("n"))
    pos, neg = F.col("p"), F.col("n") - F.col("p")
    return one.select(F.when((pos == 0) | (neg == 0), -1.0).otherwise((F.col("r") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: share of rows (y, margins) whose first largest margin is y's."""
    return rows.agg(F.avg(F.when(argmax(F.col("margins")) == F.col("y"), 1.0).otherwise(0.0)).alias("accuracy"))


def mean_average_precision(rows: DataFrame) -> DataFrame:
    """One row: map over groups of (group_id, row_id, y, margin); a group without hits counts 1."""
    order = Window.partitionBy("group_id").orderBy(F.desc("margin"), "row_id")
    hit = F.when(F.col("y") != 0, 1).otherwise(0)
    ranked = rows.select("group_id", hit.alias("hit"), F.row_number().over(order).alias("rank"), F.sum(hit).over(order).alias("hits"))
    ap = F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))) / F.sum("hit")
    return ranked.groupBy("group_id").agg(F.when(F.sum("hit") == 0, 1.0).otherwise(ap).alias("ap")).agg(F.avg("ap").alias("map"))


def ndcg(rows: DataFrame) -> DataFrame:
    """One row: ndcg over groups; a group whose ideal is 0 counts 1."""
    by = Window.partitionBy("group_id")
    gain = F.pow(F.lit(2.0), F.col("y")) - 1
    ranked = rows.select("group_id", gain.alias("gain"), F.row_number().over(by.orderBy(F.desc("margin"), "row_id")).alias("rank"), F.row_number().over(by.orderBy(F.desc("y"), "row_id")).alias("best"))
    sums = ranked.groupBy("group_id").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("d"), F.sum(F.col("gain") / F.log2(F.col("best") + 1.0)).alias("i"))
    return sums.agg(F.avg(F.when(F.col("i") == 0, 1.0).otherwise(F.col("d") / F.col("i"))).alias("ndcg"))


def group_offsets(rows: DataFrame) -> DataFrame:
    """(group_id, start, stop): prefix sums of group sizes."""
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("n"))
    return running_sum(sizes, "group_id", "n").select("group_id", F.col("before").alias("start"), (F.col("before") + F.col("n")).alias("stop"))


def mean_over_parties(scores: DataFrame, value: str) -> DataFrame:
    return scores.agg(F.avg(value).alias(value))


METRICS = {"rmse": (rmse, "rmse"), "error": (auc, "auc"), "auc": (auc, "auc"), "macc": (accuracy, "accuracy"), "map": (mean_average_precision, "map"), "ndcg": (ndcg, "ndcg")}


def evaluate(rows: DataFrame, metric: str) -> float:
    """The metric of rows (row_id, y, margins[, group_id]); rows without y do not count."""
    fn, name = METRICS[metric]
    given = rows.where(F.col("y").isNotNull())
    given = given if "margin" in rows.columns else given.withColumn("margin", F.col("margins")[0])
    value = fn(given).first()[name]
    return float("nan") if value is None else float(value)
