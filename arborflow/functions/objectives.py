"""Objectives: gradients and transforms as column expressions over y and a margin."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborflow.operators.layout import hash_number

LEAST_H = 1e-16


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(margins: Column) -> Column:
    """Of an ARRAY<DOUBLE>, shifted by its maximum."""
    e = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda v: v / total)


def argmax(margins: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(margins, F.array_max(margins)) - 1).cast("double")


@dataclasses.dataclass(frozen=True)
class Objective:
    """gradient(y, margins, class, constant_h) -> (g, h); transform and label map the margins array."""

    gradient: Callable[[Column, Column, int, float], tuple[Column, Column]]
    transform: Callable[[Column], Column]
    label: Callable[[Column], Column]
    metric: str


def _squared(y, margins, k, constant_h):
    return margins[0] - y, F.lit(constant_h or 1.0)


def _logistic(y, margins, k, constant_h):
    p = sigmoid(margins[0])
    return p - y, F.greatest(p * (1 - p), F.lit(LEAST_H)) if not constant_h else F.lit(constant_h)


def _softmax(y, margins, k, constant_h):
    p = softmax(margins)[k]
    h = F.lit(constant_h) if constant_h else F.greatest(2 * p * (1 - p), F.lit(LEAST_H))
    return p - F.when(y == k, 1.0).otherwise(0.0), h


_first = lambda m: m[0]
_positive = lambda m: F.when(m[0] > 0, 1.0).otherwise(0.0)

OBJECTIVES: dict[str, Objective] = {
    "reg:linear": Objective(_squared, _first, _first, "rmse"),
    "reg:logistic": Objective(_logistic, lambda m: sigmoid(m[0]), lambda m: sigmoid(m[0]), "rmse"),
    "binary:logistic": Objective(_logistic, lambda m: sigmoid(m[0]), _positive, "error"),
    "multi:softmax": Objective(_softmax, argmax, argmax, "macc"),
    "multi:softprob": Objective(_softmax, softmax, argmax, "macc"),
    "rank:pairwise": Objective(None, _first, _first, "map"),
    "rank:ndcg": Objective(None, _first, _first, "ndcg"),
}


def register(name: str, objective: Objective) -> None:
    """Add an objective of one's own."""
    OBJECTIVES[name] = objective


def needs_groups(name: str) -> bool:
    return name.startswith("rank:")


def rank_gradients(rows: DataFrame, ndcg: bool = False, seed: int = 0) -> DataFrame:
    """(row_id, g, h) of LambdaRank over rows (row_id, group_id, y, margin).

    Within a group each row meets one row of another label, drawn evenly from all
    of them: in order of labels a row's own label fills one run of places, so a
    number below the count of the others, taken from the row's hash, names a
    place outside that run, and an equi-join finds who stands there. A group
    costs a sort, whatever its size and labels. The pair pushes the better row
    up and the other down by |delta| / (1 + exp(s_hi - s_lo)). A row whose group
    has one label gets zeros.
    """
    by, alike = Window.partitionBy("group_id"), Window.partitionBy("group_id", "y")
    gain = lambda y: F.pow(F.lit(2.0), y) - 1
    discount = lambda r: F.log2(r + 2.0)
    up = by.orderBy("y", "row_id")
    placed = rows.select("row_id", "group_id", "y", "margin", (F.row_number().over(up) - 1).alias("place"), (F.rank().over(by.orderBy("y")) - 1).alias("start"), F.count("*").over(alike).alias("same"), F.count("*").over(by).alias("n"))
    if ndcg:
        placed = placed.withColumn("rank", F.row_number().over(by.orderBy(F.desc("margin"), "row_id")) - 1)
        ideal = F.row_number().over(by.orderBy(F.desc("y"), "row_id")) - 1
        placed = placed.withColumn("ideal", ideal).withColumn("idcg", F.sum(gain(F.col("y")) / discount(F.col("ideal"))).over(by)).drop("ideal")
    else:
        placed = placed.withColumns({"rank": F.lit(0), "idcg": F.lit(1.0)})
    drawn = F.pmod(hash_number(seed, F.col("row_id")), F.col("n") - F.col("same"))
    met = F.when(drawn < F.col("start"), drawn).otherwise(drawn + F.col("same"))
    mine = placed.where("n > same").select("group_id", met.cast("int").alias("place"), "idcg", F.struct("row_id", "y", "margin", "rank").alias("me"))
    others = placed.where("n > same").select("group_id", "place", F.struct("row_id", "y", "margin", "rank").alias("other"))
    pairs = mine.join(others, ["group_id", "place"])
    above = F.col("me.y") > F.col("other.y")
    hi, lo = F.when(above, F.col("me")).otherwise(F.col("other")), F.when(above, F.col("other")).otherwise(F.col("me"))
    pairs = pairs.select("idcg", hi.alias("hi"), lo.alias("lo"))
    rho = 1 / (1 + F.exp(F.col("hi.margin") - F.col("lo.margin")))
    swap = F.abs((gain(F.col("hi.y")) - gain(F.col("lo.y"))) * (1 / discount(F.col("hi.rank")) - 1 / discount(F.col("lo.rank"))))
    delta = F.when(F.col("idcg") == 0, 0.0).otherwise(swap / F.col("idcg")) if ndcg else F.lit(1.0)
    push = pairs.select("hi.row_id", "lo.row_id", (delta * rho).alias("l"), (2 * F.greatest(delta * rho * (1 - rho), F.lit(LEAST_H))).alias("w")).toDF("hi", "lo", "l", "w")
    both = push.select(F.explode(F.array(F.struct(F.col("hi").alias("row_id"), (-F.col("l")).alias("g"), F.col("w").alias("h")), F.struct(F.col("lo").alias("row_id"), F.col("l").alias("g"), F.col("w").alias("h")))).alias("p")).select("p.*")
    sums = both.groupBy("row_id").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return rows.select("row_id").join(sums, "row_id", "left").select("row_id", F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("h", F.lit(0.0)).alias("h"))
