"""Scoring with a forest: nested CASE expressions for small forests, else all trees as flat arrays walked level by level over Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborflow.functions.metrics import evaluate
from arborflow.functions.objectives import OBJECTIVES, sigmoid, softmax
from arborflow.operators import layout
from arborflow.plans.flat import FlatForest, lists, used_features
from arborflow.plans.trainer import Forest
from arborflow.plans.tree import CASE_LEAVES, by_tree, by_value, node_id, weight_sql
from arborflow.plans.vertical import score_parts
from arborflow.workers import ensure_importable

#: Features beyond which CASE expressions would look up too many values.
CASE_FEATURES = 32


def _walked(flat: FlatForest, rate: float, leaves: bool, column: str, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rounds, classes = flat.roots.shape
    for b in batches:
        found = [flat.walk(len(v), functools.partial(flat.goes_right, v)) for v in flat.blocks(b, column)]
        if leaves:
            out = lists(np.concatenate([flat.nid[at].reshape(-1, rounds, classes) for at in found]) if found else np.zeros((0, rounds, classes), int), pa.int32())
        else:
            out = lists(np.concatenate([flat.margins(at, rate) for at in found]) if found else np.zeros((0, classes)), pa.float64())
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), out], [*keep, "leaves" if leaves else "margins"])


def _by_arrays(rows: DataFrame, forest: Forest, leaves: bool) -> DataFrame:
    ensure_importable(rows.sparkSession)
    column = "x" if "x" in rows.columns else "features"
    keep = [c for c in rows.columns if c != ("leaves" if leaves else "margins")]
    kind = T.ArrayType(T.ArrayType(T.IntegerType())) if leaves else T.ArrayType(T.DoubleType())
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("leaves" if leaves else "margins", kind)])
    given = rows.select(*(F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) if c == column else F.col(c) for c in keep))
    return given.mapInArrow(functools.partial(_walked, FlatForest.of(forest), forest.rate, leaves, column, keep), schema)


def _small(forest: Forest) -> bool:
    """Whether generated code stays short: few leaves, few features."""
    return sum(len(t.leaves()) for trees in forest.trees for t in trees) <= CASE_LEAVES and len(used_features(forest)) <= CASE_FEATURES


def _with_used(rows: DataFrame, forest: Forest):
    """(rows with what scoring reads, condition on values): x where rows have it, else the values of the features that splits use."""
    if "x" in rows.columns:
        return rows, by_value()
    used = used_features(forest)
    return rows.withColumn("__used", layout.values_of(F.col("features"), used)), by_value("__used", {f: k for k, f in enumerate(used)})


def margins(rows: DataFrame, forest: Forest) -> DataFrame:
    """rows (with features or x) with margins ARRAY<DOUBLE>: sums of rate x weight over rounds, by class."""
    if not _small(forest):
        return _by_arrays(rows, forest, False)
    base, values = _with_used(rows, forest)
    return base.withColumn("margins", F.expr(f"array({', '.join(_total(forest, k, values) for k in range(forest.params.classes))})")).drop("__used")


def _total(forest: Forest, k: int, values) -> str:
    return " + ".join(["0.0D", *(weight_sql(trees[k], values, forest.rate) for trees in forest.trees)])


def margins_by_party(rows: DataFrame, forests: list[Forest]) -> DataFrame:
    """rows (party_id, features) with margins in the forest of their own party, of solo and hybrid training."""
    if all(map(_small, forests)) and sum(len(t.leaves()) for f in forests for trees in f.trees for t in trees) <= CASE_LEAVES:
        used = sorted({x for f in forests for x in used_features(f)})
        base, values = rows.withColumn("__used", layout.values_of(F.col("features"), used)), by_value("__used", {f: k for k, f in enumerate(used)})
        by_class = [by_tree("party_id", len(forests), lambda p: _total(forests[p], k, values)) for k in range(forests[0].params.classes)]  # noqa: B023  called at once
        return base.withColumn("margins", F.expr(f"array({', '.join(by_class)})")).drop("__used")
    parts = [margins(rows.where(F.col("party_id") == p), f) for p, f in enumerate(forests)]
    return functools.reduce(DataFrame.unionByName, parts)


def predict(rows: DataFrame, forest: Forest) -> DataFrame:
    """rows with margins, prediction (the objective's transform) and label."""
    return _labelled(margins(rows, forest), forest)


def _labelled(rows: DataFrame, forest: Forest) -> DataFrame:
    o = OBJECTIVES[forest.params.objective]
    return rows.withColumns({"prediction": o.transform(F.col("margins")), "label": o.label(F.col("margins"))})


def predict_probabilities(rows: DataFrame, forest: Forest) -> DataFrame:
    """rows with probabilities by class."""
    m = F.col("margins")
    p = softmax(m) if forest.params.classes > 1 else F.array(1 - sigmoid(m[0]), sigmoid(m[0]))
    return margins(rows, forest).withColumn("probabilities", p)


def predict_leaves(rows: DataFrame, forest: Forest) -> DataFrame:
    """rows with leaves ARRAY<ARRAY<INT>>: the leaf of each round, by class."""
    if not _small(forest):
        return _by_arrays(rows, forest, True)
    base, values = _with_used(rows, forest)
    return base.withColumn("leaves", F.array(*[F.array(*[node_id(t, values) for t in trees]) for trees in forest.trees])).drop("__used")


def predict_vertical(parts: list[DataFrame], forest: Forest, widths: list[int]) -> DataFrame:
    """Scores (row_id, margins, prediction, label) of features that parties hold apart; no frame holds those of two parties."""
    return _labelled(score_parts(parts, forest, widths), forest)


def score(rows: DataFrame, forest: Forest, metric: str | None = None) -> float:
    """The metric of predictions on rows with y."""
    return evaluate(margins(rows, forest), metric or OBJECTIVES[forest.params.objective].metric)
