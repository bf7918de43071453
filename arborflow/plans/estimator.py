"""Estimators with fit, predict and cv over DataFrames, and the entry points by configuration."""

from __future__ import annotations

import statistics

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborflow.functions.metrics import evaluate
from arborflow.functions.objectives import OBJECTIVES, needs_groups
from arborflow.operators import layout, partition
from arborflow.params import Params, parse_config
from arborflow.plans import predict as P
from arborflow.plans.trainer import Forest, binned, boost_parties, checked, propose_party_cuts, train
from arborflow.plans.vertical import train_vertical
from arborflow.sources import model, text


class BoostedModel:
    """Settings by keyword, as in Params."""

    defaults: dict = {}

    def __init__(self, **settings):
        self.params = Params(**({"max_bins": 255, "seed": 36, "partition": True} | self.defaults | settings))
        self.forest: Forest | list[Forest] | None = None

    def _dealt(self, rows: DataFrame) -> DataFrame:
        p = self.params
        if "party_id" in rows.columns or not p.partition or p.mode in ("centralized", "vertical"):
            return rows
        return partition.horizontal(rows, p.n_parties, p.seed)

    def fit(self, rows: DataFrame) -> BoostedModel:
        """rows: row_id, y, features, and group_id for ranking."""
        self.forest = train(self._dealt(rows), self.params)
        self.params = self.forest[0].params if isinstance(self.forest, list) else self.forest.params
        return self

    def _one(self) -> Forest:
        if self.forest is None:
            raise ValueError("fit or load a model first")
        return self.forest[0] if isinstance(self.forest, list) else self.forest

    def party_scores(self, rows: DataFrame, metric: str | None = None) -> list[float]:
        """The metric of every forest on rows: one for each party after a solo training, else one."""
        return [P.score(rows, f, metric) for f in (self.forest if isinstance(self.forest, list) else [self._one()])]

    def predict(self, rows: DataFrame) -> DataFrame:
        """By the one forest; after a solo training by that of party 0 (party_scores has all)."""
        return P.predict(rows, self._one())

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        return P.predict_probabilities(rows, self._one())

    def predict_leaf(self, rows: DataFrame) -> DataFrame:
        return P.predict_leaves(rows, self._one())

    def score(self, rows: DataFrame, metric: str | None = None) -> float:
        return P.score(rows, self._one(), metric)

    def save_model(self, spark: SparkSession, path: str) -> None:
        model.save_model(spark, self._one(), path)

    def load_model(self, spark: SparkSession, path: str) -> BoostedModel:
        self.forest = model.load_model(spark, path)
        self.params = self.forest.params
        return self

    def cv(self, rows: DataFrame, nfold: int = 5, seed: int = 0) -> dict[str, float]:
        """Mean and deviation over folds by hash: accuracy of classifiers, rmse of the others.

        Centralized folds grow side by side, each as a party that holds the other
        folds' rows, so the jobs of a round are the same for any number of folds.
        """
        fold, p = F.pmod(layout.hash_rank(seed), F.lit(nfold)), self.params
        name, values = ("accuracy" if p.objective.startswith(("binary", "multi")) else "rmse"), []
        together = p.mode == "centralized" and p.privacy == "none" and not needs_groups(p.objective)
        forests = self._fold_forests(rows, fold, nfold) if together else None
        for k in range(nfold):
            forest = forests[k] if together else train(self._dealt(rows.where(fold != k)), p)
            got = P.predict(rows.where(fold == k), forest[0] if isinstance(forest, list) else forest)
            if name == "accuracy":
                values.append(got.agg(F.avg(F.when(F.col("label") == F.col("y"), 1.0).otherwise(0.0))).first()[0])
            else:
                values.append(evaluate(got, "rmse"))
        return {name: statistics.fmean(values), f"{name}_std": statistics.pstdev(values)}

    def _fold_forests(self, rows: DataFrame, fold: Column, nfold: int) -> list[Forest]:
        """A forest for each fold, of the rows of all others."""
        params = checked(rows, self.params).replace(n_parties=nfold)
        others = F.filter(F.sequence(F.lit(0), F.lit(nfold - 1)), lambda k: k != fold)
        given = layout.reorder_labels(rows) if params.reorder_label else rows
        dealt = given.drop("party_id").withColumn("party_id", F.explode(others))
        cuts = propose_party_cuts(dealt, max(params.n_features, layout.width(rows)), params)
        return boost_parties(binned(dealt, cuts, by_party=True), params, cuts)[0]


class BoostedClassifier(BoostedModel):
    defaults = {"objective": "binary:logistic"}


class BoostedRegressor(BoostedModel):
    defaults = {"objective": "reg:linear"}


class BoostedRanker(BoostedModel):
    defaults = {"objective": "rank:ndcg"}


def _load(spark: SparkSession, params: Params, where: str) -> DataFrame | list[DataFrame]:
    """Rows of one file or of one for each party; in a vertical run of several files, the parts of the same rows that parties hold."""
    paths = [p.strip() for p in where.split(",") if p.strip()]
    reader = text.read_csv if paths[0].endswith(".csv") else text.read_libsvm
    groups = needs_groups(params.objective)
    if params.mode == "vertical" and len(paths) > 1:
        parts = [reader(spark, p) for p in paths]
        if groups:
            parts[0] = text.assign_groups(parts[0], text.read_groups(spark, paths[0] + ".group"))
        return parts
    rows = text.read_parties(spark, paths, reader, groups)
    return rows if len(paths) > 1 else rows.drop("party_id")


def train_from_config(spark: SparkSession, config: str, rows: DataFrame | None = None, **overrides) -> tuple[Forest | list[Forest], DataFrame]:
    """(forest, metric log) of a configuration; the model goes to model_path, those of a solo or hybrid run to model_path-0 and on.

    In a vertical run several files are parts of the same rows, which are never joined wide; otherwise each file is a party's rows.
    """
    params = parse_config(config, **overrides)
    rows = _load(spark, params, params.data) if rows is None else rows
    if isinstance(rows, list):
        forest = train_vertical(rows, params.replace(n_parties=len(rows)), watch=True)[0]
    else:
        if params.partition and "party_id" not in rows.columns and params.mode not in ("centralized", "vertical"):
            rows = partition.horizontal(rows, params.n_parties, params.seed)
        forest = train(rows, params, watch=True)
    for k, f in enumerate(forest if isinstance(forest, list) else [forest]):
        model.save_model(spark, f, params.model_path + (f"-{k}" if isinstance(forest, list) else ""))
    return forest, model.metric_log(spark, forest)


def predict_from_config(spark: SparkSession, config: str, rows: DataFrame | None = None, **overrides) -> tuple[DataFrame, float | None]:
    """(predictions, metric if labelled) of the saved model; predictions go to pred_output if that is set."""
    params = parse_config(config, **overrides)
    forest = model.load_model(spark, params.model_path)
    rows = rows if rows is not None else _load(spark, forest.params, params.test_data or params.data)
    out = P.predict_vertical(rows, forest, forest.widths) if isinstance(rows, list) else P.predict(rows, forest)
    if params.pred_output:
        model.write_predictions(out, params.pred_output, "label" if OBJECTIVES[forest.params.objective].metric in ("error", "macc") else "prediction")
    labelled = "y" in out.columns and not out.where(F.col("y").isNotNull()).isEmpty()
    return out, evaluate(out, OBJECTIVES[forest.params.objective].metric) if labelled else None
