"""Scoring of streams: stateless, so a model applies to a streaming frame as it does to a table."""

from pyspark.sql import DataFrame

from arborflow.plans.predict import predict
from arborflow.plans.trainer import Forest


def score_stream(rows: DataFrame, forest: Forest) -> DataFrame:
    """predict over a streaming frame (row_id, features); it needs no state and no watermark."""
    return predict(rows, forest)
