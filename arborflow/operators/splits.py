"""Gains, best splits and their selection under differential privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborflow.operators.layout import hash_number
from arborflow.operators.histogram import UNIT, missing_sums, prefix_sums


def _score(g: str, h: str, reg_lambda: float) -> str:
    """g^2 / (h + lambda), 0 where nothing is there to divide by."""
    gd, hd = f"(({g}) / {UNIT}D)", f"(({h}) / {UNIT}D + {reg_lambda!r}D)"
    return f"(CASE WHEN {hd} = 0 THEN 0.0D ELSE {gd} * {gd} / {hd} END)"


def _gain(lg: str, lh: str, rg: str, rh: str, reg_lambda: float, min_child_weight: float) -> str:
    enough = f"({lh}) / {UNIT}D >= {min_child_weight!r}D AND ({rh}) / {UNIT}D >= {min_child_weight!r}D"
    raw = f"{_score(lg, lh, reg_lambda)} + {_score(rg, rh, reg_lambda)} - {_score(f'({lg}) + ({rg})', f'({lh}) + ({rh})', reg_lambda)}"
    return f"CASE WHEN {enough} THEN greatest({raw}, 0.0D) ELSE 0.0D END"


def with_gain(hist: DataFrame, nodes: DataFrame | dict[int, tuple[int, int]], reg_lambda: float, min_child_weight: float) -> DataFrame:
    """hist with prefix, missing and node sums, and the signed gain: negative where missing rows go right.

    They go left only where that is strictly better. The formulas are SQL text,
    which is read in one call.
    """
    full = missing_sums(prefix_sums(hist), nodes)
    left = _gain("pg - rg", "ph - rh", "rg", "rh", float(reg_lambda), float(min_child_weight))
    right = _gain("pg - rg - mg", "ph - rh - mh", "rg + mg", "rh + mh", float(reg_lambda), float(min_child_weight))
    both = full.selectExpr("*", f"{left} AS gain_left", f"{right} AS gain_right")
    return both.selectExpr(*full.columns, "CASE WHEN gain_left > gain_right THEN gain_left ELSE -gain_right END AS gain")


def with_left_gain(hist: DataFrame, nodes: DataFrame, reg_lambda: float, min_child_weight: float) -> DataFrame:
    """hist with prefix and node sums, and the gain with missing rows on the left only."""
    full = missing_sums(prefix_sums(hist), nodes)
    return full.selectExpr("*", f"{_gain('pg - rg', 'ph - rh', 'rg', 'rh', float(reg_lambda), float(min_child_weight))} AS gain")


def best_splits(gains: DataFrame) -> DataFrame:
    """(nid, fid, bid, gain, default_right, rg, rh, mg, mh): the largest |gain| of each node, ties to the lowest fid, then the largest cut."""
    record = F.struct("fid", "bid", F.abs("gain").alias("gain"), (~(F.col("gain") > 0)).alias("default_right"), "rg", "rh", "mg", "mh")
    order = F.struct(F.abs("gain"), -F.col("fid"), -F.col("bid"))
    return gains.groupBy("nid").agg(F.max_by(record, order).alias("s")).select("nid", "s.*")


def private_splits(gains: DataFrame, epsilon: float, delta_g: float, seed: int) -> DataFrame:
    """best_splits by the exponential mechanism: exponents epsilon |gain| / (2 delta_g) plus Gumbel noise, which samples in proportion to exp(exponent). Who knows the seed knows the noise: training draws a secret one for each level."""
    u = (hash_number(seed, F.col("nid"), F.col("fid"), F.col("bid")) + 0.5) / float(1 << 48)
    noisy = F.abs("gain") * (epsilon / (2 * delta_g)) - F.log(-F.log(u))
    record = F.struct("fid", "bid", F.abs("gain").alias("gain"), (~(F.col("gain") > 0)).alias("default_right"), "rg", "rh", "mg", "mh")
    return gains.groupBy("nid").agg(F.max_by(record, F.struct(noisy, -F.col("fid"), -F.col("bid"))).alias("s")).select("nid", "s.*")
