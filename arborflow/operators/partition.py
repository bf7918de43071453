"""Simulated federations: which party owns which rows and features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborflow.operators.layout import hash_rank

#: Resolution of proportions: hashes fall into this many cells.
CELLS = 1 << 20


def dirichlet(alpha: float, n: int, seed: int) -> list[float]:
    """Proportions of n parts."""
    return np.random.default_rng(seed).dirichlet([alpha] * n).tolist()


def stride_owner(place: Column, total: int, n_parties: int) -> Column:
    """Equal strides of total places; the last party takes the remainder."""
    return F.least(F.floor(place / max(1, total // n_parties)), F.lit(n_parties - 1)).cast("int")


def horizontal(rows: DataFrame, n_parties: int, seed: int = 42) -> DataFrame:
    """rows with party_id: hash cells in equal strides, so parties' sizes are equal up to sampling and every row is kept."""
    return rows.withColumn("party_id", stride_owner(_cell(seed), CELLS, n_parties))


def horizontal_by_key(rows: DataFrame, n_parties: int, key: str = "row_id") -> DataFrame:
    """rows with party_id = key mod n_parties."""
    return rows.withColumn("party_id", F.pmod(F.col(key), F.lit(n_parties)).cast("int"))


def vertical_owner(n_features: int, n_parties: int) -> list[int]:
    """Party of each feature: contiguous strides, not shuffled, the last with the remainder. Party 0 holds the labels."""
    stride = max(1, n_features // n_parties)
    return [min(f // stride, n_parties - 1) for f in range(n_features)]


def vertical(long: DataFrame, n_features: int, n_parties: int) -> DataFrame:
    """(fid, row_id, val) with party_id and local_fid."""
    stride = max(1, n_features // n_parties)
    party = stride_owner(F.col("fid"), n_features, n_parties)
    return long.withColumn("party_id", party).withColumn("local_fid", F.col("fid") - F.col("party_id") * stride)


def _cell(seed: int, key: str = "row_id") -> Column:
    return F.pmod(hash_rank(seed, key), F.lit(CELLS))


def _by_shares(cell: Column, shares: list[float]) -> Column:
    edges = (np.cumsum(shares)[:-1] * CELLS).tolist()
    out = F.lit(len(shares) - 1)
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(cell < edges[k], k).otherwise(out)
    return out.cast("int")


def heterogeneous(rows: DataFrame, n_parties: int, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """rows with party_id in Dirichlet(alpha) proportions."""
    return rows.withColumn("party_id", _by_shares(_cell(seed), dirichlet(alpha, n_parties, seed)))


def heterogeneous_features(n_features: int, n_parties: int, alpha: float = 1.0, seed: int = 42) -> list[int]:
    """Party of each feature, in Dirichlet(alpha) proportions over shuffled features."""
    order = np.random.default_rng(seed).permutation(n_features)
    edges = np.floor(np.cumsum(dirichlet(alpha, n_parties, seed)) * n_features)
    owner = np.empty(n_features, int)
    owner[order] = np.minimum(np.searchsorted(edges, np.arange(n_features), side="right"), n_parties - 1)
    return owner.tolist()


def blocks(long: DataFrame, n_features: int, n_parties: int, part_length: int, part_width: int, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """(fid, row_id, val) with party_id: part_length x part_width blocks of cells dealt in Dirichlet proportions."""
    across = max(1, -(-n_features // part_width))
    block = F.pmod(hash_rank(seed), F.lit(part_length)) * across + F.floor(F.col("fid") / part_width)
    shares = dirichlet(alpha, n_parties, seed)
    return long.withColumn("party_id", _by_shares(F.pmod(F.xxhash64(F.lit(seed), block), F.lit(CELLS)), shares))


def grid(long: DataFrame, n_features: int, n_hori: int, n_verti: int, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """(fid, row_id, val) with party_id = row group * n_verti + feature group; each row group deals its features anew."""
    row_group = _by_shares(_cell(seed), dirichlet(alpha, n_hori, seed))
    owners = F.array(*[F.array(*map(F.lit, heterogeneous_features(n_features, n_verti, alpha, seed + 1 + g))) for g in range(n_hori)])
    return long.withColumn("__g", row_group).withColumn("party_id", (F.col("__g") * n_verti + owners[F.col("__g")][F.col("fid")]).cast("int")).drop("__g")


def blocks_with_test(long: DataFrame, n_features: int, n_parties: int, part_length: int, part_width: int, train_portion: float = 0.75, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """blocks, with is_train by row."""
    out = blocks(long, n_features, n_parties, part_length, part_width, alpha, seed)
    return out.withColumn("is_train", _cell(seed + 7) < train_portion * CELLS)
