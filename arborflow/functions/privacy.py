"""Differential privacy, secure aggregation and additive homomorphic encryption."""

from __future__ import annotations

import dataclasses
import hashlib
import math
import random
import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborflow.operators.layout import hash_number
from arborflow.workers import ensure_importable


@dataclasses.dataclass(frozen=True)
class Budget:
    """Epsilons of one tree's leaves and of one level, and the sensitivities of gains and leaf values."""

    leaf: float
    level: float
    delta_g: float
    delta_v: float


def split_budget(epsilon: float, n_trees: int, depth: int, reg_lambda: float, hessian: float = 1.0, bound: float = 1.0, bagging_fraction: float = 1.0) -> Budget:
    """Trees that share rows share epsilon; half of a tree's goes to leaves and half to levels, in equal parts."""
    sharing = max(1, n_trees // max(1, int(1 / bagging_fraction)))
    tree = epsilon / sharing
    return Budget(tree / 2, tree / 2 / depth, 3 * bound * bound / hessian, bound / (hessian + reg_lambda))


def clip(g: Column, bound: float = 1.0) -> Column:
    return F.greatest(F.least(g, F.lit(bound)), F.lit(-bound))


def laplace(scale: float, rng: random.Random) -> float:
    """Difference of two exponentials."""
    return scale * (rng.expovariate(1.0) - rng.expovariate(1.0))


def _uniform(seed: int, key: str) -> Column:
    """Between 0 and 1, from the hash of key and seed: the same when a lost task runs again."""
    return (hash_number(seed, F.col(key)) + 0.5) / float(1 << 48)


def gaussian_noise(rows: DataFrame, column: str, variance: float, seed: int, key: str = "row_id") -> DataFrame:
    """rows with normal noise added to column, one draw for each key. Who knows the seed knows the noise, so draw it from a secret source."""
    draw = F.sqrt(-2 * F.log(_uniform(seed, key))) * F.cos(2 * math.pi * _uniform(seed + 1, key))
    return rows.withColumn(column, F.col(column) + draw * math.sqrt(variance))


def laplace_noise(rows: DataFrame, column: str, scale: float, seed: int, key: str = "row_id") -> DataFrame:
    """As gaussian_noise, from the Laplace distribution of this scale."""
    u = _uniform(seed, key) - 0.5
    return rows.withColumn(column, F.col(column) - scale * F.signum(u) * F.log(1 - 2 * F.abs(u)))


# secure aggregation

#: Fixed value: the 1024-bit prime of the second Oakley group (RFC 2409), with generator 2.
PRIME = int(
    "FFFFFFFFFFFFFFFFC90FDAA22168C234C4C6628B80DC1CD129024E088A67CC74020BBEA63B139B22514A08798E3404DDEF9519B3CD3A431B302B0A6DF25F14374FE1356D6D51C245E485B576625E7EC6F44C42E9A637ED6B0BFF5CB6F406B7EDEE386BFB5A899FA5AE9F24117C4B1FE649286651ECE65381FFFFFFFFFFFFFFFF",
    16,
)
GENERATOR = 2


class KeyAgreement:
    """Diffie-Hellman between parties: one secret each, one shared key a pair."""

    def __init__(self, n_parties: int, rng=secrets.SystemRandom()):
        self.secret = [rng.randrange(2, PRIME - 1) for _ in range(n_parties)]
        self.public = [pow(GENERATOR, s, PRIME) for s in self.secret]

    def shared(self, a: int, b: int) -> int:
        """The key of a pair, as party a computes it."""
        return pow(self.public[b], self.secret[a], PRIME)

    def seeds(self, a: int, context: str) -> list[tuple[int, int]]:
        """(sign, 63-bit seed) for each peer of a: the lower party adds the mask, the higher subtracts it."""
        out = []
        for b in range(len(self.secret)):
            if b != a:
                digest = hashlib.sha256(f"{self.shared(a, b)}:{context}".encode()).digest()
                out.append((1 if a < b else -1, int.from_bytes(digest[:8], "big") >> 1))
        return out


def mask_histogram(hist: DataFrame, keys: KeyAgreement, context: str, bound: int = 1 << 40) -> DataFrame:
    """hist (party_id, nid, fid, bid, g, h) with a mask for every cell and pair of parties, which cancels in the sum over parties that hold the cell.

    Cells must be complete: complete_cells() first, so that every party has every cell.
    """

    def mask(name: str) -> Column:
        total = F.lit(0).cast("long")
        for a in range(len(keys.secret)):
            own = F.lit(0).cast("long")
            for sign, seed in keys.seeds(a, f"{context}:{name}"):
                own = own + sign * F.pmod(F.xxhash64(F.lit(seed), "nid", "fid", "bid"), F.lit(bound))
            total = F.when(F.col("party_id") == a, own).otherwise(total)
        return total

    return hist.withColumns({"g": F.col("g") + mask("g"), "h": F.col("h") + mask("h")})


def complete_cells(hist: DataFrame, n_parties: int) -> DataFrame:
    """hist with zero cells where a party lacks one that another has."""
    cells = hist.select("nid", "fid", "bid").distinct().withColumn("party_id", F.explode(F.array(*map(F.lit, range(n_parties)))))
    return cells.join(hist, ["party_id", "nid", "fid", "bid"], "left").select("party_id", "nid", "fid", "bid", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("h", F.lit(0)).alias("h"))


# Paillier


def _prime(bits: int, rng) -> int:
    while True:
        p = rng.getrandbits(bits) | (3 << (bits - 2)) | 1
        if all(p % q for q in (3, 5, 7, 11, 13, 17, 19, 23, 29)) and all(_witness(p, rng.randrange(2, p - 1)) for _ in range(24)):
            return p


def _witness(p: int, a: int) -> bool:
    """Whether a passes Miller-Rabin for p."""
    d, s = p - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    x = pow(a, d, p)
    if x in (1, p - 1):
        return True
    for _ in range(s - 1):
        x = x * x % p
        if x == p - 1:
            return True
    return False


@dataclasses.dataclass(frozen=True)
class PublicKey:
    n: int

    def encrypt(self, m: int, rng=None) -> int:
        """Of an integer; negative ones count as n + m."""
        rng = rng or secrets.SystemRandom()
        square = self.n * self.n
        r = rng.randrange(1, self.n)
        return (1 + (m % self.n) * self.n) % square * pow(r, self.n, square) % square

    def add(self, a: int, b: int) -> int:
        return a * b % (self.n * self.n)

    def scale(self, a: int, k: int) -> int:
        return pow(a, k % self.n, self.n * self.n)

    def subtract(self, a: int, b: int) -> int:
        return self.add(a, pow(b, -1, self.n * self.n))


@dataclasses.dataclass(frozen=True)
class PrivateKey:
    public: PublicKey
    lam: int
    mu: int

    def decrypt(self, c: int) -> int:
        n = self.public.n
        m = (pow(c, self.lam, n * n) - 1) // n * self.mu % n
        return m - n if m > n // 2 else m


def paillier_keys(bits: int = 512, rng=None) -> PrivateKey:
    rng = rng or secrets.SystemRandom()
    while True:
        p, q = _prime(bits // 2, rng), _prime(bits // 2, rng)
        if p != q and math.gcd(p * q, (p - 1) * (q - 1)) == 1:
            break
    n, lam = p * q, math.lcm(p - 1, q - 1)
    return PrivateKey(PublicKey(n), lam, pow(lam, -1, n))


def encrypt_columns(rows: DataFrame, key: PublicKey, columns: tuple[str, ...] = ("g", "h")) -> DataFrame:
    """rows with LONG columns replaced by ciphertexts as decimal strings."""
    n = str(key.n)
    ensure_importable(rows.sparkSession)

    @F.pandas_udf("string")
    def encrypt(x: pd.Series) -> pd.Series:
        k = PublicKey(int(n))
        return x.map(lambda m: None if m is None else str(k.encrypt(int(m))))

    return rows.withColumns({c: encrypt(c) for c in columns})


def _products(n: int, by: list[str], columns: tuple[str, ...]):
    square = n * n

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[int]] = {}
        for f in frames:
            for row in f[[*by, *columns]].itertuples(index=False):
                key = tuple(row[: len(by)])
                values = [int(v) for v in row[len(by) :]]
                if (have := held.get(key)) is None:
                    held[key] = values
                else:
                    held[key] = [a * b % square for a, b in zip(have, values)]
        if held:
            yield pd.DataFrame([(*k, *map(str, v)) for k, v in held.items()], columns=[*by, *columns])

    return run


def sum_encrypted(rows: DataFrame, key: PublicKey, by: tuple[str, ...], columns: tuple[str, ...] = ("g", "h")) -> DataFrame:
    """Sums under encryption by group: products within each task first, then one exchange of a row a group and task."""
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by), *(f"{c} string" for c in columns)])
    ensure_importable(rows.sparkSession)
    run = _products(key.n, list(by), columns)
    return rows.select(*by, *columns).mapInPandas(run, schema).repartition(*by).mapInPandas(run, schema)


def decrypt_columns(rows: DataFrame, key: PrivateKey, columns: tuple[str, ...] = ("g", "h")) -> DataFrame:
    """rows (a histogram, so few) with ciphertexts replaced by LONG sums."""
    parts = (str(key.public.n), str(key.lam), str(key.mu))
    ensure_importable(rows.sparkSession)

    @F.pandas_udf("long")
    def decrypt(x: pd.Series) -> pd.Series:
        n, lam, mu = map(int, parts)
        k = PrivateKey(PublicKey(n), lam, mu)
        return x.map(lambda c: np.int64(k.decrypt(int(c))))

    return rows.withColumns({c: decrypt(c) for c in columns})
