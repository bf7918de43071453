"""Quality scores from pairwise preferences (Bradley-Terry).

P(a is preferred to b) = sigmoid(s(a) - s(b)) with s additive in piecewise
linear functions of text statistics. Weights come from logistic loss on the
feature differences of (label 1, label 0) pairs. The cut is the score quantile
at the share of label 0 among the training rows, and maps to score CUT.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import zlib
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborflow.llm.common import crc_mod, map_columns

#: Labelled rows used for fitting at most, those of least hash.
FIT_ROWS = 20_000
CUT = 0.3
NAMES = ("log_words", "word_length", "upper", "digits", "symbols", "stops", "log_type_token", "adjacent_repeats", "deflate", "line_repeats", "bars", "shouts", "marks", "log_line", "long_words", "lag_repeats")
KNOTS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95)


def statistics(text: str | None) -> list[float]:
    """Numbers in the order of NAMES; all zero for null, empty and blank texts."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    n, count, size = len(words), np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(raw)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    stops = int(count[44] + count[46])
    ascii_marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) - stops
    lines = text.split("\n")
    marks = int(max(count[[35, 36, 37, 38, 42, 64, 94, 126]]))
    lags = max(sum(map(eq, words, words[k:])) for k in (2, 3, 4, 5)) if n > 5 else 0
    return [
        math.log1p(n), len(text) / n, upper / (upper + lower + 1), int(count[48:58].sum()) / size, ascii_marks / size, stops / n,
        math.log(len(set(words)) + 1) / math.log(n + 2), sum(map(eq, words, words[1:])) / n, len(zlib.compress(raw, 1)) / (size + 20),
        1 - len(set(lines)) / len(lines), int(count[124]) / n, int(count[33]) / n, marks / n, math.log1p(len(text) / len(lines)), sum(len(w) > 15 for w in words) / n, lags / n,
    ]


@dataclasses.dataclass(frozen=True)
class BradleyTerry:
    knots: np.ndarray  # feature x knot
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        return _expand(x, self.knots) / self.scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """In 0 to 1; CUT at the quantile cut."""
        z = np.clip(self.raw(x) - self.cut + math.log(CUT / (1 - CUT)), -40, 40)
        return 1 / (1 + np.exp(-z))


def _expand(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Each feature, clipped to its outer knots' reach, and its hinges at the knots."""
    hinges = np.maximum(x[:, :, None] - knots[None], 0).reshape(len(x), -1)
    return np.hstack([x, hinges])


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, steps: int = 500, pairs: int = 2048, l2: float = 1e-3) -> BradleyTerry | None:
    """Adam over random pairs of one row of each label; None unless both labels occur."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    knots = np.quantile(x, KNOTS, axis=0).T
    phi = _expand(x, knots)
    scale = phi.std(axis=0) + 1e-6
    phi = phi / scale
    rng, w = np.random.default_rng(seed), np.zeros(phi.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        d = phi[rng.choice(good, pairs)] - phi[rng.choice(bad, pairs)]
        g = -(d / (1 + np.exp(np.clip(d @ w, -40, 40)))[:, None]).mean(axis=0) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = np.sort(phi @ w)
    k = len(bad)
    return BradleyTerry(knots, scale, w, float((s[k - 1] + s[min(k, len(s) - 1)]) / 2))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int, out_fold: int) -> DataFrame:
    """(text, label) of at most rows labelled documents outside the held-out fold, those of least hash of the id.

    Labels that are null do not count; of several labels of one id the least does.
    """
    some = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != out_fold))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most `rows` pairs of numbers


def one_of_each(rows: DataFrame) -> list[tuple[list[float], int]]:
    """Sorted (x, y) of rows (id, y, x), one for each id, so that repeated ids in documents can't add to what is collected."""
    return sorted((r.r.x, r.r.y) for r in rows.groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).collect())


def _statistics():
    return lambda ids, label, texts: (ids, label, [statistics(t) for t in texts])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> BradleyTerry | None:
    """Model from labels.quality; rows with crc32(doc_id) mod 5 = 0 are held out."""
    order = one_of_each(map_columns(labelled_sample(docs, labels, "quality", rows, 5, 0), ["doc_id", "__label", "text"], _statistics, "id long, y int, x array<double>"))
    if not order:
        return None
    return fit(np.array([x for x, _ in order]), np.array([y for _, y in order]))


def _scores(model: BradleyTerry | None):
    def fn(ids, held, texts):
        x = np.array([statistics(t) for t in texts])
        s = model.score(x) if model else np.full(len(ids), 0.5)
        return ids, held, s.tolist(), (s >= CUT).astype(int).tolist()

    return fn


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts are scored like a text without words. Without labels of
    both kinds every score is 0.5. Repeated rows give repeated results; ids may
    be null (not held out).
    """
    model = fit_quality(docs, labels, rows)
    held = (crc_mod("doc_id", 5) == 0).alias("held_out")
    return map_columns(docs, ["doc_id", held, "text"], functools.partial(_scores, model), "doc_id long, held_out boolean, score double, predicted int")


def _keep(model: BradleyTerry | None):
    return lambda texts: ((model.score(np.array([statistics(t) for t in texts])) >= CUT).tolist() if model else [True] * len(texts),)


def keep_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose score reaches CUT."""
    model = fit_quality(docs, labels, rows)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(_keep(model)(texts.tolist())[0], dtype=bool)

    return docs.where(good(F.col("text")))
