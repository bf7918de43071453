"""Vertical training and scoring over frames of their own: no frame holds the features of two parties.

Every party's bins lie in a frame (row_id, bins), dealt and sorted by row_id and
held. The coordinator holds (row_id, y, margins, work, at): gradients and the
node of each row, and no feature. In a level each party gives the histogram of
its features; the owner of a split tells by a bit a row which way the row would
go there, as (row_id, bits), and that is all that leaves it. Where a row is
follows from the bits of all splits so far. All frames are dealt alike, so their
joins move no row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborflow.functions import privacy
from arborflow.functions.metrics import evaluate
from arborflow.functions.objectives import OBJECTIVES
from arborflow.operators import cuts as C
from arborflow.operators import histogram as H
from arborflow.operators import layout
from arborflow.params import Params
from arborflow.plans.flat import FlatForest, lists
from arborflow.plans.trainer import Forest, Grower, _bag, _cut_plan, checked, with_work
from arborflow.plans.tree import Tree, number
from arborflow.workers import ensure_importable


def common_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """(row_id, y[, group_id]) of the rows that all parties have; y and group_id from the first party that knows them."""
    out = None
    for k, part in enumerate(parts):
        kept = part.select("row_id", (F.col("y") if "y" in part.columns else F.lit(None).cast("double")).alias(f"y{k}"), *([F.col("group_id").alias(f"group{k}")] if "group_id" in part.columns else []))
        out = kept if out is None else out.join(kept, "row_id")
    groups = [c for c in out.columns if c.startswith("group")]
    return out.select("row_id", F.coalesce(*[f"y{k}" for k in range(len(parts))]).alias("y"), *([F.coalesce(*groups).alias("group_id")] if groups else []))


def label_owner(parts: Sequence[DataFrame]) -> int:
    """The first party that knows a label."""
    for k, part in enumerate(parts):
        if "y" in part.columns and not part.where("y is not null").isEmpty():
            return k
    raise ValueError("no party has labels")


def _dealt(frame: DataFrame) -> DataFrame:
    """frame by row_id over the shuffle partitions, sorted and held; frames dealt so join without an exchange or a sort."""
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = frame.repartition(n, "row_id").sortWithinPartitions("row_id").persist(StorageLevel.MEMORY_AND_DISK)
    out.count()  # Spark knows how a held frame is dealt once it is computed
    return out


class VerticalGrower(Grower):
    """A Grower whose rows are apart: state (row_id, work, at) at the coordinator, bins at the parties."""

    def __init__(self, state: DataFrame, parts: Sequence[DataFrame], widths: Sequence[int], owner: int, params: Params, cuts: list[list[float]], round_seed: int, keys=None, rng=None, n_trees: int = 1):
        super().__init__(state.select(F.inline("work")), params.replace(privacy="none" if params.privacy == "he" else params.privacy), cuts, round_seed, keys=keys, rng=rng, n_trees=n_trees)
        self.parts, self.widths, self.owner = parts, widths, owner
        self.offsets = [sum(widths[:p]) for p in range(len(widths))]
        self.frame, self.routes = state, {}
        self.state = self.placed()
        self.held: list[DataFrame] = []
        self.secret = None
        if params.privacy == "he":  # the label's owner seals gradients once a round; the other parties see no others
            entries = state.select("row_id", F.inline("work")).select("row_id", "tid", F.col("g").alias("eg"), F.col("h").alias("eh"))
            self.secret = privacy.encrypt_columns(entries, keys.public, ("eg", "eh")).persist(StorageLevel.MEMORY_AND_DISK)
            self.held.append(self.secret)

    def histogram(self, active: list[int]) -> DataFrame:
        """The parties' histograms side by side."""
        made = []
        placed = F.transform("work", lambda e: F.struct(F.get("at", e["tid"]).alias("nid"), e["g"].alias("g"), e["h"].alias("h")))
        plain = self.state.select("row_id", placed.alias("placed"))
        for p, part in enumerate(self.parts):
            if self.secret is not None and p != self.owner:
                at = part.join(self.secret, "row_id").join(self.state.select("row_id", "at").hint("merge"), "row_id")
                cells = at.select(F.get("at", F.col("tid")).alias("nid"), F.col("eg").alias("g"), F.col("eh").alias("h"), "bins").where(F.col("nid").isin(active))
                cells = cells.select("nid", "g", "h", F.posexplode("bins").alias("fid", "bid")).where("bid is not null")
                sums = privacy.decrypt_columns(privacy.sum_encrypted(cells, self.keys.public, ("nid", "fid", "bid")), self.keys)
                made.append(sums.select("nid", "fid", "bid", "g", "h"))
            else:
                rows = part.join(plain.hint("merge"), "row_id").select("bins", F.inline("placed")).where(F.col("nid").isin(active))
                made.append(H.level_histogram(rows, count=self.secret is None))
        return H.concat_vertical(made, list(self.widths))

    def owner_of(self, fid: int) -> int:
        return max(p for p, start in enumerate(self.offsets) if start <= fid)

    def after_level(self, level: int) -> None:
        """Each owner of a split sends route bits; the rows' nodes follow from them."""
        for t, tree in enumerate(self.trees):
            for x in tree.level(level):
                if not x.is_leaf:
                    p = self.owner_of(x.fid)
                    self.routes.setdefault(p, {})[t * self.stride + x.nid] = f"coalesce(bins[{x.fid - self.offsets[p]}] <= {x.bid}, {x.default_right})"
        self.state = self.placed().persist(StorageLevel.MEMORY_AND_DISK)
        self.state.count()  # as in _dealt
        self.held.append(self.state)

    def bits(self, p: int) -> DataFrame:
        """(row_id, bits ARRAY<BOOLEAN>) from party p: for each of its splits whether the row goes right there."""
        return self.parts[p].selectExpr("row_id", f"array({', '.join(self.routes[p].values())}) AS bits{p}")

    def placed(self) -> DataFrame:
        """The coordinator's frame with at ARRAY<INT>: the number of each tree's node that the row is in, by the parties' bits."""
        out, where = self.frame, {}
        for p in sorted(self.routes):
            out = out.join(self.bits(p).hint("merge"), "row_id")  # both are dealt and sorted by row_id, so nothing is sent
            where.update({n: f"bits{p}[{k}]" for k, n in enumerate(self.routes[p])})

        def walk(n: int) -> str:
            if n not in where:
                return str(n)
            base = n - n % self.stride
            return f"CASE WHEN {where[n]} THEN {walk(2 * n - base + 2)} ELSE {walk(2 * n - base + 1)} END"

        at = f"array({', '.join(walk(t * self.stride) for t in range(self.n_trees))})"
        return out.select(*self.frame.columns, F.expr(at).alias("at"))

    def weights(self) -> list[float]:
        """By number: the weight of the leaf that a row in this node counts for, its own or, after pruning, an ancestor's."""
        out = [0.0] * (self.n_trees * self.stride)
        for t, tree in enumerate(self.trees):
            for nid in sorted(tree.nodes):
                leaf = nid
                while tree.nodes[leaf].is_pruned:
                    leaf = (leaf - 1) // 2
                out[t * self.stride + nid] = tree.nodes[leaf].weight
        return out


def propose_part_cuts(part: DataFrame, width: int, params: Params) -> list[list[float]]:
    return C.collect_cuts(C.distinct_cuts(part.select("row_id", F.inline("features")), params.max_bins), width)


def train_vertical(parts: Sequence[DataFrame], params: Params, widths: Sequence[int] | None = None, watch: bool = False) -> tuple[Forest, DataFrame]:
    """(forest, (row_id, y, margins)) of parties that hold features of the same rows: parts (row_id, features[, y, group_id]).

    The trees are those of centralized training on the joined table. Features
    are numbered through, the first party's first; rows that a party lacks are left
    out. With bagging all rounds share one proposal of cuts, from all rows.
    """
    rows = _dealt(common_rows(parts))
    params = checked(rows, params.replace(mode="vertical"))
    owner = label_owner(parts)
    shared = [part.join(rows.select("row_id"), "row_id", "left_semi").select("row_id", "features") for part in parts]
    widths = list(widths) if widths else [layout.width(p) for p in parts]
    own_cuts = [propose_part_cuts(p, n, params) for p, n in zip(shared, widths)]
    bins = [_dealt(C.bin_rows(p, c, ["row_id"])) for p, c in zip(shared, own_cuts)]
    cuts, k = [c for own in own_cuts for c in own], params.classes
    keys = privacy.paillier_keys(params.key_length) if params.privacy == "he" else None
    frame = (layout.reorder_labels(rows) if params.reorder_label else rows).withColumn("margins", F.array(*[F.lit(0.0)] * k))
    forest, before = Forest(params, [], len(cuts), cuts, widths=widths), []
    for t in range(params.n_trees):
        frame = with_work(frame, params, t, F.lit(0))
        if params.bagging and params.bagging_fraction < 1:
            frame = frame.withColumn("work", F.when(_bag("row_id", params, t), F.col("work")).otherwise(F.array().cast(frame.schema["work"].dataType)))
        frame = _dealt(frame) if params.objective.startswith("rank:") else frame.persist(StorageLevel.MEMORY_AND_DISK)
        grower = VerticalGrower(frame, bins, widths, owner, params, cuts, params.seed + t * k, keys, n_trees=k)
        trees: list[Tree] = grower.grow_all()
        forest.trees.append(trees)
        for old in before:
            old.unpersist()
        before = [frame, *grower.held]
        weight = f"array({', '.join(number(params.learning_rate * w) for w in grower.weights())})"
        moved = F.expr(f"zip_with(margins, at, (m, n) -> m + {weight}[n])")
        frame = _cut_plan(grower.state.withColumn("margins", moved).drop("work", "at"), t, params)
        if watch:
            forest.scores.append(evaluate(frame, params.metric or OBJECTIVES[params.objective].metric))
    return forest, frame


def _route_bits(flat: FlatForest, nodes: np.ndarray, shift: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits = []
        for values in flat.blocks(b, "features", shift):
            go = flat.goes_right(values, np.arange(len(values))[:, None], nodes[None, :]) if len(nodes) else np.zeros((len(values), 0), bool)
            bits += [r.tobytes() for r in np.packbits(go, axis=1)]
        yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(bits, pa.binary())], ["row_id", "bits"])


def _joined_margins(flat: FlatForest, owned: list[np.ndarray], rate: float, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        go = np.zeros((b.num_rows, len(flat.leaf)), bool)
        for p, nodes in enumerate(owned):
            size = -(-len(nodes) // 8)
            if size:
                packed = np.frombuffer(b"".join(b.column(f"bits{p}").to_pylist()), np.uint8).reshape(-1, size)
                go[:, nodes] = np.unpackbits(packed, axis=1)[:, : len(nodes)]
        at = flat.walk(b.num_rows, lambda row, at: go[row, at])  # noqa: B023  called at once
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists(flat.margins(at, rate), pa.float64())], [*keep, "margins"])


def score_parts(parts: Sequence[DataFrame], forest: Forest, widths: Sequence[int]) -> DataFrame:
    """(row_id, y[, group_id], margins): each party tells by one bit a node of its own which way its rows would go, and the coordinator walks the trees by the bits."""
    rows, flat, start = common_rows(parts), FlatForest.of(forest), 0
    ensure_importable(rows.sparkSession)
    inner, owned = np.flatnonzero(~flat.leaf), []
    of = flat.used[flat.feature[inner]] if len(flat.used) else np.zeros(0, np.int64)
    keep = rows.columns
    for p, (part, n) in enumerate(zip(parts, widths)):
        nodes = inner[(of >= start) & (of < start + n)] if len(flat.used) else inner[:0]
        owned.append(nodes)
        given = part.select("row_id", F.coalesce("features", F.array().cast(part.schema["features"].dataType)).alias("features"))
        told = given.mapInArrow(functools.partial(_route_bits, flat, nodes, start), T.StructType([part.schema["row_id"], T.StructField("bits", T.BinaryType())]))
        rows = rows.join(told.withColumnRenamed("bits", f"bits{p}"), "row_id")
        start += n
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("margins", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(functools.partial(_joined_margins, flat, owned, forest.rate, keep), schema)
