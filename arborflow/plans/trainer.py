"""Boosting: a driver loop of one aggregate job a level, over a frame of bins, for all trees of a round at once."""

from __future__ import annotations

import dataclasses
import secrets
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborflow.functions import privacy
from arborflow.functions.metrics import evaluate
from arborflow.functions.objectives import OBJECTIVES, rank_gradients
from arborflow.operators import cuts as C
from arborflow.operators import histogram as H
from arborflow.operators import layout, splits
from arborflow.operators.layout import hash_number
from arborflow.params import Params
from arborflow.plans.tree import Tree, by_bin, by_tree, by_value, merge_hybrid, node_id, node_number, weight_sql

#: Rounds between checkpoints, which bound the plan's growth.
CHECKPOINT_ROUNDS = 5

Cuts = list[list[float]]


@dataclasses.dataclass
class Forest:
    """trees[round][class], and what scoring needs."""

    params: Params
    trees: list[list[Tree]]
    n_features: int
    cuts: Cuts | None = None
    scores: list[float] = dataclasses.field(default_factory=list)
    widths: list[int] | None = None  # features of each party's file, in vertical runs

    @property
    def rate(self) -> float:
        """What a leaf's weight counts: with bagging the rounds are averaged."""
        return self.params.learning_rate / (len(self.trees) if self.params.bagging else 1)


def with_party(rows: DataFrame) -> DataFrame:
    return rows if "party_id" in rows.columns else rows.withColumn("party_id", F.lit(0))


def propose_cuts(rows: DataFrame, n_features: int, params: Params) -> Cuts:
    """Cuts as the mode proposes them; on the driver, at most features x bins numbers."""
    long = rows.select("party_id", "row_id", F.inline("features"))
    if params.propose_split == "sketch":
        found = C.sketch_cuts(C.party_sketches(long), params.max_bins)
    elif params.mode == "horizontal":
        if params.propose_split != "server":
            found = C.sample_party_cuts(C.distinct_cuts(long, params.max_bins, ("party_id", "fid")), params.max_bins, params.seed)
        else:
            found = C.range_cuts(C.merge_ranges(C.feature_range(long, ("party_id", "fid"))), params.max_bins)
    else:
        found = C.distinct_cuts(long, params.max_bins)
    return C.collect_cuts(found, n_features)


def propose_party_cuts(rows: DataFrame, n_features: int, params: Params) -> list[Cuts]:
    """The cuts of each party's own values, found in the same jobs for all parties."""
    long = rows.select("party_id", "row_id", F.inline("features"))
    out: list[Cuts] = [[[] for _ in range(n_features)] for _ in range(params.n_parties)]
    for r in sorted(C.distinct_cuts(long, params.max_bins, ("party_id", "fid")).collect(), key=lambda r: (r.party_id, r.fid, r.bid)):
        out[r.party_id][r.fid].append(r.cut)
    return out


def binned(rows: DataFrame, cuts: Cuts | list[Cuts], by_party: bool = False) -> DataFrame:
    """(row_id, party_id, y[, group_id], bins); by_party: cuts has a list for each party."""
    keep = [c for c in ("row_id", "party_id", "y", "group_id") if c in rows.columns]
    return C.bin_rows(rows, cuts, keep, "party_id" if by_party else None)


def gradients(frame: DataFrame, params: Params, k: int, t: int = 0) -> DataFrame:
    """frame with g and h in millionths, for class k in round t; ranked rows meet another partner every round."""
    if params.objective.startswith("rank:"):
        ranked = rank_gradients(frame.select("row_id", "group_id", "y", F.col("margins")[0].alias("margin")), params.objective == "rank:ndcg", params.seed + t)
        frame = frame.join(ranked.withColumnsRenamed({"g": "__g", "h": "__h"}), "row_id")
        g, h = F.col("__g"), F.col("__h")
    else:
        g, h = OBJECTIVES[params.objective].gradient(F.col("y"), F.col("margins"), k, params.constant_h)
    return frame.withColumns(dict(zip(("g", "h"), _fixed(g, h, params)))).drop("__g", "__h")


def _fixed(g: Column, h: Column, params: Params) -> tuple[Column, Column]:
    return H.fixed(privacy.clip(g) if params.privacy == "dp" else g), H.fixed(h)


def with_work(frame: DataFrame, params: Params, t: int, first: Column) -> DataFrame:
    """frame with work ARRAY<STRUCT<tid, g, h>>: an entry for each tree of round t that the row counts for. first: the row's first tree."""
    if params.objective.startswith("rank:"):
        found = gradients(frame, params, 0, t)
        return found.withColumn("work", F.array(F.struct(first.cast("int").alias("tid"), "g", "h"))).drop("g", "h")
    entries = []
    for k in range(params.classes):
        g, h = _fixed(*OBJECTIVES[params.objective].gradient(F.col("y"), F.col("margins"), k, params.constant_h), params)
        entries.append(F.struct((first + k).cast("int").alias("tid"), g.alias("g"), h.alias("h")))
    return frame.withColumn("work", F.array(*entries))


class Grower:
    """Grows trees side by side, level by level: a level is one job, however many trees there are.

    rows: (party_id, bins, g, h), and tid with several trees: a row for each tree
    that it counts for. Node nid of tree t has the number t x stride + nid in
    histograms, so one aggregation keeps all trees apart.

    rng draws the noise of differential privacy, from the system's source unless
    a test gives one. own_cuts: parties' cuts (party_id, fid, bid, cut) of the
    rows' column own_bins, whose histograms are moved to `cuts` when merged.
    tree_cuts: the cuts of each tree, if they differ.
    """

    def __init__(self, rows: DataFrame, params: Params, cuts: Cuts, round_seed: int, n_parties: int = 1, keys=None, rng=None, own_cuts: DataFrame | None = None, n_trees: int = 1, tree_cuts: list[Cuts] | None = None):
        self.rows = rows if "tid" in rows.columns else rows.withColumn("tid", F.lit(0))
        self.params, self.cuts, self.seed, self.n_parties, self.n_trees = params, cuts, round_seed, n_parties, n_trees
        self.tree_cuts = tree_cuts or [cuts] * n_trees
        self.keys, self.rng, self.own_cuts = keys, rng or secrets.SystemRandom(), own_cuts
        self.budget = privacy.split_budget(params.privacy_budget, params.n_trees, params.depth, params.reg_lambda, params.constant_h or 1.0, bagging_fraction=params.bagging_fraction) if params.privacy == "dp" else None
        self.stride = 2 ** (params.depth + 1)
        self.trees: list[Tree] = []
        self.sealed = None
        self.last: DataFrame | None = None
        if params.privacy == "he" and params.mode == "vertical":  # a row is encrypted once a tree, not once a feature and level
            sealed = privacy.encrypt_columns(self.rows.select("tid", "bins", F.col("g").alias("eg"), F.col("h").alias("eh")), keys.public, ("eg", "eh"))
            self.sealed = sealed.persist(StorageLevel.MEMORY_AND_DISK)

    def node(self, number: int):
        return self.trees[number // self.stride].nodes[number % self.stride]

    def histogram(self, active: list[int]) -> DataFrame:
        """The nodes' histogram: parties' own, protected as asked, then merged."""
        p, by = self.params, ("nid", "fid", "bid")
        at = self.rows if self.sealed is None else self.sealed
        at = at.withColumn("nid", node_number(self.trees, "tid", self.stride)).where(F.col("nid").isin(active))
        if self.sealed is not None:
            cells = at.select("nid", F.col("eg").alias("g"), F.col("eh").alias("h"), F.posexplode("bins").alias("fid", "bid")).where(F.col("bid").isNotNull())
            return privacy.decrypt_columns(privacy.sum_encrypted(cells, self.keys.public, by), self.keys)
        if self.own_cuts is not None:
            return self._moved(H.level_histogram(at, ("party_id",), "own_bins"))
        if p.mode == "horizontal" and p.privacy in ("sa", "he"):
            own = H.level_histogram(at, ("party_id",))
            if p.privacy == "sa":
                return H.merge(privacy.mask_histogram(privacy.complete_cells(own, self.n_parties), self.keys, f"{self.seed}:{active[0]}"))
            return privacy.decrypt_columns(privacy.sum_encrypted(privacy.encrypt_columns(own, self.keys.public), self.keys.public, by), self.keys)
        return H.level_histogram(at, count=True)  # the merge of parties' sums is the same sum

    def _moved(self, own: DataFrame) -> DataFrame:
        """Parties' histograms over their own cuts, merged over the common ones, in whole millionths."""
        spark = own.sparkSession
        common = spark.createDataFrame([(f, b, c) for f, cs in enumerate(self.cuts) for b, c in enumerate(cs)], "fid int, bid int, cut double")
        edges = self.own_cuts.groupBy("fid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        moved = H.merge_interpolated(own, self.own_cuts.drop("lo", "hi"), common, edges)
        return moved.select("nid", "fid", "bid", F.round("g").cast("long").alias("g"), F.round("h").cast("long").alias("h"))

    def level_histogram(self, active: list[int]) -> DataFrame:
        """As histogram(), but of two children only the lighter one is summed over rows; the other is the parent's rest.

        Under masks or encryption the merged sums are subtracted, so parties mask
        or encrypt, and the server adds, the cells of half the nodes only.
        """
        if self.last is None or self.own_cuts is not None:
            return self.histogram(active)
        family, known = [], set(active)
        for left in active:
            place = left % self.stride
            if place % 2 and left + 1 in known:
                light, other = (left, left + 1) if self.node(left).h <= self.node(left + 1).h else (left + 1, left)
                family.append((left - place + (place - 1) // 2, light, other))
        return H.with_siblings(self.histogram([a for _, a, _ in family]), self.last, family)

    def structured(self, active: list[int], wanted: dict[int, int]) -> DataFrame:
        """The histogram of one feature a node."""
        if self.params.privacy in ("sa", "he") or self.own_cuts is not None:
            return self.histogram(active).where(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col("nid")] == F.col("fid"))
        return H.structured_histogram(self.rows.withColumn("nid", node_number(self.trees, "tid", self.stride)), wanted)

    def _best(self, gains: DataFrame) -> DataFrame:
        return splits.private_splits(gains, self.budget.level, self.budget.delta_g, self.rng.getrandbits(62)) if self.budget else splits.best_splits(gains)

    def grow_level(self, level: int, only: list[dict[int, int]] | None = None, more: bool = True) -> bool:
        """Split the level's leaves; only: the feature that each tree's predefined structure gives a node; more: whether levels follow. Whether any node split or passed its rows on."""
        p = self.params
        open_nodes = [(t, x) for t, tree in enumerate(self.trees) for x in tree.level(level) if x.is_leaf and (only is None or x.nid in only[t])]
        passed = 0
        if only is not None:
            for t, x in list(open_nodes):
                if not self.tree_cuts[t][only[t][x.nid]]:
                    self.trees[t].pass_on(x.nid, only[t][x.nid])
                    open_nodes.remove((t, x))
                    passed += 1
        nodes = [(t * self.stride + x.nid, x.g, x.h) for t, x in open_nodes]
        if not nodes:
            return passed > 0
        active = [n[0] for n in nodes]
        if only is None:
            hist = self.level_histogram(active)
        else:
            hist = self.structured(active, {n: only[n // self.stride][n % self.stride] for n in active})
        before, self.last = self.last, None
        if more and only is None and self.own_cuts is None:
            self.last = hist = hist.persist(StorageLevel.MEMORY_AND_DISK)
        gains = splits.with_gain(hist, {n: (g, h) for n, g, h in nodes}, p.reg_lambda, p.min_child_weight)
        done = []
        for r in sorted(self._best(gains).collect(), key=lambda r: r.nid):  # a row for each node of the level
            t = r.nid // self.stride
            done.append(self.trees[t].split(r.nid % self.stride, r.fid, r.bid, self.tree_cuts[t][r.fid][r.bid], r.gain, r.default_right, r.rg, r.rh, r.mg, r.mh))
        if before is not None:
            before.unpersist()
        self.after_level(level)
        return any(done) or passed > 0

    def after_level(self, level: int) -> None:
        """What follows the splits of a level."""

    def grow_all(self, levels: int | None = None, prune: bool = True, structures: list[dict[int, int]] | None = None) -> list[Tree]:
        """All trees; structures: for each the features of its nodes, if they are given."""
        sums = {r.tid: r for r in self.rows.groupBy("tid").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()}  # a row for each tree
        lam = self.params.reg_lambda
        self.trees = [Tree(int(sums[t].g or 0), int(sums[t].h or 0), lam, sums[t].n) if t in sums else Tree(0, 0, lam) for t in range(self.n_trees)]
        depth = levels or self.params.depth
        for level in range(depth):
            if not self.grow_level(level, structures, level + 1 < depth):
                break
        for held in (self.last, self.sealed):
            if held is not None:
                held.unpersist()
        for tree in self.trees:
            if prune:
                tree.prune(self.params.gamma)
            if self.budget:
                for leaf in tree.leaves():
                    leaf.weight += privacy.laplace(self.budget.delta_v / self.budget.leaf, self.rng)
        return self.trees

    def grow(self, levels: int | None = None, prune: bool = True, structure: dict[int, int] | None = None) -> Tree:
        """The only tree."""
        return self.grow_all(levels, prune, None if structure is None else [structure])[0]


def _bag(row_id: str, params: Params, round_number: int) -> Column:
    """Disjoint slices of the hash order, dealt anew when all are used."""
    k = max(1, int(1 / params.bagging_fraction))
    return F.pmod(hash_number(params.seed + round_number // k, F.col(row_id)), F.lit(k)) == round_number % k


def _cut_plan(frame: DataFrame, t: int, params: Params) -> DataFrame:
    """frame, by a checkpoint every few rounds; every round for ranking, whose gradients join the frame with itself."""
    known = frame.sparkSession.sparkContext.getCheckpointDir() or frame.sparkSession.conf.get("spark.checkpoint.dir", None)
    if (t + 1) % CHECKPOINT_ROUNDS and not (known and params.objective.startswith("rank:")):
        return frame
    if not known:
        raise ValueError(f"{CHECKPOINT_ROUNDS} rounds or more need spark.checkpoint.dir, a folder that all executors share")
    return frame.checkpoint()


class _Rounds:
    """Trees of one round after the other for one learner, or for each party as a learner of its own rows and cuts.

    A round is a job for the sums of all trees, which also fills the cache with
    the rows' new margins and gradients, and a job a level.
    """

    def __init__(self, frame: DataFrame, params: Params, cuts: Cuts, party_cuts: list[Cuts] | None = None, n_parties: int = 1, own_cuts: DataFrame | None = None):
        self.params, self.cuts, self.party_cuts, self.n_parties, self.own_cuts = params, cuts, party_cuts, n_parties, own_cuts
        self.learners = len(party_cuts) if party_cuts else 1
        self.first = F.col("party_id") * params.classes if party_cuts else F.lit(0)
        self.tree_cuts = [c for c in party_cuts for _ in range(params.classes)] if party_cuts else None
        self.keys = privacy.KeyAgreement(n_parties) if params.privacy == "sa" else privacy.paillier_keys(params.key_length) if params.privacy == "he" else None
        self.frame = frame if "margins" in frame.columns else frame.withColumn("margins", F.array(*[F.lit(0.0)] * params.classes))
        self.held: list[DataFrame] = []

    def begin(self, t: int) -> None:
        """Hold the rows with the gradients of round t; they are computed by the round's first job."""
        self.frame = with_work(self.frame, self.params, t, self.first).persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(self.frame)

    def grower(self, t: int) -> Grower:
        if self.params.privacy == "he" and t:
            self.keys = privacy.paillier_keys(self.params.key_length)
        rows = self.frame
        if self.params.bagging and self.params.bagging_fraction < 1:
            rows = rows.where(_bag("row_id", self.params, t))
        rows = rows.select("party_id", "bins", *(["own_bins"] if self.own_cuts is not None else []), F.inline("work"))
        n = self.learners * self.params.classes
        return Grower(rows, self.params, self.cuts, self.params.seed + t * n, self.n_parties, self.keys, own_cuts=self.own_cuts, n_trees=n, tree_cuts=self.tree_cuts)

    def move(self, trees: list[Tree], t: int) -> None:
        """Add the trees' weights to the margins; the rows of the round before are no longer held."""
        k, rate = self.params.classes, self.params.learning_rate
        weight = lambda c: by_tree("party_id", self.learners, lambda p: weight_sql(trees[p * k + c], by_bin(), rate))
        moved = F.expr(f"array({', '.join(f'margins[{c}] + {weight(c)}' for c in range(k))})")
        self.frame = _cut_plan(self.frame.withColumn("margins", moved).drop("work"), t, self.params)
        while len(self.held) > 1:
            self.held.pop(0).unpersist()

    def by_learner(self, trees: list[Tree]) -> list[list[Tree]]:
        k = self.params.classes
        return [trees[p * k : p * k + k] for p in range(self.learners)]


def _run(rounds: _Rounds, n_rounds: int, watch: bool = False, update: bool = True) -> tuple[list[Forest], DataFrame]:
    """(a forest for each learner, frame with final margins)."""
    params = rounds.params
    forests = [Forest(params, [], len(rounds.cuts), rounds.party_cuts[p] if rounds.party_cuts else rounds.cuts) for p in range(rounds.learners)]
    for t in range(n_rounds):
        if t == 0 or update:
            rounds.begin(t)
        trees = rounds.grower(t).grow_all()
        for forest, own in zip(forests, rounds.by_learner(trees)):
            forest.trees.append(own)
        if not update:
            continue
        rounds.move(trees, t)
        if watch:
            for p, forest in enumerate(forests):
                scored = rounds.frame.where(F.col("party_id") == p) if rounds.party_cuts else rounds.frame
                forest.scores.append(evaluate(scored, params.metric or OBJECTIVES[params.objective].metric))
    return forests, rounds.frame.drop("work")


def boost(frame: DataFrame, params: Params, cuts: Cuts, rounds: int | None = None, n_parties: int = 1, watch: bool = False, update: bool = True, own_cuts: DataFrame | None = None) -> tuple[Forest, DataFrame]:
    """(forest, frame with final margins) of a binned frame. watch: score every round; update=False leaves the margins as they are."""
    forests, out = _run(_Rounds(frame, params, cuts, None, n_parties, own_cuts), rounds or params.n_trees, watch, update)
    return forests[0], out


def boost_parties(frame: DataFrame, params: Params, party_cuts: list[Cuts], rounds: int | None = None, watch: bool = False) -> tuple[list[Forest], DataFrame]:
    """(a forest for each party, frame with each row's margins in its party's) of a frame binned by parties' own cuts; all parties grow in the same jobs."""
    return _run(_Rounds(frame, params, party_cuts[0], party_cuts), rounds or params.n_trees, watch)


def boost_slices(rows: DataFrame, params: Params, n_features: int, watch: bool = False) -> Forest:
    """Bagging: each round proposes cuts from its own slice of the rows, bins the slice and grows on it; the trees then move all rows' margins by value."""
    keep = [c for c in ("row_id", "party_id", "y", "group_id") if c in rows.columns]
    current, held = rows.select(*keep, "features", F.array(*[F.lit(0.0)] * params.classes).alias("margins")), []
    forest = Forest(params, [], n_features)
    for t in range(params.n_trees):
        part = current.where(_bag("row_id", params, t))
        cuts = propose_cuts(part, n_features, params)
        rounds = _Rounds(C.bin_rows(part, cuts, [*keep, "margins"]), params, cuts, None, params.n_parties)
        rounds.begin(t)
        trees = rounds.grower(t).grow_all()
        forest.trees.append(trees)
        used = sorted({x.fid for tree in trees for x in tree.nodes.values() if not x.is_leaf})
        values = by_value("__used", {f: k for k, f in enumerate(used)})
        moved = ", ".join(f"margins[{c}] + {weight_sql(tree, values, params.learning_rate)}" for c, tree in enumerate(trees))
        current = _cut_plan(current.withColumn("__used", layout.values_of(F.col("features"), used)).withColumn("margins", F.expr(f"array({moved})")).drop("__used"), t, params)
        current = current.persist(StorageLevel.MEMORY_AND_DISK)
        if watch:
            forest.scores.append(evaluate(current, params.metric or OBJECTIVES[params.objective].metric))
        held += [rounds.frame, current]
        while len(held) > 3:
            held.pop(0).unpersist()
    return forest


def checked(rows: DataFrame, params: Params) -> Params:
    """params with the number of classes, if the labels are fit for the objective."""
    if params.objective.startswith("multi:") and params.num_class < 2:
        top = rows.agg(F.max("y")).first()[0]
        params = params.replace(num_class=int(top or 0) + 1)
    if params.objective.startswith(("multi:", "binary:")) and not params.reorder_label:
        layout.check_labels(rows, params.num_class if params.objective.startswith("multi:") else 2)
    return params


def train(rows: DataFrame, params: Params, watch: bool = False) -> Forest | list[Forest]:
    """Train on (row_id, y, features[, party_id, group_id]) in the mode of params; solo and hybrid give a forest for each party.

    Horizontal parties share rows' sums, vertical ones features': both reach the
    trees that the whole table gives with the same cuts.
    """
    params = checked(rows, params)
    rows = with_party(layout.reorder_labels(rows) if params.reorder_label else rows)
    n = max(params.n_features, layout.width(rows))
    if params.mode in ("ensemble", "solo", "hybrid"):
        rows = rows.where(F.col("party_id").between(0, params.n_parties - 1))
        if "group_id" in rows.columns:  # parties' groups are apart
            rows = rows.withColumn("group_id", F.struct("party_id", "group_id"))
        c = propose_party_cuts(rows, n, params)
        frame = binned(rows, c, by_party=True)
        if params.mode == "hybrid":
            return train_hybrid(frame, params, c, watch)
        if params.mode == "solo":
            return boost_parties(frame, params, c, watch=watch)[0]
        if params.n_trees % params.n_parties:
            raise ValueError("an ensemble needs n_trees divisible by n_parties")
        return merge_forests(boost_parties(frame, params.replace(n_trees=params.n_trees // params.n_parties), c, watch=watch)[0], params)
    if params.bagging and params.bagging_fraction < 1 and params.propose_split != "client_post":
        return boost_slices(rows, params, n, watch)
    c = propose_cuts(rows, n, params)
    if params.mode == "horizontal" and params.propose_split == "client_post":
        own = party_range_cuts(rows, params.max_bins)
        return boost(with_own_bins(binned(rows, c), rows, own, n), params, c, n_parties=params.n_parties, watch=watch, own_cuts=own)[0]
    return boost(binned(rows, c), params, c, n_parties=params.n_parties, watch=watch)[0]


def party_range_cuts(rows: DataFrame, max_bins: int) -> DataFrame:
    """(party_id, fid, bid, cut, lo, hi): each party's range cuts of its own values, a few rows for each party and feature."""
    ranges = C.feature_range(rows.select("party_id", "row_id", F.inline("features")), ("party_id", "fid")).collect()
    spark, out = rows.sparkSession, None
    for p in sorted({r.party_id for r in ranges}):
        mine = spark.createDataFrame([(r.fid, r.lo, r.hi) for r in ranges if r.party_id == p], "fid int, lo double, hi double")
        cuts = C.range_cuts(mine, max_bins).join(F.broadcast(mine), "fid").select(F.lit(p).cast("int").alias("party_id"), "fid", "bid", "cut", "lo", "hi")
        out = cuts if out is None else out.unionByName(cuts)
    return spark.createDataFrame(out.collect(), out.schema)


def with_own_bins(frame: DataFrame, rows: DataFrame, own_cuts: DataFrame, n_features: int) -> DataFrame:
    """frame with own_bins: every row's bins by its party's cuts."""
    found, parts = own_cuts.collect(), None
    for p in sorted({r.party_id for r in found}):
        cuts: list[list[float]] = [[] for _ in range(n_features)]
        for r in sorted((r for r in found if r.party_id == p), key=lambda r: (r.fid, r.bid)):
            cuts[r.fid].append(r.cut)
        part = C.bin_rows(rows.where(F.col("party_id") == p), cuts, ["row_id"]).withColumnRenamed("bins", "own_bins")
        parts = part if parts is None else parts.unionByName(part)
    return frame.join(parts, "row_id")


def merge_forests(forests: list[Forest], params: Params) -> Forest:
    """Parties' forests one after the other; margins add up."""
    return Forest(params, reduce(lambda a, b: a + b.trees, forests, []), max(f.n_features for f in forests), None)


def train_hybrid(frame: DataFrame, params: Params, party_cuts: list[Cuts], watch: bool = False) -> list[Forest]:
    """A forest for each party. Each round parties grow trees of their own; their best splits, merged in order of gain, give one structure of features, which each party then fills with its own values.

    A node whose feature a party lacks hands all its rows on. All parties grow in
    the same jobs: one a level for their own trees and one for the filling.
    """
    params = params.replace(gamma=0.0) if params.gamma else params
    if params.classes > 1:
        raise ValueError("hybrid training has one tree a round, so it takes no objective of several classes")
    rounds = _Rounds(frame, params, party_cuts[0], party_cuts)
    forests = [Forest(params, [], len(c), c) for c in party_cuts]
    for t in range(params.n_trees):
        rounds.begin(t)
        local = rounds.grower(t).grow_all()
        structure = dict(merge_hybrid(local, [max(1, x.nodes[0].n) for x in local], params.depth))
        trees = rounds.grower(t).grow_all(structures=[structure] * len(local))
        rounds.move(trees, t)
        for p, (forest, tree) in enumerate(zip(forests, trees)):
            forest.trees.append([tree])
            if watch:
                forest.scores.append(evaluate(rounds.frame.where(F.col("party_id") == p), params.metric or OBJECTIVES[params.objective].metric))
    return forests


def train_subtree(frame: DataFrame, params: Params, cuts: list[list[float]], levels: int) -> tuple[Tree, DataFrame]:
    """(tree, (row_id, nid, g, h) by leaf) from the caller's g and h in frame (row_id, bins, g, h): no pruning, no margins."""
    rows = with_party(frame)
    tree = Grower(rows.select("party_id", "bins", "g", "h"), params, cuts, params.seed).grow(levels, prune=False)
    return tree, rows.select("row_id", node_id(tree, by_bin()).alias("nid"), "g", "h")


def leaf_values_by_flag(rows: DataFrame, reg_lambda: float) -> DataFrame:
    """(nid, left, right): leaf values of the rows of each node whose flag is 0 and 1. rows: nid, flag, g, h."""
    def value(flag: int) -> Column:
        g, h = (F.sum(F.when(F.col("flag") == flag, F.col(c)).otherwise(0)) / H.UNIT for c in ("g", "h"))
        return F.when(h + reg_lambda == 0, 0.0).otherwise(-g / (h + reg_lambda))

    return rows.groupBy("nid").agg(value(0).alias("left"), value(1).alias("right"))
