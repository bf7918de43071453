"""One query for each operator, over the driver's tables, with the SQL that states the same result."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborflow import sqlgen
from arborflow.functions import metrics, objectives, privacy
from arborflow.operators import cuts as C
from arborflow.operators import histogram as H
from arborflow.operators import layout, partition, splits
from arborflow.params import Params
from arborflow.plans import predict as P
from arborflow.plans import trainer, vertical
from arborflow.plans.tree import Node, Tree, by_bin, node_id
from arborflow.sources import text
from arborflow.workers import ensure_importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BINS, N = 16, 6
BASE = Params(mode="centralized", depth=3, n_trees=2, max_bins=BINS, learning_rate=0.5, reg_lambda=1.0, gamma=0.0, min_child_weight=1.0)
RANGE = BASE.replace(mode="horizontal", n_parties=3)


def query(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return put


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """An order with its customer: row_id, y, f0..f5, o_custkey."""
    o, c = layout.spread(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderdate", "o_orderpriority")), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1000).alias("y"), "o_custkey", F.col("c_acctbal").alias("f0"), F.col("c_nationkey").cast("double").alias("f1"),
        F.month("o_orderdate").cast("double").alias("f2"), F.dayofmonth("o_orderdate").cast("double").alias("f3"), F.substring("o_orderpriority", 1, 1).cast("double").alias("f4"), F.nullif(F.col("c_nationkey") % 5, F.lit(0)).cast("double").alias("f5"),
    )


def rows_of(spark: SparkSession, d: str, parties: int = 1) -> DataFrame:
    t = feature_table(spark, d)
    return text.from_columns(t, "row_id", "y", [f"f{k}" for k in range(N)]).withColumn("party_id", F.pmod("row_id", F.lit(parties)).cast("int"))


def long_of(spark: SparkSession, d: str, parties: int = 1) -> DataFrame:
    return rows_of(spark, d, parties).select("row_id", "party_id", F.inline("features"))


def frame_of(spark: SparkSession, d: str, params: Params = RANGE, parties: int = 1) -> tuple[DataFrame, list[list[float]]]:
    """(binned rows with g and h of the first round, cuts)."""
    rows = rows_of(spark, d, parties)
    c = trainer.propose_cuts(rows, N, params)
    b = trainer.binned(rows, c).withColumn("margins", F.array(F.lit(0.0)))
    return trainer.gradients(b, params, 0).withColumn("nid", F.lit(0)), c


W = f"WITH {sqlgen.FEATURES}"
RB = f"{W}, {sqlgen.cuts('range', BINS)}"
DB = f"{W}, {sqlgen.cuts('distinct', BINS)}"
G0 = "grad AS (SELECT row_id, 0 AS nid, round((0.0::DOUBLE - y) * 1000000)::BIGINT AS g, 1000000::BIGINT AS h FROM feat)"
L0 = f"{RB}, {G0}, {sqlgen.level('grad', '')}"


# sources and layouts


@query("src_3_columns_as_rows", f"{W} SELECT row_id, count(*)::BIGINT AS n, min(fid)::INTEGER AS first_fid, sum(val) AS total FROM (SELECT * FROM long ORDER BY row_id, fid) GROUP BY row_id")
def src_3(spark, d):
    v = F.transform("features", lambda c: c["val"])
    return rows_of(spark, d).select("row_id", F.size("features").cast("long").alias("n"), F.col("features")[0]["fid"].alias("first_fid"), F.aggregate(v, F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("lay_1_long_form", f"{W} SELECT fid::INTEGER AS fid, count(*)::BIGINT AS n, min(val) AS lo, max(row_id)::BIGINT AS last_row FROM long GROUP BY fid")
def lay_1(spark, d):
    return layout.to_columns(rows_of(spark, d)).groupBy("fid").agg(F.count("*").alias("n"), F.min("val").alias("lo"), F.max("row_id").alias("last_row"))


@query("lay_2_row_form", f"{W} SELECT row_id, string_agg(fid::VARCHAR, ',' ORDER BY fid) AS fids FROM long GROUP BY row_id")
def lay_2(spark, d):
    back = layout.to_rows(layout.to_columns(rows_of(spark, d)))
    return back.select("row_id", F.array_join(F.transform("features", lambda c: c["fid"].cast("string")), ",").alias("fids"))


@query("lay_3_subset", f"{W} SELECT row_id, y FROM feat WHERE row_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def lay_3(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("row_id"))
    return layout.subset(rows_of(spark, d), ids).select("row_id", "y")


@query("lay_4_group_labels", "SELECT substr(o_orderpriority, 1, 1)::DOUBLE AS y, (row_number() OVER (ORDER BY min(o_orderkey)) - 1)::INTEGER AS label FROM orders GROUP BY 1")
def lay_4(spark, d):
    return layout.group_labels(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.substring("o_orderpriority", 1, 1).cast("double").alias("y")))


@query("lay_7_sorted_columns", f"{W} SELECT fid::INTEGER AS fid, val, row_id, (row_number() OVER (ORDER BY fid, val DESC, row_id) - 1)::BIGINT AS place FROM long")
def lay_7(spark, d):
    """With each value's place in the sorted table: the tasks before it count whole, its own up to it."""
    tagged = layout.sort_columns(layout.to_columns(rows_of(spark, d))).select("fid", "val", "row_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = tagged.groupBy("p").agg(F.count("*").alias("n"), F.min("m").alias("base"))
    starts = sizes.select("p", "base", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("start"))  # a row for each task
    return tagged.join(F.broadcast(starts), "p").select("fid", "val", "row_id", (F.col("start") + F.col("m") - F.col("base")).alias("place"))


@query("lay_8_train_test_split", "SELECT o_orderkey AS row_id FROM orders JOIN customer ON o_custkey = c_custkey")
def lay_8(spark, d):
    """Members: what both parts hold together, each row once, if the training part has its three quarters."""
    split = layout.train_test_split(rows_of(spark, d)).select("row_id", "is_train").persist(StorageLevel.MEMORY_AND_DISK)
    n, train = split.agg(F.count("*"), F.sum(F.col("is_train").cast("long"))).first()
    return split.where("is_train").select("row_id").unionByName(split.where("NOT is_train").select("row_id")) if train == n * 3 // 4 else split.limit(0).select("row_id")


# partitioners


@query("par_1_horizontal")
def par_1(spark, d):
    return partition.horizontal(rows_of(spark, d), 4).groupBy("party_id").agg(F.count("*").alias("n"))


@query("par_1_by_key", f"{W} SELECT (row_id % 4)::INTEGER AS party_id, count(*)::BIGINT AS n, max(y) AS top FROM feat GROUP BY 1")
def par_1_key(spark, d):
    return partition.horizontal_by_key(rows_of(spark, d), 4).groupBy("party_id").agg(F.count("*").alias("n"), F.max("y").alias("top"))


@query("par_2_vertical", f"{W} SELECT least(fid // 2, 2)::INTEGER AS party_id, fid::INTEGER AS fid, (fid - least(fid // 2, 2) * 2)::INTEGER AS local_fid, count(*)::BIGINT AS n FROM long GROUP BY fid")
def par_2(spark, d):
    return partition.vertical(layout.to_columns(rows_of(spark, d)), N, 3).groupBy("party_id", "fid", "local_fid").agg(F.count("*").alias("n"))


@query("par_3_heterogeneous")
def par_3(spark, d):
    return partition.heterogeneous(rows_of(spark, d), 4, 1.0).groupBy("party_id").agg(F.count("*").alias("n"))


@query("par_4_blocks")
def par_4(spark, d):
    return partition.blocks(layout.to_columns(rows_of(spark, d)), N, 3, 4, 2).groupBy("party_id", "fid").agg(F.count("*").alias("n"))


@query("par_5_grid")
def par_5(spark, d):
    return partition.grid(layout.to_columns(rows_of(spark, d)), N, 2, 2).groupBy("party_id", "fid").agg(F.count("*").alias("n"))


@query("par_6_blocks_with_test")
def par_6(spark, d):
    return partition.blocks_with_test(layout.to_columns(rows_of(spark, d)), N, 3, 4, 2).groupBy("party_id", "is_train").agg(F.count("*").alias("n"))


@query("par_7_dirichlet")
def par_7(spark, d):
    return spark.createDataFrame(list(enumerate(partition.dirichlet(0.5, 4, 1))), "party_id int, share double")


# cuts and bins


@query("cut_1_party_ranges", f"{W} SELECT (row_id % 3)::INTEGER AS party_id, fid::INTEGER AS fid, min(val) AS lo, max(val) AS hi FROM long GROUP BY 1, 2")
def cut_1(spark, d):
    return C.feature_range(long_of(spark, d, 3), ("party_id", "fid"))


@query("cut_2_global_ranges", f"{W} SELECT fid::INTEGER AS fid, min(val) AS lo, max(val) AS hi FROM long GROUP BY 1")
def cut_2(spark, d):
    return C.merge_ranges(cut_1(spark, d))


@query("cut_3_range_cuts", f"{RB} SELECT fid::INTEGER AS fid, bid, cut FROM cuts")
def cut_3(spark, d):
    return C.range_cuts(C.feature_range(long_of(spark, d)), BINS)


@query("cut_4_distinct_cuts", f"{DB} SELECT fid::INTEGER AS fid, bid, cut FROM cuts")
def cut_4(spark, d):
    return C.distinct_cuts(long_of(spark, d), BINS)


@query("cut_5_distinct_values", f"{W} SELECT fid::INTEGER AS fid, count(DISTINCT val)::BIGINT AS n FROM long GROUP BY fid")
def cut_5(spark, d):
    return long_of(spark, d).select("fid", "val").distinct().groupBy("fid").agg(F.count("*").alias("n"))


POOLED = f"""{W}, vals AS (SELECT DISTINCT row_id % 3 AS p, fid, val FROM long), placed AS (SELECT *, row_number() OVER (PARTITION BY p, fid ORDER BY val DESC) - 1 AS place, count(*) OVER (PARTITION BY p, fid) AS n FROM vals),
 pooled AS (SELECT DISTINCT fid, val AS cut FROM placed WHERE place % greatest(n // {BINS}, 1) = 0 AND (n < {BINS} OR place // greatest(n // {BINS}, 1) < {BINS})),
 dealt AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY cut = top DESC, {sqlgen.hashed(0, "fid", "round(cut * 1000)::BIGINT")}, cut) AS r FROM (SELECT *, max(cut) OVER (PARTITION BY fid) AS top FROM pooled))
 SELECT fid::INTEGER AS fid, (row_number() OVER (PARTITION BY fid ORDER BY cut DESC) - 1)::INTEGER AS bid, cut FROM dealt WHERE r <= {BINS}"""


@query("cut_6_sampled_party_cuts", POOLED)
def cut_6(spark, d):
    return C.sample_party_cuts(C.distinct_cuts(long_of(spark, d, 3), BINS, ("party_id", "fid")), BINS)


@query("cut_9_sketch_cuts", f"{W} SELECT fid::INTEGER AS fid, count(*)::BIGINT AS n, max(val) AS top, true AS in_bound FROM long GROUP BY fid")
def cut_9(spark, d):
    """Cuts by merged sketches of three parties, against exact ranks: as many values as its share lie at or below a cut, but for a hundredth of them and the values equal to it."""
    long = long_of(spark, d, 3)
    cuts = C.sketch_cuts(C.party_sketches(long), BINS)
    near = long.join(F.broadcast(cuts), "fid")  # cuts: features x bins rows
    ranks = near.groupBy("fid", "bid", "cut").agg(F.sum((F.col("val") < F.col("cut")).cast("long")).alias("below"), F.sum((F.col("val") <= F.col("cut")).cast("long")).alias("upto"), F.count("*").alias("n"))
    shares = F.array(*[F.lit(1 - k / BINS) for k in range(BINS)])
    fits = F.exists(shares, lambda s: (s >= F.col("below") / F.col("n") - 0.01) & (s <= F.col("upto") / F.col("n") + 0.01))
    return ranks.withColumn("fits", fits).groupBy("fid").agg(F.max("n").alias("n"), F.max("cut").alias("top"), F.bool_and("fits").alias("in_bound"))


@query("bin_1_bins", f"{RB} SELECT fid::INTEGER AS fid, bid, count(*)::BIGINT AS n, min(row_id)::BIGINT AS first_row FROM bins GROUP BY fid, bid")
def bin_1(spark, d):
    return C.bin_long(long_of(spark, d), cut_3(spark, d)).groupBy("fid", "bid").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query("bin_1_dense", f"{DB} SELECT fid::INTEGER AS fid, bid, count(*)::BIGINT AS n FROM bins GROUP BY fid, bid")
def bin_1_dense(spark, d):
    rows = rows_of(spark, d)
    return trainer.binned(rows, trainer.propose_cuts(rows, N, BASE)).select(F.posexplode("bins").alias("fid", "bid")).where("bid is not null").groupBy("fid", "bid").agg(F.count("*").alias("n"))


# objectives: order keys as rows, a margin made of the customer's balance


def scored(spark, d, classes: int = 1) -> DataFrame:
    t = feature_table(spark, d)
    m = F.array(*[F.col("f0") / 4096 * (k + 1) - 1.0 for k in range(classes)])
    return t.select("row_id", "y", (F.col("f1") % 2).alias("b"), (F.col("f1") % 3).alias("c"), F.col("f1").alias("grade"), F.col("o_custkey").alias("group_id"), m.alias("margins"))


M = "f0 / 4096 - 1.0::DOUBLE"


def _gradient(spark, d, name: str, label: str, k: int = 0, classes: int = 1, places: int = 6) -> DataFrame:
    g, h = objectives.OBJECTIVES[name].gradient(F.col(label), F.col("margins"), k, 0.0)
    return scored(spark, d, classes).select("row_id", F.round(g, places).alias("g"), F.round(h, places).alias("h"))


@query("obj_1_linear", f"{W} SELECT row_id, round({M} - y, 4) AS g, 1.0::DOUBLE AS h FROM feat")
def obj_1(spark, d):
    return _gradient(spark, d, "reg:linear", "y", places=4)


LOGIT = f"{W} SELECT row_id, round(p - f1 % 2, 6) AS g, round(greatest(p * (1 - p), 1e-16), 6) AS h FROM (SELECT *, 1 / (1 + exp(-({M}))) AS p FROM feat)"


@query("obj_2_reg_logistic", LOGIT)
def obj_2(spark, d):
    return _gradient(spark, d, "reg:logistic", "b")


@query("obj_3_binary_logistic", LOGIT)
def obj_3(spark, d):
    return _gradient(spark, d, "binary:logistic", "b")


E3 = ", ".join(f"exp(f0 / 4096 * {k} - 1.0::DOUBLE - greatest(f0 / 4096 * 1, f0 / 4096 * 3) + 1.0::DOUBLE) AS e{k}" for k in (1, 2, 3))


@query("obj_4_softmax", f"{W} SELECT row_id, round(p - (f1 % 3 = 1)::INTEGER, 6) AS g, round(greatest(2 * p * (1 - p), 1e-16), 6) AS h FROM (SELECT *, e2 / (e1 + e2 + e3) AS p FROM (SELECT *, {E3} FROM feat))")
def obj_4(spark, d):
    return _gradient(spark, d, "multi:softmax", "c", 1, 3)


@query("obj_5_softprob", f"{W} SELECT row_id, round(e1 / (e1 + e2 + e3), 6) AS p0, round(e2 / (e1 + e2 + e3), 6) AS p1, round(e3 / (e1 + e2 + e3), 6) AS p2 FROM (SELECT *, {E3} FROM feat)")
def obj_5(spark, d):
    p = objectives.OBJECTIVES["multi:softprob"].transform(F.col("margins"))
    return scored(spark, d, 3).select("row_id", *[F.round(p[k], 6).alias(f"p{k}") for k in range(3)])


def _rank(spark, d, ndcg: bool) -> DataFrame:
    s = scored(spark, d).select("row_id", (F.col("row_id") % 20).alias("group_id"), (F.col("grade") % 4).alias("y"), F.col("margins")[0].alias("margin"))
    return objectives.rank_gradients(s, ndcg).select("row_id", (F.round("g", 6) + 0.0).alias("g"), F.round("h", 6).alias("h"))


def _rank_sql(ndcg: bool) -> str:
    return f"{W}, graded AS (SELECT row_id, row_id % 20 AS grp, f1 % 4 AS y, {M} AS s FROM feat), {sqlgen.ranked('graded', ndcg)} SELECT row_id, round(coalesce(g, 0), 6) + 0.0::DOUBLE AS g, round(coalesce(h, 0), 6) AS h FROM graded LEFT JOIN pushed USING (row_id)"


@query("obj_6_rank_pairwise", _rank_sql(False))
def obj_6(spark, d):
    return _rank(spark, d, False)


@query("obj_7_rank_ndcg", _rank_sql(True))
def obj_7(spark, d):
    return _rank(spark, d, True)


# trees


@query("tre_1_root_sum", f"{W}, {G0} SELECT nid, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h, count(*)::BIGINT AS n FROM grad GROUP BY nid")
def tre_1(spark, d):
    return H.node_sums(frame_of(spark, d)[0])


@query("tre_3_level_histogram", f"{RB}, {G0}, moved AS (SELECT row_id, row_id % 4 + 3 AS nid, g, h FROM grad) SELECT nid::INTEGER AS nid, fid::INTEGER AS fid, bid, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h FROM moved JOIN bins USING (row_id) GROUP BY nid, fid, bid")
def tre_3(spark, d):
    return H.level_histogram(frame_of(spark, d)[0].withColumn("nid", (F.col("row_id") % 4 + 3).cast("int")))


@query("tre_4_sibling_by_subtraction", f"{RB}, {G0} SELECT fid::INTEGER AS fid, bid, sum(CASE WHEN row_id % 3 = 0 THEN 0 ELSE g END)::BIGINT AS g, sum(CASE WHEN row_id % 3 = 0 THEN 0 ELSE h END)::BIGINT AS h FROM grad JOIN bins USING (row_id) GROUP BY fid, bid")
def tre_4(spark, d):
    rows = frame_of(spark, d)[0]
    return H.subtract(H.node_histogram(rows), H.node_histogram(rows.where("row_id % 3 = 0")))


@query("tre_6_prefix_sums", f"{L0} SELECT nid, fid::INTEGER AS fid, bid, rg, rh FROM pre")
def tre_6(spark, d):
    return H.prefix_sums(H.level_histogram(frame_of(spark, d)[0])).select("nid", "fid", "bid", "rg", "rh")


@query("tre_7_missing_sums", f"{L0} SELECT DISTINCT nid, fid::INTEGER AS fid, mg, mh FROM pre")
def tre_7(spark, d):
    rows = frame_of(spark, d)[0]
    return H.missing_sums(H.level_histogram(rows), H.node_sums(rows)).select("nid", "fid", "mg", "mh").distinct()


@query("tre_8_gains", f"{L0} SELECT nid, fid::INTEGER AS fid, bid, round(gain, 6) + 0.0::DOUBLE AS gain FROM gains")
def tre_8(spark, d):
    rows = frame_of(spark, d)[0]
    return splits.with_gain(H.level_histogram(rows), H.node_sums(rows), 1.0, 1.0).select("nid", "fid", "bid", (F.round("gain", 6) + 0.0).alias("gain"))


BEST = f"{L0} SELECT nid, fid::INTEGER AS fid, bid, round(gain, 6) AS gain, default_right, rg, rh, mg, mh, cut FROM best JOIN cuts USING (fid, bid)"


@query("tre_10_best_split", BEST)
@query("entry_best_split", BEST)
def best_split(spark, d):
    """The flagship: ranges, cuts, bins, gradients, one histogram, and the split of the root."""
    rows, c = frame_of(spark, d)
    best = splits.best_splits(splits.with_gain(H.level_histogram(rows), H.node_sums(rows), 1.0, 1.0))
    cut = F.array(*[F.array(*map(F.lit, f)) for f in c])[F.col("fid")][F.col("bid")]
    return best.select("nid", "fid", "bid", F.round("gain", 6).alias("gain"), "default_right", "rg", "rh", "mg", "mh", cut.alias("cut"))


def _grown(spark, d, params: Params, parties: int = 1, structure=None):
    rows, c = frame_of(spark, d, params, parties)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # read by every level
    return rows, trainer.Grower(rows, params, c, 1, parties).grow(structure=structure)


LEAVES = f"{RB}, {G0}, {sqlgen.tree('grad', 3)} SELECT nid::INTEGER AS nid, round(weight, 6) AS weight, count(*)::BIGINT AS n, min(row_id)::BIGINT AS first_row FROM leaf GROUP BY nid, weight"


def _leaves(spark, rows, tree) -> DataFrame:
    w = spark.createDataFrame([(x.nid, x.weight) for x in tree.leaves()], "nid int, weight double")
    routed = rows.select("row_id", node_id(tree, by_bin()).alias("nid")).groupBy("nid").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))
    return routed.join(F.broadcast(w), "nid").select("nid", F.round("weight", 6).alias("weight"), "n", "first_row")  # a row for each leaf


@query("tre_16_tree", LEAVES)
def tre_16(spark, d):
    return _leaves(spark, *_grown(spark, d, RANGE))


@query("tre_14_routes", f"{RB}, {G0}, {sqlgen.tree('grad', 2)} SELECT row_id, nid::INTEGER AS nid FROM leaf")
def tre_14(spark, d):
    rows, tree = _grown(spark, d, RANGE.replace(depth=2))
    return rows.select("row_id", node_id(tree, by_bin()).alias("nid"))


PRUNED = f"{RB}, {G0}, {sqlgen.tree('grad', 3)}, {sqlgen.pruned(20_000.0)} SELECT nid::INTEGER AS nid, round(-(sum(g)::BIGINT / 1000000.0::DOUBLE) / (sum(h)::BIGINT / 1000000.0::DOUBLE + 1.0), 6) AS weight, count(*)::BIGINT AS n, min(row_id)::BIGINT AS first_row FROM final JOIN grad USING (row_id) GROUP BY final.nid"


@query("tre_17_pruned_tree", PRUNED.replace("SELECT nid::INTEGER AS nid, round(-", "SELECT final.nid::INTEGER AS nid, round(-"))
def tre_17(spark, d):
    return _leaves(spark, *_grown(spark, d, RANGE.replace(gamma=20_000.0)))


@query("tre_20_subtree", f"{RB}, {G0}, {sqlgen.tree('grad', 2)}, s AS (SELECT leaf.nid, g, h FROM leaf JOIN grad USING (row_id)) SELECT nid::INTEGER AS nid, count(*)::BIGINT AS n, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h FROM s GROUP BY nid")
def tre_20(spark, d):
    rows, c = frame_of(spark, d)
    _, routed = trainer.train_subtree(rows.select("row_id", "party_id", "bins", "g", "h"), RANGE, c, 2)
    return routed.groupBy("nid").agg(F.count("*").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))


@query("tre_21_below_the_root", f"{RB}, {G0}, structure AS (SELECT * FROM (VALUES (0, 2), (1, 3), (2, 0), (6, 4)) v(nid, fid)), {sqlgen.tree('grad', 3, lam=0.0, structure='structure')} SELECT nid::INTEGER AS nid, round(weight, 6) AS weight, count(*)::BIGINT AS n, min(row_id)::BIGINT AS first_row FROM leaf GROUP BY nid, weight")
def tre_21_below(spark, d):
    return _leaves(spark, *_grown(spark, d, RANGE.replace(reg_lambda=0.0), structure={0: 2, 1: 3, 2: 0, 6: 4}))


@query("tre_21_predefined_structure", f"{RB}, {G0}, {sqlgen.level('grad', '')} SELECT 0 AS nid, 2 AS fid, bid, round(abs(gain), 6) AS gain FROM (SELECT *, row_number() OVER (ORDER BY abs(gain) DESC, bid) AS r FROM gains WHERE fid = 2) WHERE r = 1")
def tre_21(spark, d):
    rows, c = frame_of(spark, d)
    hist = H.structured_histogram(rows, {0: 2})
    return splits.best_splits(splits.with_gain(hist, H.node_sums(rows), 1.0, 1.0)).select("nid", "fid", "bid", (F.round("gain", 6) + 0.0).alias("gain"))


PASSED = f"""{W}, long1 AS (SELECT * FROM long WHERE fid <> 0), {sqlgen.cuts("range", BINS, "long1", "1")}, {G0}, structure AS (SELECT * FROM (VALUES (0, 1), (1, 0), (2, 3), (3, 2), (5, 4)) v(nid, fid)), passing AS (SELECT nid FROM structure WHERE fid NOT IN (SELECT fid FROM cuts1)),
 {sqlgen.tree("grad", 3, lam=0.0, bins="bins1", structure="structure", passing="passing")} SELECT nid::INTEGER AS nid, round(weight, 6) AS weight, count(*)::BIGINT AS n, min(row_id)::BIGINT AS first_row FROM leaf GROUP BY nid, weight"""


@query("tre_22_pass_through", PASSED)
def tre_22(spark, d):
    """A predefined structure over rows that lack one of its features: that node hands all rows on to the next."""
    rows = rows_of(spark, d).withColumn("features", F.filter("features", lambda c: c["fid"] != 0))
    c = trainer.propose_cuts(rows, N, RANGE)
    b = trainer.gradients(trainer.binned(rows, c).withColumn("margins", F.array(F.lit(0.0))), RANGE, 0).persist(StorageLevel.MEMORY_AND_DISK)
    return _leaves(spark, b, trainer.Grower(b, RANGE.replace(reg_lambda=0.0), c, 1).grow(structure={0: 1, 1: 0, 2: 3, 3: 2, 5: 4}))


# merges


MERGED = f"{RB}, {G0} SELECT 0 AS nid, fid::INTEGER AS fid, bid, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h FROM grad JOIN bins USING (row_id) GROUP BY fid, bid"


def _party_hist(spark, d, parties=3):
    return H.level_histogram(frame_of(spark, d, RANGE, parties)[0], ("party_id",))


@query("mrg_1_merge", MERGED)
def mrg_1(spark, d):
    return H.merge(_party_hist(spark, d))


#: A party's bin counts for a common bin by the share of its width inside it.
MOVED = f"""{RB}, {G0}, own AS (SELECT row_id % 3 AS p, fid, min(val) AS l, max(val) AS u FROM long GROUP BY 1, 2),
 pc AS (SELECT p, fid, bid, u - bid * (u - l) / n AS cut FROM (SELECT *, CASE WHEN u = l THEN 1 ELSE {BINS} END AS n FROM own), LATERAL (SELECT unnest(generate_series(0, n - 1)) AS bid)),
 pb AS (SELECT row_id, p, pc.fid, least(count(*) FILTER (WHERE cut - 1e-6 > val), count(*) - 1) AS bid FROM long l JOIN pc ON pc.p = l.row_id % 3 AND pc.fid = l.fid GROUP BY row_id, p, pc.fid),
 ph AS (SELECT p, fid, bid, sum(g)::DOUBLE AS g, sum(h)::DOUBLE AS h FROM pb JOIN grad USING (row_id) GROUP BY p, fid, bid),
 mine AS (SELECT p, fid, bid, CASE WHEN lead(cut) OVER w IS NULL THEN least(lo, cut) ELSE cut END AS a0, coalesce(lag(cut) OVER w, greatest(hi, cut)) AS a1 FROM pc JOIN ranges USING (fid) WINDOW w AS (PARTITION BY p, fid ORDER BY bid)),
 ours AS (SELECT fid, bid, CASE WHEN lead(cut) OVER w IS NULL THEN least(lo, cut) ELSE cut END AS b0, coalesce(lag(cut) OVER w, greatest(hi, cut)) AS b1 FROM cuts JOIN ranges USING (fid) WINDOW w AS (PARTITION BY fid ORDER BY bid)),
 shares AS (SELECT p, fid, m.bid, o.bid AS dest, CASE WHEN a0 = a1 THEN (a0 >= b0 AND (a0 < b1 OR o.bid = 0))::INT::DOUBLE ELSE greatest(least(a1, b1) - greatest(a0, b0), 0) / (a1 - a0) END AS share FROM mine m JOIN ours o USING (fid))
 SELECT 0 AS nid, fid::INTEGER AS fid, dest AS bid, round(sum(g * share) / 1000000, 3) AS g, round(sum(h * share) / 1000000, 3) AS h FROM ph JOIN shares USING (p, fid, bid) WHERE share > 0 GROUP BY fid, dest"""


@query("mrg_2_interpolated_merge", MOVED)
def mrg_2(spark, d):
    long = long_of(spark, d, 3)
    own = C.feature_range(long, ("party_id", "fid"))
    party_cuts = reduce(DataFrame.unionByName, [C.range_cuts(own.where(F.col("party_id") == p), BINS).withColumn("party_id", F.lit(p)) for p in range(3)])
    arrays = party_cuts.groupBy("party_id", "fid").agg(F.reverse(F.array_sort(F.collect_list("cut"))).alias("cuts"))
    g = frame_of(spark, d, RANGE, 3)[0].select("row_id", "g", "h")
    hist = long.join(F.broadcast(arrays), ["party_id", "fid"]).join(g, "row_id").groupBy("party_id", F.lit(0).alias("nid"), "fid", C.bin_of(F.col("val"), F.col("cuts")).alias("bid")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))  # arrays: parties x features rows
    ranges = C.merge_ranges(own)
    moved = H.merge_interpolated(hist, party_cuts, C.range_cuts(ranges, BINS), ranges)
    return moved.select("nid", "fid", "bid", *[F.round(F.col(c) / H.UNIT, 3).alias(c) for c in ("g", "h")])


@query("mrg_4_vertical_concat", MERGED)
def mrg_4(spark, d):
    hist = H.level_histogram(frame_of(spark, d)[0])
    parts = [hist.where(F.col("fid").between(a, a + 1)).withColumn("fid", F.col("fid") - a) for a in (0, 2, 4)]
    return H.concat_vertical(parts, [2, 2, 2])


@query("mrg_5_winner_owner", f"{L0} SELECT nid, (fid // 2)::INTEGER AS party_id, (fid % 2)::INTEGER AS local_fid, bid FROM best")
def mrg_5(spark, d):
    return H.owner_of(best_split(spark, d), partition.vertical_owner(N, 3)).select("nid", "party_id", "local_fid", "bid")


@query("mrg_9_mean_party_score", f"{W} SELECT round(avg(r), 6) AS rmse FROM (SELECT sqrt(avg(({M} - y) * ({M} - y))) AS r FROM feat GROUP BY row_id % 3)")
def mrg_9(spark, d):
    s = scored(spark, d).withColumn("e", (F.col("margins")[0] - F.col("y")) ** 2)
    return metrics.mean_over_parties(s.groupBy(F.col("row_id") % 3).agg(F.sqrt(F.avg("e")).alias("rmse")), "rmse").select(F.round("rmse", 6).alias("rmse"))


# training and scoring


def _margins(forest, spark, d) -> DataFrame:
    return P.margins(rows_of(spark, d), forest).select("row_id", F.round(F.col("margins")[0], 6).alias("margin"))


def _trained_sql(prefix: str, rounds: int = 2) -> str:
    return f"{prefix}, {sqlgen.boosted(rounds, 3, 0.5)} SELECT row_id, round(m, 6) AS margin FROM margin_{rounds}"


def _training_margins(spark, d, params, parties=1):
    rows = rows_of(spark, d, parties)
    c = trainer.propose_cuts(rows, N, params)
    _, out = trainer.boost(trainer.binned(rows, c), params, c, n_parties=params.n_parties)
    return out.select("row_id", F.round(F.col("margins")[0], 6).alias("margin"))


@query("trn_1_centralized", _trained_sql(DB))
def trn_1(spark, d):
    return _training_margins(spark, d, BASE)


@query("trn_2_horizontal", _trained_sql(RB))
def trn_2(spark, d):
    return _training_margins(spark, d, RANGE, 3)


@query("trn_2_horizontal_secure_aggregation", _trained_sql(RB))
def trn_2_sa(spark, d):
    return _training_margins(spark, d, RANGE.replace(privacy="sa"), 3)


@query("trn_3_vertical", _trained_sql(DB))
def trn_3(spark, d):
    """Two parties with three features each, the second with the labels; their features never meet in a frame."""
    t = feature_table(spark, d)
    parts = [text.from_columns(t, "row_id", y, [f"f{k}" for k in range(a, a + 3)]) for a, y in ((0, None), (3, "y"))]
    _, out = vertical.train_vertical(parts, BASE.replace(mode="vertical", n_parties=2), [3, 3])
    return out.select("row_id", F.round(F.col("margins")[0], 6).alias("margin"))


#: Party 1 lacks feature 0, which party 0's own tree splits.
HYBRID = BASE.replace(mode="hybrid", n_parties=2, n_trees=1, depth=2, reg_lambda=0.0)


def _hybrid_sql() -> str:
    out = [W]
    for p in range(2):
        out += [f"long{p} AS (SELECT * FROM long WHERE row_id % 2 = {p}{' AND fid <> 0' if p else ''})", sqlgen.cuts("distinct", BINS, f"long{p}", str(p)), f"grad{p} AS (SELECT row_id, round((0.0::DOUBLE - y) * 1000000)::BIGINT AS g, 1000000::BIGINT AS h FROM feat WHERE row_id % 2 = {p})"]
        out.append(sqlgen.tree(f"grad{p}", 2, f"_l{p}", 0.0, bins=f"bins{p}"))
    out.append(sqlgen.merged_structure(["_l0", "_l1"], ["grad0", "grad1"]))
    for p in range(2):
        out += [f"passing{p} AS (SELECT nid FROM structure WHERE fid NOT IN (SELECT fid FROM cuts{p}))", sqlgen.tree(f"grad{p}", 2, f"_h{p}", 0.0, bins=f"bins{p}", structure="structure", passing=f"passing{p}"), sqlgen.routed(f"grad{p}", 2, f"_h{p}", f"w{p}", f"cuts{p}", passing=f"passing{p}")]
    return f"{', '.join(out)} SELECT row_id, round(0.5 * weight, 6) AS margin FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1)"


@query("trn_4_hybrid", _hybrid_sql())
def trn_4(spark, d):
    """Each row by its own party's forest, over the structure merged from both."""
    rows = rows_of(spark, d, 2).withColumn("features", F.filter("features", lambda c: ~((F.col("party_id") == 1) & (c["fid"] == 0))))
    return P.margins_by_party(rows, trainer.train(rows, HYBRID)).select("row_id", F.round(F.col("margins")[0], 6).alias("margin"))


def _own_trees(n: int) -> str:
    """Each party's cuts and first tree of its own rows, and the weights of all rows in it (w0, w1)."""
    out = [W]
    for p in range(n):
        out += [f"long{p} AS (SELECT * FROM long WHERE row_id % {n} = {p})", sqlgen.cuts("distinct", BINS, f"long{p}", str(p)), f"grad{p} AS (SELECT row_id, round((0.0::DOUBLE - y) * 1000000)::BIGINT AS g, 1000000::BIGINT AS h FROM feat WHERE row_id % {n} = {p})"]
        out += [sqlgen.tree(f"grad{p}", 3, f"_p{p}", bins=f"bins{p}"), sqlgen.routed("feat", 3, f"_p{p}", f"w{p}", f"cuts{p}")]
    return ", ".join(out)


@query("trn_5_ensemble", f"{_own_trees(2)} SELECT row_id, round(0.5 * w0.weight + 0.5 * w1.weight, 6) AS margin FROM w0 JOIN w1 USING (row_id)")
def trn_5(spark, d):
    return _margins(trainer.train(rows_of(spark, d, 2), BASE.replace(mode="ensemble", n_parties=2)), spark, d)


@query("trn_6_solo", f"{_own_trees(2)} SELECT (row_id % 2)::INTEGER AS party_id, round(sqrt(avg((0.5 * w - y) * (0.5 * w - y))), 6) AS rmse FROM (SELECT row_id, y, CASE WHEN row_id % 2 = 0 THEN w0.weight ELSE w1.weight END AS w FROM feat JOIN w0 USING (row_id) JOIN w1 USING (row_id)) GROUP BY 1")
def trn_6(spark, d):
    rows = rows_of(spark, d, 2)
    scored = P.margins_by_party(rows, trainer.train(rows, BASE.replace(mode="solo", n_parties=2, n_trees=1)))
    e = F.col("margins")[0] - F.col("y")
    return scored.groupBy("party_id").agg(F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


def _slice(t: int, margin: str) -> str:
    """CTEs of a round's slice of the rows: its cuts, gradients and tree."""
    mine = f"{sqlgen.hashed(42, 'row_id')} % 2 = {t}"
    grad = f"g{t} AS (SELECT row_id, round(({margin} - y) * 1000000)::BIGINT AS g, 1000000::BIGINT AS h FROM feat JOIN m{t} USING (row_id) WHERE {mine})"
    return f"long{t} AS (SELECT * FROM long WHERE {mine}), {sqlgen.cuts('distinct', BINS, f'long{t}', str(t))}, {grad}, {sqlgen.tree(f'g{t}', 3, f'_s{t}', bins=f'bins{t}')}"


#: The second round's cuts come from other rows than the first's; trees move all rows by value.
BAGGED = f"""{W}, m0 AS (SELECT row_id, 0.0::DOUBLE AS m FROM feat), {_slice(0, "m")}, {sqlgen.routed("feat", 3, "_s0", "w0", "cuts0")}, m1 AS (SELECT row_id, 0.5 * weight AS m FROM w0), {_slice(1, "m")}, {sqlgen.routed("feat", 3, "_s1", "w1", "cuts1")}
 SELECT row_id, round(0.25 * w0.weight + 0.25 * w1.weight, 6) AS margin FROM w0 JOIN w1 USING (row_id)"""


@query("trn_9_bagging", BAGGED)
def trn_9(spark, d):
    return _margins(trainer.train(rows_of(spark, d), BASE.replace(bagging=True, bagging_fraction=0.5)), spark, d)


@query("trn_dp_private")
def trn_dp(spark, d):
    return _margins(trainer.train(rows_of(spark, d), BASE.replace(mode="vertical", privacy="dp", n_trees=1)), spark, d)


#: Scoring compares values with cuts; values below every cut part from training here.
PRD = f"""{RB}, {G0}, {sqlgen.level('grad', '')},
 s AS (SELECT b.fid, cut, default_right, pg, ph, rg + CASE WHEN default_right THEN mg ELSE 0 END AS rg, rh + CASE WHEN default_right THEN mh ELSE 0 END AS rh FROM best b JOIN cuts USING (fid, bid) JOIN node USING (nid)),
 v AS (SELECT f.row_id, coalesce(l.val - s.cut >= -1e-6, s.default_right) AS r, s.* FROM feat f CROSS JOIN s LEFT JOIN long l ON l.row_id = f.row_id AND l.fid = s.fid),
 w AS (SELECT row_id, CASE WHEN r THEN 2 ELSE 1 END AS nid, CASE WHEN r THEN -(rg / 1000000.0::DOUBLE) / (rh / 1000000.0::DOUBLE + 1.0) ELSE -((pg - rg) / 1000000.0::DOUBLE) / ((ph - rh) / 1000000.0::DOUBLE + 1.0) END AS weight FROM v)"""
STUMP = RANGE.replace(depth=1, n_trees=1)


def _stump(spark, d):
    return trainer.train(rows_of(spark, d, 3), STUMP)


@query("prd_1_margins", f"{PRD} SELECT row_id, round(0.5 * weight, 6) AS margin FROM w")
def prd_1(spark, d):
    return _margins(_stump(spark, d), spark, d)


@query("prd_3_vertical_margins", f"{PRD} SELECT row_id, round(0.5 * weight, 6) AS margin FROM w")
def prd_3(spark, d):
    t = feature_table(spark, d)
    parts = [text.from_columns(t, "row_id", None, [f"f{k}" for k in range(a, a + 3)]) for a in (0, 3)]
    return P.predict_vertical(parts, _stump(spark, d), [3, 3]).select("row_id", F.round(F.col("margins")[0], 6).alias("margin"))


@query("prd_5_leaves", f"{PRD} SELECT row_id, nid::INTEGER AS leaf FROM w")
def prd_5(spark, d):
    return P.predict_leaves(rows_of(spark, d), _stump(spark, d)).select("row_id", F.col("leaves")[0][0].alias("leaf"))


#: Where a large forest made by rule cuts each feature, from and how far.
SPANS = [(-1000, 11000), (0, 25), (1, 12), (1, 31), (1, 5), (1, 4)]
LARGE_TREES, LARGE_DEPTH = 40, 6


def large_forest() -> trainer.Forest:
    """40 trees of depth 6 by rule: 2,560 leaves, whose weights are 64ths, so sums are exact in any order."""
    trees = []
    for t in range(LARGE_TREES):
        tree = Tree(0, 0, 1.0)
        for nid in range(2 ** (LARGE_DEPTH + 1) - 1):
            lo, far = SPANS[(t + nid) % N]
            leaf = nid >= 2**LARGE_DEPTH - 1
            tree.nodes[nid] = Node(nid, 0, 0, weight=((31 * t + 17 * nid) % 101 - 50) / 64, fid=-1 if leaf else (t + nid) % N, cut=lo + far * ((7 * t + 13 * nid) % 16) / 16, default_right=(t + nid) % 2 == 1, is_leaf=leaf)
        trees.append([tree])
    return trainer.Forest(BASE.replace(n_trees=LARGE_TREES, depth=LARGE_DEPTH, learning_rate=0.5), trees, N)


def _large_sql() -> str:
    spans = ", ".join(f"({k}, {lo}, {far})" for k, (lo, far) in enumerate(SPANS))
    out = [f"{W}, span AS (SELECT * FROM (VALUES {spans}) v(fid, lo, far))", f"node AS (SELECT t, nid, fid, lo + far * ((7 * t + 13 * nid) % 16) / 16.0::DOUBLE AS cut, (t + nid) % 2 = 1 AS dr FROM range({LARGE_TREES}) a(t), range({2**LARGE_DEPTH - 1}) b(nid) JOIN span ON span.fid = (t + nid) % {N})"]
    out.append(f"at_0 AS (SELECT row_id, t, 0 AS nid FROM feat, range({LARGE_TREES}) a(t))")
    out += [f"at_{k + 1} AS (SELECT a.row_id, a.t, 2 * a.nid + CASE WHEN coalesce(l.val - n.cut >= -1e-6, n.dr) THEN 2 ELSE 1 END AS nid FROM at_{k} a JOIN node n ON n.t = a.t AND n.nid = a.nid LEFT JOIN long l ON l.row_id = a.row_id AND l.fid = n.fid)" for k in range(LARGE_DEPTH)]
    return ", ".join(out)


@query("prd_1_large_forest", f"{_large_sql()} SELECT row_id, round(sum(0.5 * ((31 * t + 17 * nid) % 101 - 50) / 64.0::DOUBLE), 6) AS margin FROM at_{LARGE_DEPTH} GROUP BY row_id")
def prd_1_large(spark, d):
    return _margins(large_forest(), spark, d)


@query("prd_5_large_forest", f"{_large_sql()} SELECT row_id, string_agg(nid::VARCHAR, ',' ORDER BY t) AS leaves FROM at_{LARGE_DEPTH} GROUP BY row_id")
def prd_5_large(spark, d):
    leaves = F.transform(F.flatten("leaves"), lambda x: x.cast("string"))
    return P.predict_leaves(rows_of(spark, d), large_forest()).select("row_id", F.array_join(leaves, ",").alias("leaves"))


@query("prd_7_score", f"{PRD} SELECT round(sqrt(avg((0.5 * weight - y) * (0.5 * weight - y))), 6) AS rmse FROM w JOIN feat USING (row_id)")
def prd_7(spark, d):
    return metrics.rmse(P.margins(rows_of(spark, d), _stump(spark, d)).withColumn("margin", F.col("margins")[0])).select(F.round("rmse", 6).alias("rmse"))


#: A stump over labels of two classes: the balance's sign and the month.
PRD8 = f"""{RB}, y2 AS (SELECT row_id, (f1 % 2)::DOUBLE AS y FROM feat), gb AS (SELECT row_id, 0 AS nid, round((0.5::DOUBLE - y) * 1000000)::BIGINT AS g, 250000::BIGINT AS h FROM y2), {sqlgen.tree("gb", 2, "_b")}, {sqlgen.routed("feat", 2, "_b", "wb")} SELECT row_id, (0.5 * weight > 0)::INTEGER::DOUBLE AS label FROM wb"""


@query("prd_8_labels", PRD8)
def prd_8(spark, d):
    """Labels by the sign of a trained forest's margins."""
    t = feature_table(spark, d).withColumn("y", F.col("f1") % 2)
    rows = text.from_columns(t, "row_id", "y", [f"f{k}" for k in range(N)]).withColumn("party_id", F.lit(0))
    forest = trainer.train(rows, RANGE.replace(objective="binary:logistic", n_trees=1, depth=2, n_parties=1))
    return P.predict(rows, forest).select("row_id", "label")


def _class_trees(classes: int) -> str:
    """A tree for each label of the embeddings, and the labels' probabilities."""
    out = ["""WITH feat AS (SELECT vec_id AS row_id, label AS y, embedding FROM embeddings WHERE label IS NOT NULL), long AS (SELECT row_id, unnest(generate_series(0, len(embedding) - 1)) AS fid, unnest(embedding)::DOUBLE AS val FROM feat)""", sqlgen.cuts("distinct", BINS)]
    for k in range(classes):
        out += [f"grad{k} AS (SELECT row_id, round((1 / {classes}.0::DOUBLE - (y = {k})::INT) * 1000000)::BIGINT AS g, round(2 / {classes}.0::DOUBLE * (1 - 1 / {classes}.0::DOUBLE) * 1000000)::BIGINT AS h FROM feat)", sqlgen.tree(f"grad{k}", 2, f"_c{k}"), sqlgen.routed("feat", 2, f"_c{k}", f"w{k}")]
    e = ", ".join(f"exp(0.5 * w{k}.weight)" for k in range(classes))
    joined = "w0" + "".join(f" JOIN w{k} USING (row_id)" for k in range(1, classes))
    return f"{', '.join(out)} SELECT row_id, round(list_max(e) / list_sum(e), 6) AS top, (list_position(e, list_max(e)) - 1)::INTEGER AS label FROM (SELECT row_id, [{e}] AS e FROM {joined})"


@query("prd_10_multiclass_probabilities", _class_trees(10))
def prd_10(spark, d):
    e = table(spark, d, "embeddings").where("label is not null")
    rows = e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("y"), F.transform("embedding", lambda v, i: F.struct(i.alias("fid"), v.cast("double").alias("val"))).alias("features"))
    forest = trainer.train(rows, BASE.replace(objective="multi:softprob", num_class=10, n_trees=1, depth=2))
    p = F.col("probabilities")
    return P.predict_probabilities(rows, forest).select("row_id", F.round(F.array_max(p), 6).alias("top"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("label"))


# metrics: events grouped by user, graded by type, scored by value

E = "e AS (SELECT event_id AS row_id, user_id AS group_id, (length(event_type) % 4)::DOUBLE AS y, value AS margin FROM events)"


def graded(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("group_id"), (F.length("event_type") % 4).cast("double").alias("y"), F.col("value").alias("margin"))


@query("met_1_rmse", f"WITH {E} SELECT round(sqrt(avg((margin - y) * (margin - y))), 6) AS rmse FROM e")
def met_1(spark, d):
    return metrics.rmse(graded(spark, d)).select(F.round("rmse", 6).alias("rmse"))


@query("met_2_auc", f"WITH {E}, r AS (SELECT y, rank() OVER (ORDER BY margin) + (count(*) OVER (PARTITION BY margin) - 1) / 2.0 AS r FROM e) SELECT round((sum(CASE WHEN y > 0 THEN r ELSE 0 END) - sum((y > 0)::INT) * (sum((y > 0)::INT) + 1) / 2.0) / (sum((y > 0)::INT) * sum((y <= 0)::INT)), 6)::DOUBLE AS auc FROM r")
def met_2(spark, d):
    return metrics.auc(graded(spark, d)).select(F.round("auc", 6).alias("auc"))


@query("met_3_accuracy", f"{W} SELECT round(avg((f1 % 3 = CASE WHEN f0 >= 0 THEN CASE WHEN f0 = 0 THEN 0 ELSE 2 END ELSE 0 END)::INTEGER), 6) AS accuracy FROM feat")
def met_3(spark, d):
    return metrics.accuracy(scored(spark, d, 3).withColumn("y", F.col("c"))).select(F.round("accuracy", 6).alias("accuracy"))


@query("met_4_map", f"WITH {E}, r AS (SELECT *, row_number() OVER w AS k, sum((y <> 0)::INT) OVER w AS hits FROM e WINDOW w AS (PARTITION BY group_id ORDER BY margin DESC, row_id ROWS UNBOUNDED PRECEDING)), g AS (SELECT group_id, CASE WHEN sum((y <> 0)::INT) = 0 THEN 1.0 ELSE sum(CASE WHEN y <> 0 THEN hits / k ELSE 0 END) / sum((y <> 0)::INT) END AS ap FROM r GROUP BY group_id) SELECT round(avg(ap), 6)::DOUBLE AS map FROM g")
def met_4(spark, d):
    return metrics.mean_average_precision(graded(spark, d)).select(F.round("map", 6).alias("map"))


@query("met_5_ndcg", f"WITH {E}, r AS (SELECT group_id, 2 ** y - 1 AS gain, row_number() OVER (PARTITION BY group_id ORDER BY margin DESC, row_id) AS k, row_number() OVER (PARTITION BY group_id ORDER BY y DESC, row_id) AS b FROM e), g AS (SELECT sum(gain / log2(k + 1)) AS d, sum(gain / log2(b + 1)) AS i FROM r GROUP BY group_id) SELECT round(avg(CASE WHEN i = 0 THEN 1 ELSE d / i END), 6) AS ndcg FROM g")
def met_5(spark, d):
    return metrics.ndcg(graded(spark, d)).select(F.round("ndcg", 6).alias("ndcg"))


@query("met_6_group_offsets", f"WITH {E} SELECT group_id, (sum(count(*)) OVER (ORDER BY group_id) - count(*))::BIGINT AS start, (sum(count(*)) OVER (ORDER BY group_id))::BIGINT AS stop FROM e GROUP BY group_id")
def met_6(spark, d):
    return metrics.group_offsets(graded(spark, d))


# privacy


@query("sa_3_masked_merge", MERGED)
def sa_3(spark, d):
    return H.merge(privacy.mask_histogram(privacy.complete_cells(_party_hist(spark, d), 3), privacy.KeyAgreement(3), "query"))


@query("he_4_encrypted_merge", MERGED)
def he_4(spark, d):
    key = privacy.paillier_keys(512, random.Random(5))
    enc = privacy.encrypt_columns(_party_hist(spark, d), key.public)
    return privacy.decrypt_columns(privacy.sum_encrypted(enc, key.public, ("nid", "fid", "bid")), key)


@query("dp_2_clipped_gradients", f"{W} SELECT row_id, round(greatest(least({M} - y, 1.0), -1.0), 6) AS g FROM feat")
def dp_2(spark, d):
    return scored(spark, d).select("row_id", F.round(privacy.clip(F.col("margins")[0] - F.col("y")), 6).alias("g"))


def _unit(seed: int) -> str:
    return f"(({sqlgen.hashed(seed, 'row_id')} + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"


@query("dp_6_gaussian_noise", f"{W} SELECT row_id, round(y + sqrt(-2 * ln({_unit(7)})) * cos(2 * pi() * {_unit(8)}) * 1.5, 6) AS y FROM feat")
def dp_6(spark, d):
    return privacy.gaussian_noise(rows_of(spark, d).select("row_id", "y"), "y", 2.25, 7).select("row_id", F.round("y", 6).alias("y"))


@query("dp_7_laplace_noise", f"{W} SELECT row_id, round(y - 0.5 * sign(u) * ln(1 - 2 * abs(u)), 6) AS y FROM (SELECT row_id, y, {_unit(7)} - 0.5 AS u FROM feat)")
def dp_7(spark, d):
    return privacy.laplace_noise(rows_of(spark, d).select("row_id", "y"), "y", 0.5, 7).select("row_id", F.round("y", 6).alias("y"))


PRIVATE = f"{L0}, noisy AS (SELECT *, abs(gain) * ({10.0 / 2 / 2 / 3!r}::DOUBLE / 6.0) - ln(-ln(({sqlgen.hashed(3, 'nid', 'fid', 'bid')} + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)) AS score FROM gains) SELECT nid::INTEGER AS nid, fid::INTEGER AS fid, bid, NOT gain > 0 AS default_right FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY score DESC, fid, bid) AS r FROM noisy) WHERE r = 1"


@query("dp_4_private_split", PRIVATE)
def dp_4(spark, d):
    rows = frame_of(spark, d)[0]
    b = privacy.split_budget(10.0, 2, 3, 1.0)
    return splits.private_splits(splits.with_gain(H.level_histogram(rows), H.node_sums(rows), 1.0, 1.0), b.level, b.delta_g, 3).select("nid", "fid", "bid", "default_right")


@query("api_6_leaf_values_by_flag", f"{W}, {G0} SELECT row_id % 4 AS nid, round(-(sum(CASE WHEN row_id % 3 <> 0 THEN g ELSE 0 END)::BIGINT / 1000000.0::DOUBLE) / (sum(CASE WHEN row_id % 3 <> 0 THEN h ELSE 0 END)::BIGINT / 1000000.0::DOUBLE + 1.0), 6) AS left, round(-(sum(CASE WHEN row_id % 3 = 0 THEN g ELSE 0 END)::BIGINT / 1000000.0::DOUBLE) / (sum(CASE WHEN row_id % 3 = 0 THEN h ELSE 0 END)::BIGINT / 1000000.0::DOUBLE + 1.0), 6) AS right FROM grad GROUP BY 1")
def api_6(spark, d):
    rows = frame_of(spark, d)[0].select((F.col("row_id") % 4).alias("nid"), F.when(F.col("row_id") % 3 == 0, 1).otherwise(0).alias("flag"), "g", "h")
    out = trainer.leaf_values_by_flag(rows, 1.0)
    return out.select("nid", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))
