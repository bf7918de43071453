"""Hand-worked values, text formats and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from arborflow.functions import metrics, objectives, privacy
from arborflow.operators import cuts as C
from arborflow.operators import histogram as H
from arborflow.operators import layout, partition, splits
from arborflow.functions.metrics import evaluate
from arborflow.params import Params, parse_config
from arborflow.plans import predict as P
from arborflow.plans import trainer
from arborflow.plans.estimator import BoostedClassifier, BoostedRegressor, predict_from_config, train_from_config
from arborflow.plans.tree import Tree, by_bin, merge_hybrid, node_id
from arborflow.sources import model, text

F0 = [1, 2, 2, 3, 4, 5, 6, 8]
F1 = [None, 5, 5, None, 1, 1, None, 9]
Y = [1, 1, 2, 2, 6, 7, 7, 8]
DISTINCT = Params(mode="centralized", depth=1, n_trees=1, max_bins=4, learning_rate=0.5, reg_lambda=0.0, gamma=0.0, min_child_weight=1.0)
RANGE = DISTINCT.replace(mode="horizontal", reg_lambda=1.0)


@pytest.fixture(scope="module")
def eight(spark):
    rows = [(i, float(y), [(k, float(v)) for k, v in enumerate((a, b)) if v is not None]) for i, (a, b, y) in enumerate(zip(F0, F1, Y))]
    return spark.createDataFrame(rows, f"row_id long, y double, features {text.FEATURES}").cache()


def test_feature_range(spark):
    values, ptr = [10, 20, 30, 50, 40, 60, 70, 80], [0, 1, 3, 4, 6, 7, 8]
    long = spark.createDataFrame([(f, i, float(values[i])) for f in range(6) for i in range(ptr[f], ptr[f + 1])], "fid int, row_id long, val double")
    got = {r.fid: (r.lo, r.hi) for r in C.feature_range(long).collect()}
    assert got == {0: (10, 10), 1: (20, 30), 2: (50, 50), 3: (40, 60), 4: (70, 70), 5: (80, 80)}


def test_squared_loss(spark):
    df = spark.createDataFrame([(0.0, [float(-k)]) for k in range(4)], "y double, margins array<double>")
    g, h = objectives.OBJECTIVES["reg:linear"].gradient(F.col("y"), F.col("margins"), 0, 0.0)
    assert [tuple(r) for r in df.select(g, h).collect()] == [(0, 1), (-1, 1), (-2, 1), (-3, 1)]


def test_node_histogram_and_merge(spark):
    gh, bins = [(0.1, 0.2), (0.3, 0.4), (0.5, 0.6), (0.7, 0.8)], [[0, 0], [0, 1], [1, 1], [1, 2]]
    rows = spark.createDataFrame([(*map(lambda v: round(v * H.UNIT), x), b) for x, b in zip(gh, bins)], "g long, h long, bins array<int>")
    got = {(r.fid, r.bid): (r.g / H.UNIT, r.h / H.UNIT) for r in H.node_histogram(rows).collect()}
    assert got == {(0, 0): (0.4, 0.6), (0, 1): (1.2, 1.4), (1, 0): (0.1, 0.2), (1, 1): (0.8, 1.0), (1, 2): (0.7, 0.8)}
    two = spark.createDataFrame([(0, 0, 0, 100, 200), (0, 0, 0, 110, 220)], "nid int, fid int, bid int, g long, h long")
    assert [tuple(r) for r in H.merge(two).collect()] == [(0, 0, 0, 210, 420)]


@pytest.mark.parametrize("right", [200_000, 500_000])
def test_left_gain_of_even_children_is_zero(spark, right):
    hist = spark.createDataFrame([(0, 0, 0, right, right)], "nid int, fid int, bid int, g long, h long")
    root = spark.createDataFrame([(0, 1_600_000, 2_000_000)], "nid int, g long, h long")
    assert splits.with_left_gain(hist, root, 0.2, 0.0).first().gain == 0


def test_range_cuts_tree(eight):
    forest = trainer.train(eight, RANGE)
    assert forest.cuts == [[8, 6.25, 4.5, 2.75], [9, 7, 5, 3]]
    bins = [r.bins for r in trainer.binned(trainer.with_party(eight), forest.cuts).orderBy("row_id").collect()]
    assert [b[0] for b in bins] == [3, 3, 3, 3, 3, 2, 2, 0] and [b[1] for b in bins] == [None, 2, 2, None, 3, 3, None, 0]
    root, left, right = (forest.trees[0][0].nodes[i] for i in range(3))
    assert (root.g, root.h, root.fid, root.bid, root.cut, root.default_right) == (-34_000_000, 8_000_000, 0, 2, 4.5, True)
    assert root.gain == pytest.approx(16.555556, abs=1e-6) and (left.weight, right.weight) == (2.0, 5.5)
    got = [r.margins[0] for r in P.margins(eight, forest).orderBy("row_id").collect()]
    assert got == [1.0] * 5 + [2.75] * 3 and P.score(eight, forest) == pytest.approx(3.366888, abs=1e-6)


def test_distinct_cuts_tree(spark, eight):
    forest = trainer.train(eight, DISTINCT)
    assert forest.cuts == [[8, 6, 5, 4], [9, 5, 1]]
    rows = trainer.gradients(trainer.binned(trainer.with_party(eight), forest.cuts).withColumn("margins", F.array(F.lit(0.0))), DISTINCT, 0).withColumn("nid", F.lit(0))
    gains = {(r.fid, r.bid): r.gain for r in splits.with_gain(H.level_histogram(rows), H.node_sums(rows), 0.0, 1.0).collect()}
    want = {(0, 0): -16.071429, (0, 1): -28.166667, (0, 2): -45.633333, (0, 3): 0, (1, 0): 16.071429, (1, 1): -13.5, (1, 2): 4.033333}
    assert gains == pytest.approx(want, abs=1e-6)
    root, left, right = (forest.trees[0][0].nodes[i] for i in range(3))
    assert (root.fid, root.bid, left.weight) == (0, 2, 2.4) and right.weight == pytest.approx(7.333333, abs=1e-6)
    assert P.score(eight, forest) == pytest.approx(2.859196, abs=1e-6)


def test_training_and_scoring_part_below_the_least_cut(eight):
    """A value under every cut is in the last bin, so training sends it right where scoring compares values and sends it left."""
    cuts = [[8, 6.25, 4.5, 2.75], [9, 7, 5, 3]]
    tree = Tree(-34_000_000, 8_000_000, 1.0)
    tree.split(0, 0, 3, 2.75, 1.0, True, -34_000_000, 8_000_000)
    routed = trainer.binned(trainer.with_party(eight), cuts).select("row_id", node_id(tree, by_bin()).alias("n"))
    assert {r.n for r in routed.collect()} == {2}
    forest = trainer.Forest(RANGE, [[tree]], 2, cuts)
    assert [r.leaves[0][0] for r in P.predict_leaves(eight, forest).orderBy("row_id").collect()] == [1, 1, 1, 2, 2, 2, 2, 2]


def test_small_ranges_halve_bins(spark):
    ranges = spark.createDataFrame([(0, 0.0, 1e-5), (1, 3.0, 3.0), (2, 0.0, 1e-9), (3, float("-inf"), 1.0), (4, 0.0, 32.0)], "fid int, lo double, hi double")
    n = {r.fid: r["count"] for r in C.range_cuts(ranges, 32).groupBy("fid").count().collect()}
    assert n == {0: 8, 1: 1, 2: 1, 4: 32}


def test_metrics(spark):
    one = spark.createDataFrame([(0.9, 1.0), (0.8, 0.0), (0.4, 1.0), (0.1, 0.0)], "margin double, y double")
    assert metrics.auc(one).first().auc == 0.75
    assert metrics.auc(spark.createDataFrame([(0.5, 1.0), (0.5, 0.0)], "margin double, y double")).first().auc == 0.5
    assert metrics.auc(one.where("y = 1")).first().auc == -1
    rows = [(i, 0, float(y), s) for i, (y, s) in enumerate(zip([3, 0, 2, 1], [0.1, 0.9, 0.8, 0.4]))]
    g = spark.createDataFrame(rows, "row_id long, group_id long, y double, margin double")
    assert metrics.mean_average_precision(g).first().map == pytest.approx(0.638889, abs=1e-6)
    assert metrics.ndcg(g).first().ndcg == pytest.approx(0.575711, abs=1e-6)
    zero = g.withColumn("y", F.lit(0.0))
    assert metrics.mean_average_precision(zero).first().map == 1 and metrics.ndcg(zero).first().ndcg == 1


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 1:0.5 3:2 # c\n\n1:0.5 3:2\n2 qid:3 1:4\n1 3:2 1:5\n")
    rows = text.read_libsvm(spark, str(tmp_path / "a.txt")).orderBy("row_id").collect()
    pairs = [[(c.fid, c.val) for c in r.features] for r in rows]
    assert [r.y for r in rows] == [1, None, 2, 1] and [r.row_id for r in rows] == [0, 1, 2, 3]
    assert pairs == [[(0, 0.5), (2, 2)], [(0, 0.5), (2, 2)], [(0, 4)], [(0, 5), (2, 2)]]
    (tmp_path / "b.csv").write_text("id,y,a,b\n7,1,0,2.5\n8,0,,4\n")
    rows = text.read_csv(spark, str(tmp_path / "b.csv")).orderBy("row_id").collect()
    assert [(r.row_id, r.y, [(c.fid, c.val) for c in r.features]) for r in rows] == [(7, 1, [(0, 0), (1, 2.5)]), (8, 0, [(1, 4)])]
    (tmp_path / "c.csv").write_text("Class,a\n3,1\n")
    assert text.read_csv(spark, str(tmp_path / "c.csv")).first().y == 3
    (tmp_path / "d.csv").write_text("x,a\n3,1\n")
    with pytest.raises(ValueError):
        text.read_csv(spark, str(tmp_path / "d.csv"))
    (tmp_path / "a.txt.group").write_text("1 2\n1\n")
    got = text.assign_groups(text.read_libsvm(spark, str(tmp_path / "a.txt")), text.read_groups(spark, str(tmp_path / "a.txt.group"))).orderBy("row_id").collect()
    assert [r.group_id for r in got] == [0, 1, 1, 2]
    both = text.read_parties(spark, [str(tmp_path / "a.txt")] * 2)
    assert both.groupBy("party_id").count().count() == 2
    csr = text.from_sparse(spark, [1, 2, 3], [0, 2, 2, 3], [0, 4, 1], [1, 0, 1])
    assert layout.width(csr) == 5 and layout.to_rows(layout.to_columns(csr)).count() == 2
    assert text.read_csc(spark, str(tmp_path / "a.txt")).count() == 7


def test_config():
    p = parse_config("max_depth=3 # levels\nnum_clients=4\neta=0.1\nlambda=2\nmin_child_weight=0.5\nseed=9\nbins=64\nbagging=1\n", n_trees=7)
    assert (p.depth, p.n_parties, p.learning_rate, p.reg_lambda, p.min_child_weight, p.seed, p.max_bins, p.bagging, p.n_trees) == (3, 4, 0.1, 2, 0.5, 9, 64, True, 7)
    with pytest.raises(ValueError):
        parse_config("nonsense=1")
    with pytest.raises(ValueError):
        Params(max_bins=256)


def table(spark, n=400, seed=3, classes=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.choice([None, rng.gauss(0, 1)]) if k == 3 else rng.gauss(0, 1) for k in range(4)]
        s = x[0] + 0.5 * x[1] + (0.7 if x[3] is None else 0)
        rows.append((i, float(min(classes - 1, max(0, int(s + 1)))) if classes > 2 else float(s > 0), [(k, v) for k, v in enumerate(x) if v is not None]))
    return spark.createDataFrame(rows, f"row_id long, y double, features {text.FEATURES}").cache()


SMALL = Params(mode="horizontal", n_parties=2, depth=2, n_trees=2, max_bins=8, learning_rate=0.5, gamma=0.0, objective="binary:logistic")


def nodes(spark, forest):
    drop = ("cut", "gain", "weight")
    return sorted(tuple(r) for r in model.forest_frame(spark, forest).drop(*drop).collect()), sorted((r["round"], r.nid, round(r.weight, 9)) for r in model.forest_frame(spark, forest).collect())


def test_federations_agree(spark):
    rows = table(spark)
    dealt = partition.horizontal_by_key(rows, 2)
    plain = trainer.train(dealt, SMALL)
    secure = trainer.train(dealt, SMALL.replace(privacy="sa"))
    assert nodes(spark, plain) == nodes(spark, secure)
    one = trainer.train(rows, SMALL.replace(mode="centralized"))
    assert nodes(spark, one) == nodes(spark, trainer.train(rows, SMALL.replace(mode="vertical")))
    small = rows.where("row_id < 40")
    encrypted = SMALL.replace(depth=1, n_trees=1, key_length=128)
    assert nodes(spark, trainer.train(small, encrypted.replace(mode="vertical"))) == nodes(spark, trainer.train(small, encrypted.replace(mode="vertical", privacy="he")))
    both = partition.horizontal_by_key(small, 2)
    assert nodes(spark, trainer.train(both, encrypted)) == nodes(spark, trainer.train(both, encrypted.replace(privacy="he")))


def test_modes_and_model_files(spark, tmp_path):
    rows = partition.horizontal_by_key(table(spark), 2)
    ensemble = trainer.train(rows, SMALL.replace(mode="ensemble"))
    solo = trainer.train(rows, SMALL.replace(mode="solo", n_trees=1))
    assert len(ensemble.trees) == 2 and [nodes(spark, f)[1] for f in solo] == [[(0, *x[1:]) for x in nodes(spark, ensemble)[1] if x[0] == k] for k in range(2)]
    hybrid = trainer.train(rows, SMALL.replace(mode="hybrid", n_trees=1))
    assert len(hybrid) == 2 and evaluate(P.margins_by_party(rows, hybrid), "error") > 0.7
    private = trainer.train(rows, SMALL.replace(mode="vertical", privacy="dp", privacy_budget=1000.0, learning_rate=0.1))
    assert P.score(rows, private, "error") > 0.6
    model.save_model(spark, ensemble, str(tmp_path / "m"))
    back = model.load_model(spark, str(tmp_path / "m"))
    assert nodes(spark, back) == nodes(spark, ensemble) and back.params == ensemble.params
    got = P.predict(rows, back)
    model.write_predictions(got, str(tmp_path / "p"), "label")
    assert spark.read.text(str(tmp_path / "p")).count() == 400
    assert ensemble.trees[0][0].dump().startswith("0:[f")


def test_large_forests_score_alike(spark, monkeypatch):
    rows = table(spark, 200)
    forest = trainer.train(rows, SMALL)
    want = [r.margins[0] for r in P.margins(rows, forest).orderBy("row_id").collect()]
    monkeypatch.setattr(P, "CASE_LEAVES", 0)
    assert [r.margins[0] for r in P.margins(rows, forest).orderBy("row_id").collect()] == pytest.approx(want)


def test_vertical_scoring(spark):
    rows = table(spark, 200)
    forest = trainer.train(rows, SMALL)
    part = lambda a, b: rows.select("row_id", F.transform(F.filter("features", lambda c: c["fid"].between(a, b)), lambda c: F.struct((c["fid"] - a).alias("fid"), c["val"].alias("val"))).alias("features"))
    got = P.predict_vertical([part(0, 1), part(2, 3)], forest, [2, 2]).orderBy("row_id").collect()
    assert [r.margins for r in got] == [r.margins for r in P.predict(rows, forest).orderBy("row_id").collect()]


def test_multiclass_and_estimators(spark, tmp_path):
    rows = table(spark, 300, classes=3)
    m = BoostedClassifier(mode="centralized", objective="multi:softprob", num_class=3, depth=2, n_trees=2, max_bins=8, gamma=0.0).fit(rows)
    assert m.score(rows) > 0.7
    p = m.predict_proba(rows).first().probabilities
    assert len(p) == 3 and sum(p) == pytest.approx(1)
    m.save_model(spark, str(tmp_path / "m"))
    again = BoostedClassifier().load_model(spark, str(tmp_path / "m"))
    assert [r.label for r in again.predict(rows).orderBy("row_id").collect()] == [r.label for r in m.predict(rows).orderBy("row_id").collect()]
    cv = BoostedRegressor(mode="centralized", depth=1, n_trees=1, max_bins=4, gamma=0.0).cv(rows, nfold=2)
    assert 0 < cv["rmse"] < 2
    with pytest.raises(ValueError):
        trainer.train(rows.withColumn("y", F.col("y") - 1), m.params)


def test_configured_run(spark, tmp_path):
    (tmp_path / "d.txt").write_text("".join(f"{i % 2} 1:{i % 2 + 0.1 * (i % 5)} 2:{i % 7}\n" for i in range(60)))
    config = f"mode=horizontal\npartition=1\nn_parties=2\nobjective=binary:logistic\ndepth=2\nn_trees=2\ngamma=0\ndata={tmp_path}/d.txt\nmodel_path={tmp_path}/m\npred_output={tmp_path}/out\n"
    forest, log = train_from_config(spark, config)
    assert log.count() == 2 and len(forest.trees) == 2
    out, score = predict_from_config(spark, config)
    assert score == 1.0 and out.count() == 60


def test_rank_gradients(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, i % 7, float(rng.randrange(3)), rng.gauss(0, 1)) for i in range(100)] + [(100, 9, 1.0, 0.0), (101, 9, 1.0, 1.0)], "row_id long, group_id long, y double, margin double")
    for ndcg in (False, True):
        got = rows.join(objectives.rank_gradients(rows, ndcg), "row_id")
        assert all(abs(r.s) < 1e-9 for r in got.groupBy("group_id").agg(F.sum("g").alias("s")).collect())
        assert got.where("g <> 0").count() > 80 and got.where("row_id >= 100 and g <> 0").count() == 0
    groups = rows.select("row_id", "group_id", "y", F.array(F.struct(F.lit(0).alias("fid"), F.col("y").alias("val"))).alias("features"))
    forest = trainer.train(groups, Params(mode="centralized", objective="rank:ndcg", depth=1, n_trees=1, gamma=0.0, min_child_weight=0.0))
    assert P.score(groups, forest) > 0.95


def test_paillier_and_masks():
    rng = random.Random(6)
    key = privacy.paillier_keys(128, rng)
    pub = key.public
    a, b = pub.encrypt(-1234567, rng), pub.encrypt(500, rng)
    assert key.decrypt(pub.add(a, b)) == -1234067 and key.decrypt(pub.scale(b, -3)) == -1500 and key.decrypt(pub.subtract(a, b)) == -1235067
    keys = privacy.KeyAgreement(3, rng)
    assert keys.shared(0, 2) == keys.shared(2, 0)
    assert sorted(keys.seeds(0, "x"))[0][0] == 1 and {s for s, _ in keys.seeds(2, "x")} == {-1}


def test_prune_and_hybrid_order():
    t = Tree(-34_000_000, 8_000_000, 1.0, 8)
    t.split(0, 0, 2, 4.5, 16.5, True, -22_000_000, 3_000_000)
    t.split(2, 1, 0, 9.0, 0.5, False, -8_000_000, 1_000_000)
    assert merge_hybrid([t, t], [8, 4], 2) == [(0, 0), (1, 0), (2, 1)]
    assert t.prune(1.0) == 1 and t.nodes[2].is_leaf and t.compact_ids() == {0: 0, 1: 1, 2: 2}
    assert t.prune(100.0) == 1 and t.nodes[0].is_leaf


def test_partitions_are_complete(spark):
    rows = table(spark, 500)
    assert sum(r["count"] for r in partition.horizontal(rows, 3).groupBy("party_id").count().collect()) == 500
    split = layout.train_test_split(rows, 0.75)
    assert split.where("is_train").count() == 375
    assert partition.vertical_owner(7, 3) == [0, 0, 1, 1, 2, 2, 2]
    assert sum(partition.dirichlet(0.3, 5, 1)) == pytest.approx(1)


def test_bagging_slices_are_disjoint(spark):
    p = SMALL.replace(bagging=True, bagging_fraction=0.25)
    ids = [{r.row_id for r in spark.range(100).toDF("row_id").where(trainer._bag("row_id", p, t)).collect()} for t in range(4)]
    assert sum(map(len, ids)) == 100 and len(set().union(*ids)) == 100


def test_streaming_scores(spark, tmp_path):
    from arborflow.streaming import score_stream

    rows = table(spark, 50)
    forest = trainer.train(rows, SMALL.replace(n_trees=1))
    rows.select("row_id", "features").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, features " + text.FEATURES).parquet(str(tmp_path / "in"))
    q = score_stream(stream, forest).select("row_id", "label").writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("scored").count() == 50
