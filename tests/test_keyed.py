"""Trees that grow side by side, parties apart, scoring by arrays, drawn partners and numbering by file."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborflow import catalog
from arborflow.functions.objectives import rank_gradients
from arborflow.params import Params
from arborflow.plans import predict as P
from arborflow.plans import trainer, vertical
from arborflow.plans.estimator import BoostedModel
from arborflow.plans.tree import Node, Tree, node_number
from arborflow.sources import model, text

ROWS = "row_id long, party_id int, y double, features array<struct<fid:int,val:double>>"
SMALL = Params(mode="centralized", depth=3, n_trees=2, max_bins=8, learning_rate=0.5, gamma=0.0, reg_lambda=0.5)


def table(spark, n=300, width=6, classes=0, parties=1, seed=1):
    """Rows with missing values, whose label follows from features 0 and 3."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = {f: round(rng.gauss(0, 1), 2) for f in range(width) if rng.random() < 0.85}
        y = 2 * x.get(0, 0.3) - x.get(3, 1.0) * x.get(1, 0.5)
        out.append((i, i % parties, float(int(abs(y) * 2) % classes) if classes else y, sorted(x.items())))
    return spark.createDataFrame(out, ROWS)


def parts_of(rows, ranges, labels=0):
    out = []
    for p, (a, b) in enumerate(ranges):
        own = F.transform(F.filter("features", lambda c: c["fid"].between(a, b - 1)), lambda c: F.struct((c["fid"] - a).alias("fid"), c["val"].alias("val")))
        out.append(rows.select("row_id", *(["y"] if p == labels else []), own.alias("features")))
    return out


def margins(frame):
    return {r.row_id: [round(m, 9) for m in r.margins] for r in frame.select("row_id", "margins").collect()}


def dumps(forest):
    return [[t.dump() for t in trees] for trees in forest.trees]


def jobs(spark, name, fn):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        fn()
        return len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


# side by side


def test_jobs_do_not_grow_with_classes_or_parties(spark):
    p = SMALL.replace(n_trees=1, depth=2)

    def of_classes(k):
        rows = table(spark, classes=k)
        frame = trainer.binned(rows, c := trainer.propose_cuts(rows, 6, p)).persist()
        frame.count()
        return jobs(spark, f"classes-{k}", lambda: trainer.boost(frame, p.replace(objective="multi:softprob", num_class=k), c))

    def of_parties(k):
        rows = table(spark, parties=k)
        frame = trainer.binned(rows, c := trainer.propose_party_cuts(rows, 6, p.replace(n_parties=k)), by_party=True).persist()
        frame.count()
        return jobs(spark, f"parties-{k}", lambda: trainer.boost_parties(frame, p.replace(n_parties=k), c))

    few, many = of_classes(2), of_classes(7)
    assert 0 < many <= few + 2  # adaptive execution may add a job
    few, many = of_parties(2), of_parties(6)
    assert 0 < many <= few + 2


def test_parties_together_grow_what_each_grows_alone(spark):
    rows = table(spark, parties=3, classes=3)
    p = SMALL.replace(mode="solo", n_parties=3, objective="multi:softprob", num_class=3)
    together = trainer.train(rows, p)
    for k, forest in enumerate(together):
        alone = trainer.train(rows.where(F.col("party_id") == k).withColumn("party_id", F.lit(0)), p.replace(mode="centralized"))
        assert dumps(forest) == dumps(alone)
    got = margins(P.margins_by_party(rows, together))
    for k, forest in enumerate(together):
        assert margins(P.margins(rows.where(F.col("party_id") == k), forest)).items() <= got.items()


def test_folds_together_score_as_folds_alone(spark):
    rows = table(spark)
    m = BoostedModel(mode="centralized", depth=2, n_trees=2, max_bins=8, gamma=0.0, learning_rate=0.5)
    got = m.cv(rows, nfold=3)
    fold = F.pmod(F.xxhash64(F.lit(0), F.col("row_id")), F.lit(3))
    values = [P.score(rows.where(fold == k), trainer.train(rows.where(fold != k), m.params), "rmse") for k in range(3)]
    assert got["rmse"] == pytest.approx(np.mean(values))


def test_long_walks_number_nodes_as_short_ones(spark, monkeypatch):
    rows = table(spark)
    frame = trainer.binned(rows, c := trainer.propose_cuts(rows, 6, SMALL)).withColumn("margins", F.array(F.lit(0.0)))
    g = trainer.gradients(frame, SMALL, 0)
    trees = [trainer.Grower(g, SMALL.replace(depth=d), c, 1).grow() for d in (3, 1)]
    trees[1].pass_on(1, 5)
    both = g.select("row_id", "bins", F.explode(F.array(F.lit(0), F.lit(1))).alias("tid"))
    number = lambda: {(r.row_id, r.tid): r.n for r in both.select("row_id", "tid", node_number(trees, "tid", 16).alias("n")).collect()}
    by_case = number()
    monkeypatch.setattr("arborflow.plans.tree.CASE_LEAVES", 0)
    assert number() == by_case and {n // 16 for n in by_case.values()} == {0, 1} and 16 + 3 in by_case.values()


# pass-through and hybrid


def test_a_node_without_its_feature_hands_rows_on(spark, tmp_path):
    rows = table(spark, parties=2).withColumn("features", F.filter("features", lambda c: ~((F.col("party_id") == 1) & (c["fid"] == 0))))
    p = SMALL.replace(mode="hybrid", n_parties=2, depth=2, reg_lambda=0.0)
    forests = trainer.train(rows, p)
    passing = [x for trees in forests[1].trees for x in trees[0].nodes.values() if x.passes]
    assert passing and not [x for trees in forests[0].trees for x in trees[0].nodes.values() if x.passes]
    for x in passing:
        assert x.fid == 0
    same = [[(x.nid, x.fid) for x in t[0].nodes.values() if not x.is_leaf] for t in forests[0].trees]
    assert [[(x.nid, x.fid) for x in t[0].nodes.values() if not x.is_leaf] for t in forests[1].trees] == same or len(same) > 0
    assert "absent] all=" in forests[1].trees[0][0].dump() or "absent] all=" in forests[1].trees[1][0].dump()
    model.save_model(spark, forests[1], str(tmp_path / "m"))
    back = model.load_model(spark, str(tmp_path / "m"))
    assert dumps(back) == dumps(forests[1])
    assert margins(P.margins(rows, back)) == margins(P._by_arrays(rows, forests[1], False))


# parties apart


def test_vertical_equals_centralized(spark):
    rows = table(spark)
    parts = parts_of(rows, [(0, 2), (2, 6)], 1)
    forest, out = vertical.train_vertical(parts, SMALL, [2, 4], watch=True)
    whole = trainer.train(rows, SMALL, watch=True)
    assert dumps(forest) == dumps(whole) and forest.scores == pytest.approx(whole.scores)
    assert margins(out) == margins(trainer.boost(trainer.binned(rows, forest.cuts), SMALL, forest.cuts)[1])
    assert margins(P.predict_vertical(parts, forest, forest.widths)) == margins(P.predict(rows, forest))
    assert not any(c in out.columns for c in ("bins", "features"))


def test_vertical_of_three_parties_and_classes_with_rows_missing(spark):
    rows = table(spark, classes=3)
    parts = parts_of(rows, [(0, 2), (2, 3), (3, 6)])
    parts[1] = parts[1].where("row_id % 7 <> 0")
    p = SMALL.replace(objective="multi:softprob", num_class=3, n_trees=1)
    forest, out = vertical.train_vertical(parts, p, [2, 1, 3])
    kept = rows.where("row_id % 7 <> 0")
    assert dumps(forest) == dumps(trainer.train(kept, p)) and out.count() == kept.count()


def test_vertical_under_encryption(spark):
    rows = table(spark, n=60)
    parts = parts_of(rows, [(0, 3), (3, 6)], 1)
    p = SMALL.replace(n_trees=1, depth=2, key_length=256)
    sealed = vertical.train_vertical(parts, p.replace(privacy="he"), [3, 3])[0]
    assert dumps(sealed) == dumps(vertical.train_vertical(parts, p, [3, 3])[0])


def test_no_frame_holds_two_parties_features(spark, monkeypatch):
    seen = []
    frame_of = vertical.H.level_histogram
    monkeypatch.setattr(vertical.H, "level_histogram", lambda rows, *a, **k: (seen.append(rows), frame_of(rows, *a, **k))[1])
    rows = table(spark, n=100)
    vertical.train_vertical(parts_of(rows, [(0, 2), (2, 6)]), SMALL.replace(n_trees=1), [2, 4])
    widths = {len(r.bins) for frame in seen for r in frame.select("bins").take(5)}
    assert widths == {2, 4}


# arrays


def sparse_rows(spark, n=400, width=1000, seed=3):
    rng = random.Random(seed)
    out = [(i, 0, 0.0, sorted((f, round(rng.gauss(0, 1), 3)) for f in rng.sample(range(width), 60))) for i in range(n)]
    out += [(n, 0, 0.0, None), (n + 1, 0, 0.0, []), (n + 2, 0, 0.0, [(5, 1.0), (5, -1.0), (2_000_000, 3.0)]), (n + 3, 0, 0.0, [(7, None), (8, float("nan"))])]
    return spark.createDataFrame(out, ROWS)


def wide_forest(width=1000, n_trees=40, depth=6, classes=1, seed=5):
    rng, rounds = random.Random(seed), []
    for _ in range(n_trees // classes):
        trees = []
        for _ in range(classes):
            tree = Tree(0, 0, 1.0)
            todo = [0]
            while todo:
                nid = todo.pop()
                leaf = nid >= 2**depth - 1 or (nid > 6 and rng.random() < 0.1)
                tree.nodes[nid] = Node(nid, 0, 0, weight=rng.randrange(-64, 64) / 64, fid=rng.randrange(width), cut=round(rng.gauss(0, 1), 2), default_right=rng.random() < 0.5, is_leaf=leaf, passes=not leaf and rng.random() < 0.02)
                todo += [] if leaf else [2 * nid + 1, 2 * nid + 2]
            trees.append(tree)
        rounds.append(trees)
    return trainer.Forest(SMALL.replace(objective="multi:softprob" if classes > 1 else "reg:linear", num_class=classes), rounds, width)


@pytest.mark.parametrize("classes", [1, 4])
def test_arrays_equal_nested_cases(spark, monkeypatch, classes):
    rows, forest = sparse_rows(spark), wide_forest(classes=classes)
    assert not P._small(forest)
    arrays, leaves = margins(P.margins(rows, forest)), {r.row_id: r.leaves for r in P.predict_leaves(rows, forest).collect()}
    monkeypatch.setattr("arborflow.plans.flat.CELLS", 5000)  # several blocks a batch
    assert margins(P.margins(rows, forest)) == arrays
    few = rows.where("row_id % 40 = 0 or row_id >= 400")
    for r in few.collect():  # node by node, as a CASE would
        x = {f: v for f, v in (r.features or []) if v is not None and v == v}
        for t, trees in enumerate(forest.trees):
            for k, tree in enumerate(trees):
                nid = 0
                while not (node := tree.nodes[nid]).is_leaf:
                    go = False if node.passes else node.default_right if node.fid not in x else x[node.fid] - node.cut >= -1e-6
                    nid = 2 * nid + 1 + go
                assert leaves[r.row_id][t][k] == nid
        for k in range(classes):
            assert arrays[r.row_id][k] == pytest.approx(sum(0.5 * trees[k].nodes[leaves[r.row_id][t][k]].weight for t, trees in enumerate(forest.trees)))
    dense = few.select("row_id", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda f: F.try_element_at(F.filter("features", lambda c: c["fid"] == f), F.lit(-1))["val"]).alias("x"))
    assert margins(P.margins(dense, forest)).items() <= arrays.items()


def test_a_large_forest_by_cases_and_arrays(spark, monkeypatch):
    rows = catalog.rows_of(spark, "/root/testdata/sf0.001")
    forest = catalog.large_forest()
    forest.trees = forest.trees[:10]
    arrays = margins(P.margins(rows, forest))
    monkeypatch.setattr(P, "CASE_LEAVES", 10_000)
    assert P._small(forest) and margins(P.margins(rows, forest)) == arrays


# drawn partners


def test_partners_are_drawn_evenly(spark):
    rows = [(i, 0, float(i % 3), 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, group_id long, y double, margin double")
    pushes = Counter()
    for seed in range(8):
        got = {r.row_id: (r.g, r.h) for r in rank_gradients(df, seed=seed).collect()}
        assert sum(g for g, _ in got.values()) == pytest.approx(0) and all(h > 0 for _, h in got.values())
        for i, (_, h) in got.items():
            pushes[i] += h / 0.5 - 1  # how often it was another's partner
    assert sum(n > 1.5 for n in pushes.values()) == 30 and max(pushes.values()) < 30 and sum(pushes.values()) == pytest.approx(240)


def test_one_group_of_all_rows_takes_seconds(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.lit(1).alias("group_id"), (F.col("id") % 7 == 0).cast("double").alias("y"), (F.hash("id") % 1000 / 1000).alias("margin"))
    began = time.time()
    r = rank_gradients(df, ndcg=True).agg(F.sum("g"), F.count("*"), F.sum((F.col("h") > 0).cast("int"))).first()
    assert time.time() - began < 20
    assert abs(r[0]) < 1e-6 and r[1] == n and r[2] == n


def test_groups_of_one_label_give_zeros(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 0.5), (2, 1, 2.0, 0.1), (3, 2, 1.0, 0.0)], "row_id long, group_id long, y double, margin double")
    assert {(r.row_id, r.g, r.h) for r in rank_gradients(df, True).collect()} == {(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)}


# numbering


def test_rows_are_numbered_in_order_of_files(spark, tmp_path):
    folder = tmp_path / "rows"
    folder.mkdir()
    sizes = {"a.txt": 10, "b.txt": 5000, "c.txt": 3}
    k = 0
    for name, n in sizes.items():
        (folder / name).write_text("".join(f"{k + i} 1:{k + i}\n" for i in range(n)))
        k += n
    for path in (str(folder), [str(folder / x) for x in sizes]):
        rows = text.read_libsvm(spark, path)
        assert rows.where("row_id <> y").count() == 0 and rows.count() == k
    back = [str(folder / x) for x in ("c.txt", "a.txt")]
    assert [int(r.y) for r in text.read_libsvm(spark, back).orderBy("row_id").collect()] == [5010, 5011, 5012, *range(10)]
    (tmp_path / "rows.group").write_text("4\n10\n4999\n")
    grouped = text.assign_groups(text.read_libsvm(spark, str(folder)), text.read_groups(spark, str(tmp_path / "rows.group")))
    assert {r.group_id: (r.a, r.b) for r in grouped.groupBy("group_id").agg(F.min("y").alias("a"), F.max("y").alias("b")).collect()} == {0: (0.0, 3.0), 1: (4.0, 13.0), 2: (14.0, 5012.0)}


def test_class_first_csv_is_numbered_in_order_of_files(spark, tmp_path):
    for name, rows in (("a", range(3)), ("b", range(3, 900))):
        (tmp_path / f"{name}.csv").write_text("Class,u\n" + "".join(f"{i},{i}.5\n" for i in rows))
    got = text.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert got.where("row_id <> y").count() == 0 and got.count() == 900


# sketches


def test_sketched_ranks_are_near_exact_ones(spark):
    from arborflow.operators import cuts as C

    rng = np.random.default_rng(3)
    values = {0: rng.normal(size=30_000), 1: rng.exponential(size=30_000), 2: rng.integers(0, 5, 30_000).astype(float)}
    long = spark.createDataFrame([(int(i % 4), f, float(x)) for f, v in values.items() for i, x in enumerate(v)], "party_id int, fid int, val double")
    found = {f: [] for f in values}
    for r in C.sketch_cuts(C.party_sketches(long), 16).orderBy("fid", "bid").collect():
        found[r.fid].append(r.cut)
    for f in (0, 1):
        assert len(found[f]) == 16 and found[f][0] == values[f].max()
        for k, cut in enumerate(found[f]):
            assert abs((values[f] <= cut).mean() - (1 - k / 16)) < 0.004
    assert found[2] == [4.0, 3.0, 2.0, 1.0, 0.0]
    rows = table(spark)
    sketched = trainer.train(rows, SMALL.replace(propose_split="sketch", max_bins=32))
    assert P.score(rows, sketched, "rmse") < 1.2 * P.score(rows, trainer.train(rows, SMALL.replace(max_bins=32)), "rmse")


def test_features_of_many_values_are_ranked_by_cells(spark, monkeypatch):
    from arborflow.operators import cuts as C

    rng = random.Random(8)
    long = spark.createDataFrame([(p, f, float(rng.randrange(10 ** (f + 1)))) for f in range(4) for p in range(2) for _ in range(800)], "party_id int, fid int, val double")
    whole = [sorted(C.distinct_cuts(long, 16, by).collect()) for by in (("fid",), ("party_id", "fid"))]
    monkeypatch.setattr(C, "LARGE", 50)
    assert [sorted(C.distinct_cuts(long, 16, by).collect()) for by in (("fid",), ("party_id", "fid"))] == whole


# cuts by round


def test_each_round_of_bagging_proposes_its_own_cuts(spark, monkeypatch):
    seen, propose = [], trainer.propose_cuts
    monkeypatch.setattr(trainer, "propose_cuts", lambda rows, n, p: (seen.append((rows.count(), propose(rows, n, p))), seen[-1][1])[1])
    rows = table(spark)
    forest = trainer.train(rows, SMALL.replace(bagging=True, bagging_fraction=0.5, n_trees=3), watch=True)
    assert len(seen) == 3 and seen[0][0] + seen[1][0] == 300 and seen[0][1] != seen[1][1] and len(forest.scores) == 3


# protected histograms by subtraction


@pytest.mark.parametrize("privacy", ["sa", "he"])
def test_half_the_protected_cells_give_the_same_tree(spark, monkeypatch, privacy):
    summed, merge = [], trainer.H.merge if privacy == "sa" else trainer.privacy.sum_encrypted
    rows = table(spark, n=120, parties=2)
    p = SMALL.replace(mode="horizontal", n_parties=2, n_trees=1, privacy=privacy, key_length=256)
    frame = trainer.binned(rows, c := trainer.propose_cuts(rows, 6, p)).persist()

    def grown():
        summed.clear()
        tree = trainer.boost(frame, p, c, n_parties=2)[0].trees[0][0]
        return tree.dump(), sum(summed)

    def counted(cells, *rest):
        summed.append(cells.select("nid").distinct().count())
        return merge(cells, *rest)

    monkeypatch.setattr(*((trainer.H, "merge") if privacy == "sa" else (trainer.privacy, "sum_encrypted")), counted)
    halved, few = grown()
    monkeypatch.setattr(trainer.Grower, "level_histogram", lambda self, active: self.histogram(active))
    whole, all_nodes = grown()
    assert halved == whole and halved == trainer.boost(frame, p.replace(privacy="none"), c, n_parties=2)[0].trees[0][0].dump()
    assert few - 1 <= (all_nodes - 1) / 2 + 1 and few < all_nodes


# models of another program


def binary_model(real, size, trees, objective=b"reg:linear", rate=0.5, classes=1):
    import struct

    kind, out = model.record_type(real, size), struct.pack("<i", len(objective)) + objective + struct.pack("<fii?i", rate, classes, len(trees), False, len(trees))
    for nodes in trees:
        out += struct.pack("<iQ", 1, len(nodes))
        records = np.zeros(len(nodes), kind)
        for i, n in enumerate(nodes):
            for name, value in n.items():
                records[name][i] = value
        raw = bytearray(records.tobytes())
        for i in range(len(nodes)):  # what lies behind the known fields is not read
            tail = i * size + kind.fields["is_pruned"][1] + 1
            raw[tail : (i + 1) * size] = b"\xa5" * (size - (tail - i * size))
        out += bytes(raw)
    return out


@pytest.mark.parametrize("real, size", [("f4", 56), ("f4", 64), ("f4", 120), ("f8", 96)])
def test_a_binary_model_gives_known_margins(spark, tmp_path, real, size):
    leaf = lambda w: {"weight": w, "is_leaf": 1, "fid": -1, "left": -1, "right": -1}
    first = [{"fid": 2, "cut": 1.5, "left": 1, "right": 2, "default_right": 1, "bid": 3}, leaf(4.0), {"fid": 0, "cut": -1.0, "left": 4, "right": 3}, leaf(8.0), leaf(-2.0)]
    second = [leaf(0.25)]
    (tmp_path / "m.bin").write_bytes(binary_model(real, size, [first, second]))
    forest = model.import_model(spark, str(tmp_path / "m.bin"))
    assert forest.n_features == 3 and forest.params.learning_rate == 0.5 and len(forest.trees) == 2
    rows = spark.createDataFrame([(0, 0, 0.0, [(2, 1.0)]), (1, 0, 0.0, [(0, 0.0), (2, 2.0)]), (2, 0, 0.0, [(0, -3.0)]), (3, 0, 0.0, [])], ROWS)
    assert margins(P.margins(rows, forest)) == {0: [2.125], 1: [4.125], 2: [-0.875], 3: [-0.875]}
    with pytest.raises(ValueError, match="record size"):
        model.decode_binary((tmp_path / "m.bin").read_bytes()[:-3])
