"""Files of parties, groups, parties' own cuts, secret noise and binning."""

import random

import pytest
from pyspark.sql import functions as F

from arborflow.operators import cuts as C
from arborflow.operators import partition
from arborflow.params import Params, parse_config
from arborflow.plans import predict as P
from arborflow.plans import trainer
from arborflow.plans.estimator import BoostedClassifier, predict_from_config, train_from_config
from arborflow.sources import model, text


def lines(rng, n, features=4, first=1, label=True):
    out = []
    for _ in range(n):
        x = [round(rng.gauss(0, 1), 3) for _ in range(features)]
        out.append((int(x[0] + x[-1] > 0) if label else None, x))
    return out


def write(path, rows, labelled=True):
    path.write_text("".join((f"{y} " if labelled else "") + " ".join(f"{k + 1}:{v}" for k, v in enumerate(x)) + "\n" for y, x in rows))


def nodes(spark, forest):
    return sorted(tuple(r) for r in model.forest_frame(spark, forest).collect())


def test_vertical_run_over_two_files_equals_one_table(spark, tmp_path):
    rows = lines(random.Random(1), 120)
    write(tmp_path / "p0", [(y, x[:2]) for y, x in rows])
    write(tmp_path / "p1", [(y, x[2:]) for y, x in rows], labelled=False)
    write(tmp_path / "all", rows)
    base = "objective=binary:logistic\ndepth=2\nn_trees=1\nmax_num_bin=8\ngamma=0\nn_parties=2\n"
    two, _ = train_from_config(spark, f"{base}mode=vertical\ndata={tmp_path}/p0,{tmp_path}/p1\nmodel_path={tmp_path}/m\n")
    one, _ = train_from_config(spark, f"{base}mode=centralized\ndata={tmp_path}/all\nmodel_path={tmp_path}/n\n")
    assert nodes(spark, two) == nodes(spark, one) and two.widths == [2, 2]
    write(tmp_path / "q0", [(y, x[:1]) for y, x in rows])  # a test file may lack the last features of a party
    out, score = predict_from_config(spark, f"model_path={tmp_path}/m\ntest_data={tmp_path}/q0,{tmp_path}/p1\n")
    assert out.count() == 120 and 0 <= score <= 1
    joined = P.predict(text.read_vertical(spark, [f"{tmp_path}/q0", f"{tmp_path}/p1"], widths=[2, 2])[0], two)  # the second party's features still count from 2
    key = lambda df: [(r.row_id, [round(m, 9) for m in r.margins]) for r in df.orderBy("row_id").collect()]
    assert key(out) == key(joined) and "features" not in out.columns


def test_horizontal_files_with_groups_are_numbered_through(spark, tmp_path):
    rng = random.Random(2)
    files = [[(rng.randrange(3), x) for _, x in lines(rng, n)] for n in (30, 50)]
    sizes = [[10, 12, 8], [25, 5, 20]]
    for k in (0, 1):
        write(tmp_path / f"f{k}", files[k])
        (tmp_path / f"f{k}.group").write_text(" ".join(map(str, sizes[k])))
    write(tmp_path / "all", files[0] + files[1])
    (tmp_path / "all.group").write_text("\n".join(map(str, sizes[0] + sizes[1])))
    got = text.read_parties(spark, [f"{tmp_path}/f0", f"{tmp_path}/f1"], groups=True)
    want = text.assign_groups(text.read_libsvm(spark, f"{tmp_path}/all"), text.read_groups(spark, f"{tmp_path}/all.group"))
    key = lambda df: [(r.row_id, r.y, r.group_id) for r in df.orderBy("row_id").collect()]
    assert key(got) == key(want) and [r.party_id for r in got.orderBy("row_id").collect()] == [0] * 30 + [1] * 50
    base = "objective=rank:ndcg\nmode=horizontal\ndepth=2\nn_trees=1\nmax_num_bin=8\ngamma=0\nmin_child_weight=0\n"
    two, _ = train_from_config(spark, f"{base}data={tmp_path}/f0,{tmp_path}/f1\nmodel_path={tmp_path}/m\n")
    one, _ = train_from_config(spark, f"{base}data={tmp_path}/all\nmodel_path={tmp_path}/n\n")
    assert nodes(spark, two) == nodes(spark, one)
    assert text.concat_files(spark, [f"{tmp_path}/f0", f"{tmp_path}/f1"]).agg(F.countDistinct("row_id")).first()[0] == 80


def test_groups_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(text, "RUN_BLOCK", 3)
    groups = spark.createDataFrame([(0, 0, 2), (1, 2, 2), (2, 2, 11), (3, 11, 12)], "group_id long, start long, stop long")
    rows = spark.range(15).select(F.col("id").alias("row_id"), F.lit("x").alias("group"))
    got = [r.group_id for r in text.assign_groups(rows, groups).orderBy("row_id").collect()]
    assert got == [0, 0, *[2] * 9, 3, None, None, None]


def table(spark, n=240, seed=3):
    rows = [(i, float(y), [(k, v) for k, v in enumerate(x) if k != 1 or i % 4]) for i, (y, x) in enumerate(lines(random.Random(seed), n))]
    return spark.createDataFrame(rows, f"row_id long, y double, features {text.FEATURES}").cache()


BASE = Params(mode="horizontal", n_parties=2, depth=2, n_trees=2, max_bins=8, learning_rate=0.5, gamma=0.0, objective="binary:logistic")


def test_merging_parties_own_cuts(spark):
    rows = partition.horizontal_by_key(table(spark), 2)
    own = parse_config("merge_histogram=client\nobjective=binary:logistic\n")
    assert own.propose_split == "client_post"
    forest = trainer.train(rows, BASE.replace(propose_split="client_post"))
    assert P.score(rows, forest) > 0.85
    alike = rows.unionByName(rows.withColumns({"party_id": 1 - F.col("party_id"), "row_id": F.col("row_id") + 1000}))
    same, plain = trainer.train(alike, BASE.replace(propose_split="client_post", n_trees=1, depth=1)), trainer.party_range_cuts(alike, 8)
    assert plain.groupBy("fid", "bid").agg(F.countDistinct("cut").alias("n")).where("n > 1").count() == 0
    root = same.trees[0][0].nodes[0]
    assert not root.is_leaf and root.n == 480
    with pytest.raises(ValueError):
        BASE.replace(propose_split="client_post", privacy="sa")


def test_subtraction_gives_the_same_tree(spark, monkeypatch):
    rows = table(spark)
    want = nodes(spark, trainer.train(rows, BASE.replace(mode="centralized", depth=4)))
    monkeypatch.setattr(trainer.Grower, "level_histogram", lambda self, active: self.histogram(active))
    assert nodes(spark, trainer.train(rows, BASE.replace(mode="centralized", depth=4))) == want


def test_noise_is_secret_unless_given(spark):
    p = BASE.replace(mode="vertical", privacy="dp", n_trees=1, privacy_budget=1.0)
    rows = table(spark)
    c = trainer.propose_cuts(trainer.with_party(rows), 4, p)
    frame = trainer.gradients(trainer.binned(trainer.with_party(rows), c).withColumn("margins", F.array(F.lit(0.0))), p, 0).select("party_id", "bins", "g", "h")
    leaves = lambda rng=None: sorted((x.nid, x.weight) for x in trainer.Grower(frame, p, c, 1, rng=rng).grow().leaves())
    assert leaves(random.Random(5)) == leaves(random.Random(5)) and leaves() != leaves()


def test_batches_bin_like_the_definition(spark):
    cuts = [[8.0, 6.25, 4.5], [], [1.0], [2.0, -2.0]]
    values = [None, float("nan"), -5.0, 1.0 - 5e-7, 4.5, 4.4999995, 6.0, 8.0, 9.0, float("inf")]
    rows = spark.createDataFrame([(i, [(f, v) for f in (3, 0, 1, 2, 9)]) for i, v in enumerate(values)] + [(99, []), (100, None)], f"row_id long, features {text.FEATURES}")
    for r in C.bin_rows(rows, cuts, ["row_id"]).collect():
        v = values[r.row_id] if r.row_id < 99 else None
        for f, c in enumerate(cuts):
            above = sum(not (v >= x - 1e-6 or v != v) for x in c) if v is not None else 0
            assert r.bins[f] == (None if v is None or not c else min(above, len(c) - 1))


def test_solo_runs_keep_every_party(spark, tmp_path):
    rows = partition.horizontal_by_key(table(spark), 2)
    forests, log = train_from_config(spark, f"mode=solo\nn_parties=2\nobjective=binary:logistic\ndepth=1\nn_trees=1\ngamma=0\nmodel_path={tmp_path}/m\n", rows)
    assert len(forests) == 2 and sorted(r.party_id for r in log.collect()) == [0, 1]
    m = BoostedClassifier(mode="solo", n_parties=2, depth=1, n_trees=1, gamma=0.0, max_bins=8).fit(rows)
    assert len(m.party_scores(rows)) == 2 and m.party_scores(rows)[0] == m.score(rows)


def test_binary_labels_are_checked_and_idle_keys_warned_of(spark):
    with pytest.raises(ValueError):
        trainer.train(table(spark).withColumn("y", F.col("y") + 0.5), BASE)
    with pytest.warns(UserWarning, match="verbose"):
        assert parse_config("verbose=1\ndepth=3\n").depth == 3
