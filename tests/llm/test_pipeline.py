"""The pipeline, and each registered query, against brute force on a small folder of tables."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import classes_brute, dedup_brute, prose

from arborflow.llm import quality, queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    texts, good = [], []
    for i in range(120):
        t = "\n".join(prose(rng, rng.randrange(20, 60)) + "." for _ in range(rng.randrange(1, 5)))
        if i % 6 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if i % 5 == 1:
            t += "\nthis very line is in many documents of the corpus"
        if i % 10 == 3 and i > 10:
            w = texts[i - 10].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        texts.append(t)
        good.append(int(i % 6 != 0))
    texts += [None, "", texts[7]]
    d = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "de" if i % 4 == 0 else "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, good[i], 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), texts


def test_stages_against_brute_force(spark, folder):
    d, texts = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    names = list(stages)
    one = stages[names[0]](spark, docs, d)
    said = {r.doc_id: r.predicted for r in quality.score_quality(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    kept = sorted(r.doc_id for r in one.collect())
    assert kept == sorted(i for i, p in said.items() if p) and one.columns == docs.columns
    two = stages[names[1]](spark, one, d)
    got = {r.doc_id: r for r in two.collect()}
    want = dedup_brute([texts[i] for i in kept])
    assert [got[i].text or "" for i in kept] == [want[k][2] for k in range(len(kept))] and two.columns == docs.columns
    assert all(got[i].n_chars == len(got[i].text) for i in kept if got[i].text is not None)
    three = stages[names[2]](spark, two, d)
    classes = classes_brute([got[i].text for i in kept])
    assert sorted(r.doc_id for r in three.collect()) == sorted({kept[c] for c in classes.values()}) and three.columns == docs.columns
    four = stages[names[3]](spark, three, d)
    assert four.columns == docs.columns and sorted(r.doc_id for r in four.select("doc_id").distinct().collect()) == sorted({kept[c] for c in classes.values()})
    five = stages[names[4]](spark, four, d)
    rows = corpus_pipeline.run(spark, d)
    key = lambda df: sorted((r.doc_id, tuple(r.ids), r.decoded) for r in df.collect())
    assert key(five) == key(rows) and rows.count() == four.count()


def test_pipeline_on_an_empty_table(spark, folder, tmp_path):
    d, _ = folder
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_have_the_contract_columns(spark, folder):
    d, texts = folder
    want = {
        "op1_quality": ["doc_id", "held_out", "score", "predicted"], "op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op3_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        "op4_language": ["doc_id", "held_out", "lang_pred", "score"], "op7_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op10_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, d)
        assert df.columns == columns
        assert df.count() == len(texts) and df.where(F.col("doc_id").isNull()).count() == 0
