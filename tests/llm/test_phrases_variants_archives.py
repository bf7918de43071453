"""Phrases, spelling variants and archives against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import gzip
import hashlib
import io
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from arborflow.llm import phrases, variants, warc

DOCS = "doc_id long, text string, lang string"
PAGES = "page_id long, url string, html string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# phrases


def brute_phrases(docs, top=2000, least=10):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {tuple(p.split(" ")): a for p, a in count.items() if " " in p and a >= least}
        rows = []
        for w, a in found.items():
            if any(2 * b >= a for x, b in found.items() if len(x) > len(w) and w in (x[:2], x[1:])):
                continue
            of = lambda x: count[" ".join(x)]
            score, k = min((1000000 * a * a // (of(w[:k]) * of(w[k:])), k) for k in range(1, len(w)))  # noqa: B023
            rows.append((-score, -a, " ".join(w).encode(), of(w[:k]), of(w[k:])))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_frame(spark, docs):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(docs)], DOCS)


def test_phrases_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ROWS", 50)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)] + ["É", "ÉCOLE", "der", "\x1c", "a\x00b", "日本"]
    docs = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " - "]) for _ in range(rng.randrange(400)))) for _ in range(60)]
    docs += [("en", "x x x x x x x x x x x x x x"), ("en", None), ("en", ""), ("de", "?!"), ("und", "lone word")] * 2
    df = phrase_frame(spark, docs).repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df).collect())
    assert got == brute_phrases(docs) and len(got) > 100
    few = sorted(tuple(r) for r in phrases.collocations(df, top=7).collect())
    assert few == [r for r in got if r[1] <= 7]


def test_phrases_of_many_shards_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 100)
    monkeypatch.setattr(phrases, "FILTER_WORDS", 1)  # a filter that passes all
    docs = [("en", "one two three four. " * 3000), ("en", " ".join(f"n{k % 7} n{k % 11}" for k in range(20000)))] + [("en", "one two")] * 30
    assert sorted(tuple(r) for r in phrases.collocations(phrase_frame(spark, docs)).collect()) == brute_phrases(docs)


def test_phrases_of_empty_and_clashing_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert phrases.collocations(none).collect() == []
    assert phrases.collocations(phrase_frame(spark, [("en", None), (None, "")])).collect() == []
    docs = [(None, "alpha beta gamma. " * 12)]
    df = phrase_frame(spark, docs)
    for c in ("phrase", "a", "l", "r", "n", "score", "words", "cell", "part", "h"):
        df = df.withColumn(c, F.lit(1))
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == brute_phrases(docs)


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**12, 4 * 10**12, 5 * 10**12)], "a long, l long, r long").select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()
    assert row[0] == 1000000 * 9 * 10**24 // (20 * 10**24)


# variants


def brute_variants(docs, least=5, ratio=5, one_in=199):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % one_in == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in others.items():
        if xs and n[best := min(xs, key=lambda x: (-n[x], x))] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(others[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_variants_equal_brute_force(spark):
    rng = random.Random(9)
    letters = "abcdéèÀ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(60)] + ["aaaaaa", "abababab", "×÷×÷×÷"]
    words = []
    for k, w in enumerate(base):
        words += [w] * rng.choice([5, 8, 30, 200])
        for _ in range(6):
            i = rng.randrange(len(w))
            edited = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w + "a", "b" + w])
            words += [edited] * rng.choice([4, 5, 6, 40])
    words += ["mountain"] * 400 + ["mountaine"] * 50 + ["mountainee"] * 6
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", "-", ", ", "9", "_"]).join(words[i * 50 : i * 50 + 50]).title()) for i in range(len(words) // 50)]
    docs += [(None, "Repeated repeated REPEATED repeated repeated"), (7, None), (8, ""), (9, "shorts a b c"), (9, "shorts a b c"), (10, "x" * 100_000 + " " + "x" * 99_999)] + [(k, "y" * 50_000) for k in range(11, 17)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for c in ("word", "n", "key", "form", "root", "best", "id"):
        df = df.withColumn(c, F.lit(1))
    got = sorted((tuple(r) for r in variants.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    want = brute_variants(docs)
    assert got == want and sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] for w in want if w[1])
    assert variants.spelling_variants(df.limit(0)).collect() == []


def test_checksums_take_a_letter(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6 + k % 3)) for k in range(40)) + " steady") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: r.n for r in variants.word_counts(df, least=1, one_in=3).collect()}
    want = Counter()
    for doc, text in docs:
        for w in text.split():
            want[variants.planted_word(w, zlib.crc32(f"{doc}:{w}".encode()), 3)] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 6}


def test_rarest_bigrams_hold_one_of_every_near_pair():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(6, 9))) for _ in range(900)})
    grams = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    order = {g: k for k, (_, g) in enumerate(sorted((n, g) for g, n in grams.items()))}
    short, long = ({w: set(keys(w, order)) for w in words} for keys in (variants.shorter_keys, variants.longer_keys))
    n = 0
    for w in words:
        for i in range(len(w)):
            for edited in (w[:i] + w[i + 1 :], *(w[:i] + c + w[i + 1 :] for c in "abc" if c != w[i])):
                if edited in short:
                    n += 1
                    assert short[edited] & long[w]
    assert n > 1000


# archives


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def brute_archive(rows, least=100):
    by = defaultdict(list)
    for p, _, html in rows:
        by[html or ""].append(p)
    out = []
    for p, _, html in rows:
        data = (html or "").encode()
        known = [x for x in by[html or ""] if x is not None]
        first = min(known) if len(data) >= least and known and min(known) != p else None
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "response" if first is None else "revisit", first))
    return sorted(out, key=str)


ROWS = [(k, f"http://a.example/{k}?q=é\r\nX: y", "<p>" + "same " * 40) for k in range(9, 3, -1)] + [
    (1, None, None), (2, "", ""), (3, "http://b/", "short"), (10, "u", "short"), (11, "u", "é" * 50), (12, "u", "é" * 50), (12, "u", "é" * 50), (11, "u", "é" * 50),
    (None, "u", "é" * 50), (None, None, "z" * 100), (13, "u", "WARC/1.1\r\nContent-Length: 7\r\n\r\n" * 10), (14, "u", "y" * 99), (15, "u", "y" * 99), (16, "u", os.urandom(150_000).hex()),
]


def test_archives_give_back_every_page(spark, monkeypatch):
    df = pages_frame(spark, ROWS)
    for c in ("digest", "first", "n", "revisit", "archive", "index"):
        df = df.withColumn(c, F.lit(1))
    out = warc.archive_digest(df.repartition(3))
    got = sorted((tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute_archive(ROWS)
    assert warc.archive_digest(df.limit(0)).collect() == []


def test_every_member_opens_alone(spark, tmp_path):
    whole, members = f"file://{tmp_path}/whole", f"file://{tmp_path}/members"
    written = warc.write_archives(pages_frame(spark, ROWS).coalesce(1), whole)
    assert [r.records for r in written.collect()] == [len(ROWS)]
    source = gzip.decompress((tmp_path / "whole" / written.first().archive).read_bytes())
    manifest = warc.normalise_archives(written, whole, members)
    entry = manifest.first()
    data = (tmp_path / "members" / entry.archive).read_bytes()
    assert gzip.decompress(data) == source and entry.records == len(ROWS) + 1 and entry.bytes == len(data)
    records = warc.read_archives(manifest, members).collect()
    html = {r[0]: r[2] or "" for r in ROWS}
    assert len(records) == len(ROWS)
    for r in records:
        alone = zlib.decompress(data[r.offset : r.offset + r.length], 31)
        assert alone.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and alone.endswith(b"\r\n\r\n")
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None and r.page_id is not None:
            assert bytes(r.payload).decode() == html[r.page_id]


@pytest.mark.parametrize("chunk", [1, 7, 1000, 1 << 18])
def test_normaliser_takes_any_chunking(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    records = [warc.info("x")] + [warc.record(k, "u", os.urandom(k * 50), "d", None, False) for k in range(6)]
    whole = gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))
    out = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(whole), out))
    assert [zlib.decompress(out.getvalue()[e["offset"] : e["offset"] + e["length"]], 31) for e in index] == records
    for damaged in (whole[:-9], whole[:40], gzip.compress(b"".join(records)[:-60]), gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.normalise(io.BytesIO(damaged), io.BytesIO()))


def test_new_queries_equal_their_sql(spark):
    import duckdb

    from arborflow.llm.queries import oracle_sql, queries

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("op11_phrases", "op12_variants", "op13_archives"):
        got, want = queries()[name](spark, d), con.sql(oracle_sql()[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
