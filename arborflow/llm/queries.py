"""The opN_ queries over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborflow.llm import ann, bpe, langid, linededup, media, minhash, mixing, phrases, quality, suffix, toxicity, variants, warc
from arborflow.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines_digest(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats_digest(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where records lie differs from run to run, so only what they say is returned."""
    return warc.archive_digest(table(spark, sf_dir, "pages")).drop("archive", "offset", "length")


#: Line dedup needs no method for its result, so plain SQL can say it. Keys strip blanks and fold A-Z only.
LINE_SQL = """
WITH lines AS (
  SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
), repeated AS (
  SELECT k, min(doc_id) AS least FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT doc_id, n, line, r.k IS NOT NULL AND doc_id <> least AS lost FROM lines LEFT JOIN repeated r USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(lost::INT)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Plain SQL hashes every string of 400 bytes, in pieces of 1,024 starts of a text's hexadecimal form: far more work than the operator's, for small tables.
REPEAT_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), pieces AS (
  SELECT doc_id, n, k, substr(x, 2 * k + 1, 2 * (1024 + 399)) AS piece FROM d, unnest(generate_series(0, n - 400, 1024)) AS s(k)
), strings AS (
  SELECT doc_id, k + j AS p, md5(substr(piece, 2 * j - 1, 800)) AS h FROM pieces, unnest(generate_series(1, least(1024, n - 399 - k))) AS s(j)
), starts AS (
  SELECT doc_id, p, p > lag(p, 1, -400) OVER (PARTITION BY doc_id ORDER BY p) + 400 AS opens FROM (SELECT doc_id, p FROM strings QUALIFY count(*) OVER (PARTITION BY h) > 1)
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM (SELECT doc_id, p, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts) GROUP BY doc_id, run
), bounds AS (
  SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, n + 1, n + 1 FROM d
), gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY a, b) AS since FROM bounds
)
SELECT doc_id, any_value(n)::BIGINT AS n_bytes, sum(b - a)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans, sha256(unhex(string_agg(substr(x, 2 * since - 1, 2 * (a - since)), '' ORDER BY a, b))) AS kept_sha256
FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
"""


#: Plain counts of all phrases, instead of bitmaps.
PHRASE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d)
), n AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang
), f AS (
  SELECT lang, ws[i : i + k - 1] AS w, count(*)::BIGINT AS a FROM pieces, unnest([1, 2, 3]) AS ks(k), unnest(range(1, len(ws) - k + 2)) AS s(i) GROUP BY ALL
), candidates AS (
  SELECT * FROM f WHERE len(w) > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.w, c.a, k, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidates) c JOIN f l ON l.lang = c.lang AND l.w = c.w[1 : k] JOIN f r ON r.lang = c.lang AND r.w = c.w[k + 1 :]
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1
), longest AS (
  SELECT lang, w, max(a) AS top FROM (SELECT lang, unnest([w[1 : 2], w[2 : 3]]) AS w, a FROM candidates WHERE len(w) = 3) GROUP BY lang, w
), kept AS (
  SELECT s.lang, array_to_string(s.w, ' ') AS phrase, a, l, r, score FROM scored s LEFT JOIN longest g ON g.lang = s.lang AND g.w = s.w WHERE coalesce(100 * top < 50 * a, true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

#: Words without one letter meet, which needs no bigrams; the checksum's table follows from its polynomial.
VARIANT_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS b(i))
), runs AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS key, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run FROM documents) GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(key, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), without AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM without x JOIN without y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM without x JOIN words y ON y.word = x.a || x.b
  UNION SELECT y.word, y.n, x.word, x.n FROM without x JOIN words y ON y.word = x.a || x.b
), best AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form AS tip, 1 AS k FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.tip WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, tip AS root FROM chain QUALIFY row_number() OVER (PARTITION BY word ORDER BY k DESC) = 1
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""

#: What the archives must say, without writing any.
ARCHIVE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
), told AS (
  SELECT p.*, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN firsts USING (payload_digest)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM told
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_bpe, op3_line_dedup, op4_language, op5_mixing, op6_neighbours, op7_repeats, op8_near_duplicates, op9_toxicity, op10_media, op11_phrases, op12_variants, op13_archives)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_SQL, "op7_repeats": REPEAT_SQL, "op11_phrases": PHRASE_SQL, "op12_variants": VARIANT_SQL, "op13_archives": ARCHIVE_SQL}
