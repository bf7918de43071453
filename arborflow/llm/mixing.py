"""Mixing to target weights with soft membership, in DataFrame operations only.

A table of word counts by domain, from a bounded sample of labelled rows, is a
multinomial classifier; its tempered posteriors give every document a share in
each domain. Rates of documents, 0 or another least rate at least, are fitted by projected gradient so that
the expected tokens of each domain, sum of r x tokens x share, match the targets:
least squares, weighted by target, with a small pull to rate 1. A document's
rate follows from its shares and the steps' few numbers, so a step is one scan
with partial sums of as many numbers as domains, and no state is kept by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborflow.llm.common import fresh, materialize

#: Labelled rows used for counting words, shared evenly by the domains, those of least hash of each; DOMAIN_ROWS is the least share. Words kept of them at most, those of most weight in some domain.
FIT_ROWS, DOMAIN_ROWS, WORDS = 4_000, 100, 3_000
#: Words' worth of evidence that a text's posterior counts at most: long texts stay soft.
EVIDENCE = 40.0
STEPS, PULL, TEMPERATURE = 25, 0.002, 0.7
#: Slots of a domain's ids that are ranked apart before their heads meet: the last task of a domain gets at most SLOTS samples, whatever the number of input tasks.
SLOTS = 16


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def domain_table(docs: DataFrame, domain: str = "lang", rows: int = FIT_ROWS, words: int = WORDS) -> tuple[DataFrame, list[str]]:
    """(table, domains): word and its log-likelihoods by domain, less their mean, in the order of domains.

    Every domain of a labelled text with a word is in it, however rare.
    """
    labelled = docs.where(F.col(domain).isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull()).select(F.col(domain).cast("string").alias("d"), "doc_id", "text")
    each = materialize(labelled.select("d", "doc_id").distinct(), "labelled-ids")
    share = max(DOMAIN_ROWS, rows // max(1, each.select("d").distinct().count()))
    ids = each.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))
    for by in (["d", "slot"], ["d"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
        ids = ids.withColumn("k", place).where(F.col("k") <= share)
    ids = ids.select("d", "doc_id")
    some = labelled.join(F.broadcast(ids), ["d", "doc_id"], "left_semi")  # `share` ids a domain
    counts = materialize(some.select("d", F.explode(F.array_distinct(_words(F.col("text")))).alias("w")).where("w <> ''").groupBy("d", "w").count(), "word-counts")
    totals = {r.d: r.n for r in counts.groupBy("d").agg(F.sum("count").alias("n")).collect()}
    domains = sorted(totals)
    top = counts.groupBy("w").agg(F.sum("count").alias("n"), *[F.sum(F.when(F.col("d") == d, F.col("count")).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)])
    weight = F.array_max(F.array(*[F.col(f"n{k}") / F.lit(float(totals[d])) for k, d in enumerate(domains)])) if domains else F.col("n")
    top = top.orderBy(F.desc(weight), F.desc("n"), "w").limit(words)
    logs = [F.log((F.col(f"n{k}") + 0.5) / F.lit(float(totals[d] + words))) for k, d in enumerate(domains)]
    mean = sum(logs[1:], logs[0]) / len(logs) if logs else F.lit(0.0)
    return top.select("w", F.array(*[x - mean for x in logs]).alias("l")), domains


def soft_membership(docs: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """doc_id, tokens, shares for each distinct doc_id of docs; texts without known words share evenly.

    tokens counts words parted by blanks. Rows that repeat a doc_id add up.
    """
    words = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(_words(F.coalesce("text", F.lit("")))).alias("w"))
    evidence = words.join(F.broadcast(table), "w", "left")  # at most WORDS words
    sums = evidence.groupBy("doc_id").agg(F.count("l").alias("known"), *[F.coalesce(F.sum(F.col("l")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(n)])
    tokens = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sum(F.coalesce(F.size(F.expr("filter(split(text, '\\\\s+'), x -> x <> '')")), F.lit(0))).alias("tokens"))
    temper = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.col("known"), F.lit(1)))
    z = [F.col(f"s{k}") * temper for k in range(n)]
    e = [F.exp(x - F.greatest(*z) if n > 1 else x - x) for x in z]
    total = sum(e[1:], e[0])
    shares = sums.select("doc_id", F.array(*[x / total for x in e]).alias("shares"))
    return tokens.join(shares, "doc_id").select("doc_id", F.greatest("tokens", F.lit(0)).cast("double").alias("tokens"), "shares")


def _rate(moves: list[list[float]], least: float = 0.0) -> Column:
    """The rate after projected steps: r <- max(least, r - (shares . move + PULL (r - 1)))."""
    r = F.lit(1.0)
    if not moves:
        return r
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in moves])
    return F.aggregate(steps, r, lambda r, m: F.greatest(F.lit(float(least)), r - F.aggregate(F.zip_with("shares", m, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y) - F.lit(PULL) * (r - 1.0)))


def fit_rates(members: DataFrame, n: int, weights: list[float] | None = None, total: float | None = None, steps: int = STEPS, least: float = 0.0) -> tuple[Column, list[float], list[float]]:
    """(rate expression, targets, reached) over members (tokens, shares).

    weights: the domains' target shares of `total` tokens. Without weights, each
    domain's present share to the power TEMPERATURE; without total, the least
    one at which no domain has to shrink. No rate is below `least`, at most 1.
    """
    sums = [F.coalesce(F.sum(F.col("tokens") * F.col("shares")[k]), F.lit(0.0)).alias(f"a{k}") for k in range(n)]
    have = [float(x) for x in members.agg(*sums).first()]
    all_of = sum(have)
    if not n or all_of <= 0:
        return F.lit(1.0), have, have
    if weights is None:
        raised = [(h / all_of) ** TEMPERATURE for h in have]
        weights = [x / sum(raised) for x in raised]
    if total is None:
        total = max(h / w for h, w in zip(have, weights) if w > 0)
    targets = [w * total for w in weights]
    scale = [max(t, 1e-6 * total) for t in targets]
    gram = [F.sum(F.col("tokens") * F.col("shares")[i] * F.col("shares")[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(n)]
    g = [float(x) for x in members.agg(*gram).first()]
    bound = max(sum(abs(g[i * n + j]) / scale[i] for j in range(n)) for i in range(n))  # of the largest eigenvalue
    moves: list[list[float]] = []
    reached = have
    for _ in range(steps):
        moves.append([(x - t) / s / max(bound, 1e-12) for x, t, s in zip(reached, targets, scale)])
        rate = _rate(moves, least)
        reached = [float(x) for x in members.select("tokens", "shares", rate.alias("r")).agg(*[F.sum(F.col("tokens") * F.col("shares")[k] * F.col("r")).alias(f"a{k}") for k in range(n)]).first()]
        if max(abs(x - t) / s for x, t, s in zip(reached, targets, scale)) < 0.005:
            break
    return _rate(moves, least), targets, reached


def copies_of(rate: Column, doc_id: Column) -> Column:
    """Whole copies: the rate rounded down, and one more for a hash of the id below the rest. Rates within 0.01 of a whole number count as that."""
    rate = F.when(F.abs(rate - F.round(rate)) < 0.01, F.round(rate)).otherwise(rate)
    u = F.pmod(F.xxhash64(doc_id, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixing_rates(docs: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, total: float | None = None, least: float = 0.0) -> DataFrame:
    """doc_id, tokens, domain, share, rate, copies for each distinct doc_id: domain is the likeliest and share its posterior.

    Rows without doc_id are left out. Without any labelled word every rate is 1
    and domain is null. Weights of domains that no labelled text has are refused.
    No rate is below `least`.
    """
    table, domains = domain_table(docs, domain)
    n = len(domains)
    if n and (unknown := set(weights or ()) - set(domains)):
        raise ValueError(f"no labelled text of the weighted domains {sorted(unknown)}")
    if not n:
        return docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.lit(0.0).alias("tokens"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("share"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    members = materialize(soft_membership(docs, materialize(table, "domain-table"), n), "membership")
    wanted = None if weights is None else [weights.get(d, 0.0) for d in domains]
    rate, _, _ = fit_rates(members, n, wanted, total, least=least)
    best = F.array_position("shares", F.array_max("shares"))
    out = members.withColumn("rate", rate).select("doc_id", "tokens", F.element_at(F.array(*map(F.lit, domains)), best.cast("int")).alias("domain"), F.array_max("shares").alias("share"), "rate")
    return out.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id")))


def mix(docs: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, least: float = 0.0) -> DataFrame:
    """docs, all columns, each row as often as its copies say (0 drops it; with least 1 none is dropped). Rows without doc_id stay once."""
    doc, copies, copy = (fresh(name, docs) for name in ("doc", "copies", "copy"))
    take = mixing_rates(docs, domain, weights, least=least).select(F.col("doc_id").alias(doc), F.col("copies").alias(copies))
    joined = docs.join(take, F.col("doc_id") == F.col(doc), "left")
    each = F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)))).alias(copy)
    return joined.select(*docs.columns, each).where(F.col(copy) > 0).drop(copy)
