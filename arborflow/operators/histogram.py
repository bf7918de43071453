"""Gradient histograms. g and h are LONG, in millionths, so sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed point of gradients.
UNIT = 1_000_000
#: Nodes whose sums are looked up in a literal; more are joined.
MAP_NODES = 256


def fixed(x: Column) -> Column:
    """A gradient in millionths."""
    return F.round(x * UNIT).cast("long")


def node_sums(rows: DataFrame) -> DataFrame:
    """(nid, g, h, n)."""
    return rows.groupBy("nid").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def level_histogram(rows: DataFrame, by: tuple[str, ...] = (), bins: str = "bins", count: bool = False) -> DataFrame:
    """(by..., nid, fid, bid, g, h[, n]) of rows (nid, g, h, bins): one exchange, after partial sums in each task. Missing values are left out."""
    cells = rows.select(*by, "nid", "g", "h", F.posexplode(bins).alias("fid", "bid")).where(F.col("bid").isNotNull())
    return cells.groupBy(*by, "nid", "fid", "bid").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), *[F.count("*").alias("n")] * count)


def with_siblings(small: DataFrame, parents: DataFrame, family: list[tuple[int, int, int]]) -> DataFrame:
    """Histograms (nid, fid, bid, g, h, n) of both children from those of the smaller ones and of the parents; exact.

    family: (parent, smaller child, other child). A cell travels twice, under its
    own node and subtracted under its sibling, so no join is needed. Histograms
    that were merged under masks or encryption have no n; their cells without
    rows stay, with sums of 0, which add no better split.
    """
    sums = [c for c in ("g", "h", "n") if c in small.columns]
    sibling = f"map({', '.join(f'{a}, {b}' for _, a, b in family)})[nid]"
    other = f"map({', '.join(f'{p}, {b}' for p, _, b in family)})[nid]"
    both = small.selectExpr("fid", "bid", f"inline(array(struct(nid, {', '.join(sums)}), struct({sibling} AS nid, {', '.join(f'-{c} AS {c}' for c in sums)})))")
    up = parents.where(f"nid IN ({', '.join(str(p) for p, _, _ in family)})").selectExpr("fid", "bid", f"{other} AS nid", *sums)
    cells = both.unionByName(up).repartition("nid", "fid").groupBy("nid", "fid", "bid")
    found = cells.agg(*[F.expr(f"sum({c}) AS {c}") for c in sums])
    return found.where("n > 0") if "n" in sums else found


def structured_histogram(rows: DataFrame, wanted: dict[int, int]) -> DataFrame:
    """The histogram of the feature that a predefined structure gives each node, wanted[nid]; a row is one cell, whatever the number of features."""
    fid = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col("nid")]
    cells = rows.where(F.col("nid").isin(list(wanted))).select("nid", "g", "h", fid.alias("fid"), F.get("bins", fid).alias("bid"))
    return cells.where("bid is not null").groupBy("nid", "fid", "bid").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def node_histogram(rows: DataFrame) -> DataFrame:
    """(fid, bid, g, h) of rows (g, h, bins) of one node."""
    return level_histogram(rows.withColumn("nid", F.lit(0))).drop("nid")


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Sibling = parent - child, over (fid, bid); exact. Cells the child lacks are the parent's."""
    c = child.select("fid", "bid", F.col("g").alias("cg"), F.col("h").alias("ch"))
    return parent.join(c, ["fid", "bid"], "left").select("fid", "bid", (F.col("g") - F.coalesce("cg", F.lit(0))).alias("g"), (F.col("h") - F.coalesce("ch", F.lit(0))).alias("h"))


def prefix_sums(hist: DataFrame) -> DataFrame:
    """hist with rg, rh: sums over values >= the cut, the right child without missing rows."""
    w = "OVER (PARTITION BY nid, fid ORDER BY bid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return hist.selectExpr("*", f"sum(g) {w} AS rg", f"sum(h) {w} AS rh")


def missing_sums(hist: DataFrame, nodes: DataFrame | dict[int, tuple[int, int]]) -> DataFrame:
    """hist (prefix sums or not) with the node's sums pg, ph and the feature's missing sums mg, mh. nodes: (nid, g, h), as a frame or on the driver."""
    if isinstance(nodes, dict) and len(nodes) <= MAP_NODES:
        of = lambda k: f"map({', '.join(f'{n}, {s[k]}L' for n, s in nodes.items())})[nid]"
        joined = hist.where(f"nid IN ({', '.join(map(str, nodes))})").selectExpr("*", f"{of(0)} AS pg", f"{of(1)} AS ph")
    else:
        if isinstance(nodes, dict):
            nodes = hist.sparkSession.createDataFrame([(n, *s) for n, s in nodes.items()], "nid int, g long, h long")
        joined = hist.join(F.broadcast(nodes.select("nid", F.col("g").alias("pg"), F.col("h").alias("ph"))), "nid")  # nodes: at most 2^level rows
    w = "OVER (PARTITION BY nid, fid)"
    return joined.selectExpr("*", f"pg - sum(g) {w} AS mg", f"ph - sum(h) {w} AS mh")


def merge(hist: DataFrame) -> DataFrame:
    """Element-wise sums over parties."""
    return hist.groupBy("nid", "fid", "bid").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def merge_interpolated(hist: DataFrame, party_cuts: DataFrame, cuts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Histograms over parties' own cuts, moved to global cuts by the share of each party bin's width that overlaps.

    A bin reaches from its cut up to the next larger one, the first up to the
    feature's largest value; the last one reaches down to the least value.
    Bins of no width go whole to the global bin that holds their cut.
    """

    def spans(c: DataFrame, by: list[str], names: tuple[str, str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("bid")
        top = F.coalesce(F.lag("cut").over(w), F.greatest("hi", "cut"))
        low = F.when(F.lead("cut").over(w).isNull(), F.least("lo", "cut")).otherwise(F.col("cut"))
        return c.join(ranges.select("fid", "lo", "hi"), "fid").select(*by, "bid", low.alias(names[0]), top.alias(names[1]))

    mine = spans(party_cuts, ["party_id", "fid"], ("a0", "a1"))
    ours = spans(cuts, ["fid"], ("b0", "b1")).withColumnRenamed("bid", "to")
    first = Window.partitionBy("fid").orderBy("to")
    ours = ours.withColumn("is_first", F.row_number().over(first) == 1)
    overlap = F.least("a1", "b1") - F.greatest("a0", "b0")
    flat = (F.col("a0") == F.col("a1")) & (F.col("a0") >= F.col("b0")) & ((F.col("a0") < F.col("b1")) | F.col("is_first"))
    share = F.when(flat, 1.0).when((overlap > 0) & (F.col("a1") > F.col("a0")), overlap / (F.col("a1") - F.col("a0"))).otherwise(0.0)
    moved = hist.join(mine, ["party_id", "fid", "bid"]).join(ours, "fid").withColumn("share", share).where("share > 0")
    return moved.groupBy("nid", "fid", F.col("to").alias("bid")).agg(F.sum(F.col("g") * F.col("share")).alias("g"), F.sum(F.col("h") * F.col("share")).alias("h"))


def concat_vertical(parts: list[DataFrame], widths: list[int]) -> DataFrame:
    """Histograms over local features, as one over global features."""
    out, offset = None, 0
    for part, n in zip(parts, widths):
        shifted = part.withColumn("fid", F.col("fid") + offset)
        out = shifted if out is None else out.unionByName(shifted)
        offset += n
    return out


def owner_of(splits: DataFrame, owner: list[int]) -> DataFrame:
    """splits with the party that owns the winning feature, and its number there."""
    local: list[int] = []
    seen: dict[int, int] = {}
    for p in owner:
        local.append(seen.get(p, 0))
        seen[p] = local[-1] + 1
    return splits.withColumns({"party_id": F.array(*map(F.lit, owner))[F.col("fid")], "local_fid": F.array(*map(F.lit, local))[F.col("fid")]})
