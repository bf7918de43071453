"""DuckDB SQL that states the same results from the formulas: tables of features, cuts, bins, and trees unrolled level by level."""

from __future__ import annotations

#: The training table of the catalog: one row an order, six features, some missing.
FEATURES = """feat AS (
  SELECT o_orderkey AS row_id, o_totalprice / 1000 AS y, o_custkey, c_acctbal AS f0, c_nationkey::DOUBLE AS f1, month(o_orderdate)::DOUBLE AS f2,
    day(o_orderdate)::DOUBLE AS f3, substr(o_orderpriority, 1, 1)::DOUBLE AS f4, nullif(c_nationkey % 5, 0)::DOUBLE AS f5
  FROM orders JOIN customer ON o_custkey = c_custkey
), long AS (""" + " UNION ALL ".join(f"SELECT row_id, {k} AS fid, f{k} AS val FROM feat WHERE f{k} IS NOT NULL" for k in range(6)) + ")"


def cuts(kind: str = "range", bins: int = 16, source: str = "long", tag: str = "") -> str:
    """CTEs cuts<tag>(fid, bid, cut) and bins<tag>(row_id, fid, bid)."""
    if kind == "range":
        made = f"""ranges{tag} AS (SELECT fid, min(val) AS lo, max(val) AS hi FROM {source} GROUP BY fid),
        cuts{tag} AS (SELECT fid, bid::INTEGER AS bid, hi - bid * (hi - lo) / n AS cut FROM (SELECT *, CASE WHEN hi = lo THEN 1 ELSE {bins} END AS n FROM ranges{tag}), LATERAL (SELECT unnest(generate_series(0, n - 1)) AS bid))"""
    else:
        made = f"""vals{tag} AS (SELECT DISTINCT fid, val FROM {source}), ranked{tag} AS (SELECT fid, val, row_number() OVER (PARTITION BY fid ORDER BY val DESC) - 1 AS place, count(*) OVER (PARTITION BY fid) AS n FROM vals{tag}),
        cuts{tag} AS (SELECT fid, (place // greatest(n // {bins}, 1))::INTEGER AS bid, val AS cut FROM ranked{tag} WHERE place % greatest(n // {bins}, 1) = 0 AND (n < {bins} OR place // greatest(n // {bins}, 1) < {bins}))"""
    return f"""{made},
    bins{tag} AS (SELECT l.row_id, l.fid, least(count(*) FILTER (WHERE c.cut - 1e-6 > l.val), count(*) - 1)::INTEGER AS bid FROM {source} l JOIN cuts{tag} c USING (fid) GROUP BY l.row_id, l.fid)"""


def _score(g: str, h: str, lam: float) -> str:
    return f"(CASE WHEN ({h}) / 1000000.0::DOUBLE + {lam}::DOUBLE = 0 THEN 0 ELSE (({g}) / 1000000.0::DOUBLE) * (({g}) / 1000000.0::DOUBLE) / (({h}) / 1000000.0::DOUBLE + {lam}::DOUBLE) END)"


def _gain(lg: str, lh: str, rg: str, rh: str, lam: float, mcw: float) -> str:
    raw = f"{_score(lg, lh, lam)} + {_score(rg, rh, lam)} - {_score(f'({lg}) + ({rg})', f'({lh}) + ({rh})', lam)}"
    return f"(CASE WHEN ({lh}) / 1000000.0::DOUBLE >= {mcw} AND ({rh}) / 1000000.0::DOUBLE >= {mcw} THEN greatest({raw}, 0) ELSE 0 END)"


def level(src: str, tag: str, lam: float = 1.0, mcw: float = 1.0, bins: str = "bins", structure: str = "") -> str:
    """CTEs hist, gains and best of the rows (row_id, nid, g, h) of CTE src, with names ending in tag. structure: a CTE (nid, fid) of the only feature of each node."""
    left = _gain("pg - rg", "ph - rh", "rg", "rh", lam, mcw)
    right = _gain("pg - rg - mg", "ph - rh - mh", "rg + mg", "rh + mh", lam, mcw)
    return f"""hist{tag} AS (SELECT nid, fid, bid, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h FROM {src} JOIN {bins} USING (row_id) GROUP BY nid, fid, bid),
    node{tag} AS (SELECT nid, sum(g)::BIGINT AS pg, sum(h)::BIGINT AS ph FROM {src} GROUP BY nid),
    pre{tag} AS (SELECT nid, fid, bid, g, h, pg, ph, (sum(g) OVER w)::BIGINT AS rg, (sum(h) OVER w)::BIGINT AS rh, (pg - sum(g) OVER a)::BIGINT AS mg, (ph - sum(h) OVER a)::BIGINT AS mh
      FROM hist{tag} JOIN node{tag} USING (nid) WINDOW w AS (PARTITION BY nid, fid ORDER BY bid ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY nid, fid)),
    gains{tag} AS (SELECT *, CASE WHEN gl > gr THEN gl ELSE -gr END AS gain FROM (SELECT *, {left} AS gl, {right} AS gr FROM pre{tag})),
    best{tag} AS (SELECT nid, fid, bid, abs(gain) AS gain, NOT gain > 0 AS default_right, rg, rh, mg, mh FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY abs(gain) DESC, fid, bid) AS r FROM gains{tag}{f" JOIN {structure} USING (nid, fid)" if structure else ""}) WHERE r = 1)"""


def tree(src: str, depth: int, tag: str = "", lam: float = 1.0, mcw: float = 1.0, bins: str = "bins", structure: str = "", passing: str = "") -> str:
    """CTEs that grow a tree from src (row_id, g, h) and end in leaf<tag>(row_id, nid, weight).

    structure: a CTE (nid, fid) of the only feature of each node; nodes not in it
    are leaves. passing: a CTE (nid) of nodes that hand all rows to their left child.
    """
    here = f"WHEN r.nid IN (SELECT nid FROM {passing}) THEN 2 * r.nid + 1 " if passing else ""
    parts = [f"rows{tag}_0 AS (SELECT row_id, 0 AS nid, g, h FROM {src})"]
    for k in range(depth):
        at, nxt = f"rows{tag}_{k}", f"rows{tag}_{k + 1}"
        active = f"active{tag}_{k} AS (SELECT * FROM {at} WHERE nid >= {2**k - 1})"
        parts += [active, level(f"active{tag}_{k}", f"{tag}_{k}", lam, mcw, bins, structure)]
        parts.append(f"""{nxt} AS (SELECT r.row_id, CASE {here}WHEN s.nid IS NULL THEN r.nid WHEN coalesce(b.bid <= s.bid, s.default_right) THEN 2 * r.nid + 2 ELSE 2 * r.nid + 1 END AS nid, r.g, r.h
          FROM {at} r LEFT JOIN (SELECT * FROM best{tag}_{k} WHERE gain > 1e-6) s ON r.nid = s.nid LEFT JOIN {bins} b ON b.row_id = r.row_id AND b.fid = s.fid)""")
    parts.append(f"""weights{tag} AS (SELECT nid, -(sum(g)::BIGINT / 1000000.0::DOUBLE) / (sum(h)::BIGINT / 1000000.0::DOUBLE + {lam}::DOUBLE) AS weight FROM rows{tag}_{depth} GROUP BY nid),
    leaf{tag} AS (SELECT row_id, nid, weight FROM rows{tag}_{depth} JOIN weights{tag} USING (nid))""")
    return ",\n".join(parts)


def boosted(rounds: int, depth: int, rate: float, lam: float = 1.0, source: str = "feat", g: str = "round((m - y) * 1000000)::BIGINT", h: str = "1000000::BIGINT", tag: str = "") -> str:
    """CTEs that boost and end in margin<tag>_<rounds>(row_id, y, m)."""
    parts = [f"margin{tag}_0 AS (SELECT row_id, y, 0.0::DOUBLE AS m FROM {source})"]
    for t in range(rounds):
        parts.append(f"grad{tag}_{t} AS (SELECT row_id, {g} AS g, {h} AS h FROM margin{tag}_{t})")
        parts.append(tree(f"grad{tag}_{t}", depth, f"{tag}_t{t}", lam))
        parts.append(f"margin{tag}_{t + 1} AS (SELECT row_id, y, m + {rate}::DOUBLE * weight AS m FROM margin{tag}_{t} JOIN leaf{tag}_t{t} USING (row_id))")
    return ",\n".join(parts)


def hashed(seed: int, *key: str) -> str:
    """The number that operators.layout.hash_number makes."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(key)}, '{seed}')), 1, 12))::BIGINT"


def routed(rows: str, depth: int, tag: str, name: str, cuts: str = "cuts", bins: str | None = None, passing: str = "") -> str:
    """CTEs that end in <name>(row_id, weight): rows sent through the tree of tree(..., tag), by values or, if bins are named, by bins."""
    here = f"WHEN r.nid IN (SELECT nid FROM {passing}) THEN 2 * r.nid + 1 " if passing else ""
    parts = [f"{name}_0 AS (SELECT row_id, 0 AS nid FROM {rows})"]
    go, values = ("b.bid <= s.bid", bins) if bins else ("b.val - s.cut >= -1e-6", "long")
    for k in range(depth):
        parts.append(f"""{name}_{k + 1} AS (SELECT r.row_id, CASE {here}WHEN s.nid IS NULL THEN r.nid WHEN coalesce({go}, s.default_right) THEN 2 * r.nid + 2 ELSE 2 * r.nid + 1 END AS nid
          FROM {name}_{k} r LEFT JOIN (SELECT * FROM best{tag}_{k} JOIN {cuts} USING (fid, bid) WHERE gain > 1e-6) s ON r.nid = s.nid LEFT JOIN {values} b ON b.row_id = r.row_id AND b.fid = s.fid)""")
    parts.append(f"{name} AS (SELECT row_id, coalesce(weight, 0) AS weight FROM {name}_{depth} LEFT JOIN weights{tag} USING (nid))")
    return ",\n".join(parts)


def merged_structure(tags: list[str], sources: list[str], places: int = 3) -> str:
    """CTE structure(nid, fid) for `places` nodes: parties' best splits of tree(..., tag) of depth 2, the one of largest gain for its party's share of rows first; a split may follow once its parent there was taken."""
    items = " UNION ALL ".join(f"SELECT {p} AS p, nid, fid, gain * (SELECT sum(c) FROM totals) / (SELECT c FROM totals WHERE p = {p}) AS key FROM {best} WHERE gain > 1e-6" for p, tag in enumerate(tags) for best in (f"best{tag}_0", f"best{tag}_1"))
    totals = " UNION ALL ".join(f"SELECT {p} AS p, count(*) AS c FROM {src}" for p, src in enumerate(sources))
    parts = [f"totals AS ({totals})", f"items AS ({items})"]
    taken = []
    for k in range(places):
        free = " AND ".join(f"(p, nid) NOT IN (SELECT (p, nid) FROM {t})" for t in taken)
        ready = " OR ".join(["nid = 0", *(f"(p, (nid - 1) // 2) IN (SELECT (p, nid) FROM {t})" for t in taken)])
        parts.append(f"pick_{k} AS (SELECT * FROM items WHERE ({ready}){' AND ' + free if free else ''} ORDER BY key DESC, p, nid LIMIT 1)")
        taken.append(f"pick_{k}")
    parts.append("structure AS (" + " UNION ALL ".join(f"SELECT {k} AS nid, fid FROM {t}" for k, t in enumerate(taken)) + ")")
    return ",\n".join(parts)


def pruned(gamma: float) -> str:
    """CTE final(row_id, nid): leaves of the tree of depth 3 of tree('grad', 3) after pruning splits of two leaves whose gain is under gamma."""
    keep = lambda k, below: f"kept_{k} AS (SELECT nid FROM best_{k} b WHERE gain > 1e-6 AND (gain >= {gamma}{below}))"
    child = lambda k: f" OR EXISTS (SELECT 1 FROM kept_{k} c WHERE c.nid IN (2 * b.nid + 1, 2 * b.nid + 2))"
    return f"""{keep(2, "")}, {keep(1, child(2))}, {keep(0, child(1))},
    final AS (SELECT row_id, CASE WHEN r0.nid NOT IN (SELECT nid FROM kept_0) THEN r0.nid WHEN r1.nid NOT IN (SELECT nid FROM kept_1) THEN r1.nid WHEN r2.nid NOT IN (SELECT nid FROM kept_2) THEN r2.nid ELSE r3.nid END AS nid
      FROM rows_0 r0 JOIN rows_1 r1 USING (row_id) JOIN rows_2 r2 USING (row_id) JOIN rows_3 r3 USING (row_id))"""


def ranked(rows: str, ndcg: bool) -> str:
    """CTEs that end in pushed(row_id, g, h) of rows (row_id, grp, y, s): a row's hash names its partner among the rows of other labels."""
    delta = "CASE WHEN idcg = 0 THEN 0 ELSE abs((2 ** hy - 2 ** ly) * (1 / log2(hr + 2.0::DOUBLE) - 1 / log2(lr + 2.0::DOUBLE))) / idcg END" if ndcg else "1.0::DOUBLE"
    return f"""k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY s DESC, row_id) - 1 AS r, row_number() OVER (PARTITION BY grp ORDER BY y DESC, row_id) - 1 AS best FROM {rows}),
    ideal AS (SELECT grp, sum((2 ** y - 1) / log2(best + 2.0::DOUBLE)) AS idcg FROM k GROUP BY grp),
    others AS (SELECT a.y AS label, b.*, row_number() OVER (PARTITION BY a.grp, a.y ORDER BY b.y, b.row_id) - 1 AS nth FROM (SELECT DISTINCT grp, y FROM k) a JOIN k b ON b.grp = a.grp AND b.y <> a.y),
    drawn AS (SELECT k.*, {hashed(0, "row_id")} % n AS nth FROM k JOIN (SELECT grp, label, count(*) AS n FROM others GROUP BY grp, label) c ON c.grp = k.grp AND c.label = k.y),
    pairs AS (SELECT a.grp, a.row_id AS arow, a.y AS ay, a.s AS s_a, a.r AS ar, b.row_id AS brow, b.y AS b_y, b.s AS bs, b.r AS br FROM drawn a JOIN others b ON b.grp = a.grp AND b.label = a.y AND b.nth = a.nth),
    ends AS (SELECT idcg, CASE WHEN ay > b_y THEN arow ELSE brow END AS hi, CASE WHEN ay > b_y THEN brow ELSE arow END AS lo, greatest(ay, b_y) AS hy, least(ay, b_y) AS ly,
      CASE WHEN ay > b_y THEN s_a ELSE bs END AS hs, CASE WHEN ay > b_y THEN bs ELSE s_a END AS ls, CASE WHEN ay > b_y THEN ar ELSE br END AS hr, CASE WHEN ay > b_y THEN br ELSE ar END AS lr FROM pairs JOIN ideal USING (grp)),
    force AS (SELECT hi, lo, d * rho AS l, 2 * greatest(d * rho * (1 - rho), 1e-16) AS w FROM (SELECT *, {delta} AS d, 1 / (1 + exp(hs - ls)) AS rho FROM ends)),
    pushed AS (SELECT row_id, sum(g) AS g, sum(h) AS h FROM (SELECT hi AS row_id, -l AS g, w AS h FROM force UNION ALL SELECT lo, l, w FROM force) GROUP BY row_id)"""
