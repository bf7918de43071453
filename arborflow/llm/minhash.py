"""Near duplicates by DartMinHash signatures, bands, exact checks and components.

A text is a weighted set: its shingles of five words, weighted by count. The
region of a shingle in weight x rank space holds a fixed pattern of darts,
one expected per unit weight and rank cell, each with a coordinate; a set takes
the darts inside its weights up to a rank bound that falls with the set's size,
and a coordinate's value is its earliest dart. Two sets agree in a coordinate
with the probability of their weighted Jaccard similarity. Counts are whole, so
unit cells of weight are numbered copies of the shingle.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborflow.llm.common import HOT, join_hot, map_columns, materialize

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
#: Expected darts for each coordinate within the rank bound, at first.
DARTS = math.log(COORDINATES) + 4
#: Cells handled at once; bounds memory.
CELLS = 1 << 20
#: Members of a bucket, and queries, that one task compares, and the size up to which ids are broadcast.
BLOCK, BROADCAST_BYTES = 1024, 64 << 20

_U = np.uint64
_POISSON = [_U(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32)) for k in range(9)]
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def elements(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, element hash) of all shingles, copies numbered; sorted by both.

    Words are runs without ASCII blanks, in lower case. A text of one to four
    words is one shingle; one without words has none.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends_of = np.cumsum([len(r) + 1 for r in raw])
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    stops = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * _powers(_B, len(data)))])
    word = mix((total[stops] - total[starts]) * _powers(_B_INV, len(data))[starts] + (stops - starts).astype(_U))
    doc = np.searchsorted(ends_of, starts, side="right")
    n = len(word)
    shingle = np.zeros(n, _U)
    for k in range(WORDS):
        same = doc[k:] == doc[: n - k]
        shingle[: n - k] += np.where(same, mix(word[k:] + _U(k + 1)), _U(0)) * _U(2 * k + 3)
    length = np.bincount(doc, minlength=len(texts))
    place = np.arange(n) - np.concatenate([[0], np.cumsum(length)[:-1]])[doc]
    whole = (place + WORDS <= length[doc]) | (place == 0)
    doc, shingle = doc[whole], mix(shingle[whole])
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])])
    at = np.arange(len(doc))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    return doc, mix(shingle + copy.astype(_U) * _U(_B))


def signatures(doc: np.ndarray, element: np.ndarray, n: int) -> np.ndarray:
    """n x COORDINATES earliest darts; rows of texts without elements are all ones."""
    none = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, COORDINATES), none)
    size = np.bincount(doc, minlength=n)
    reach = DARTS
    todo = size > 0
    while todo.any():
        bound = np.where(todo, reach * COORDINATES / np.maximum(size, 1), 0)  # in rank cells
        cells = np.ceil(bound).astype(np.int64)
        chosen = np.flatnonzero(todo[doc])
        per = cells[doc[chosen]]
        cut = np.searchsorted(np.cumsum(per), np.arange(CELLS, int(per.sum()) + CELLS, CELLS))
        for part in np.split(chosen, np.minimum(cut + 1, len(chosen))):
            if len(part):
                _throw(out, doc[part], element[part], cells[doc[part]], bound)
        todo &= (out == none).any(axis=1)
        reach *= 2
    return out


def _throw(out, doc, element, cells, bound) -> None:
    d = np.repeat(doc, cells)
    cell = np.arange(len(d)) - np.repeat(np.concatenate([[0], np.cumsum(cells)[:-1]]), cells)
    h = mix(np.repeat(element, cells) + cell.astype(_U) * _U(0xD1B54A32D192ED03))
    u = h >> _U(32)
    for k in range(9):  # the k-th dart of a cell, where the Poisson count exceeds k
        has = u >= _POISSON[k]
        if not has.any():
            break
        d, cell, h, u = d[has], cell[has], h[has], u[has]
        dart = mix(h + _U((k + 1) * 0xA24BAED4963EE407 % 2**64))
        fraction = dart >> _U(20)
        inside = cell + fraction.astype(np.float64) / 2.0**44 < bound[d]
        rank = (cell[inside].astype(_U) << _U(44)) | fraction[inside]
        np.minimum.at(out.reshape(-1), d[inside] * COORDINATES + (mix(dart[inside]) % _U(COORDINATES)).astype(np.int64), rank)


def bands(signature: np.ndarray) -> np.ndarray:
    """n x BANDS 64-bit keys."""
    x = mix(signature + _U(1)).reshape(len(signature), BANDS, ROWS) * np.arange(3, 2 * ROWS + 3, 2, dtype=_U)
    return mix(x.sum(axis=2, dtype=_U) + np.arange(BANDS, dtype=_U) * _U(_B)).view(np.int64)


def _band_rows():
    def fn(ids, digests, texts):
        doc, element = elements(texts)
        keys = bands(signatures(doc, element, len(texts)))
        has = np.bincount(doc, minlength=len(texts)) > 0
        return ids, digests, [k.tolist() if y else None for k, y in zip(keys, has)]

    return fn


def _element_rows():
    def fn(ids, texts):
        doc, element = elements(texts)
        cuts = np.searchsorted(doc, np.arange(1, len(texts)))
        sets = [np.sort(x) for x in np.split(element.astype("<u8"), cuts)]
        return ids, [len(x) for x in sets], [x.tobytes() for x in sets]

    return fn


def _similar(least: float):
    def fn(a, b, xs, ys):
        return a, b, [_jaccard(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= least for x, y in zip(xs, ys)]

    return fn


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sets of numbered copies, each copy once in a set."""
    if len(x) + len(y) == 0:
        return 1.0
    z = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((z[1:] == z[:-1]).sum())
    return common / max(1, len(x) + len(y) - common)


def _cross_links(least: float, key, queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
    """Links from each query to one member of each other component among the items that is at least that similar."""
    out = []
    if len(queries) and len(items):
        sets = [np.frombuffer(x, "<u8") for x in items["elements"]]
        sizes = np.array([len(s) for s in sets])
        words, place = np.unique(np.concatenate(sets), return_inverse=True)
        starts, ids, of = np.concatenate([[0], np.cumsum(sizes)[:-1]]), items["id"].to_numpy(), items["component"].to_numpy()
        for q, c, x in zip(queries["id"], queries["component"], queries["elements"]):
            x = np.frombuffer(x, "<u8")
            at = np.minimum(np.searchsorted(words, x), len(words) - 1)
            mark = np.bincount(at[words[at] == x], minlength=len(words)) > 0
            common = np.add.reduceat(mark[place].astype(np.int64), starts)
            near = np.flatnonzero((common >= (least - 1e-3) * (sizes + len(x) - common)) & (of != c))
            for k in near[np.unique(of[near], return_index=True)[1]] if len(near) else ():
                hits = near[of[near] == of[k]]
                found = next((h for h in hits if _jaccard(x, sets[h]) >= least), None)
                if found is not None:
                    out.append((min(q, ids[found]), max(q, ids[found])))
    return pd.DataFrame(sorted(set(out)), columns=["a", "b"])


def size_class(size: Column, similarity: float) -> Column:
    """Sets at least that similar are of the same class of size or of neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -math.log(similarity) + 1e-9).cast("int")


def verified_links(docs: DataFrame, similarity: float = SIMILARITY, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts, links): texts has doc_id, __digest, __class (least id of the equal texts); links (a, b) joins classes at least that similar.

    First, within each band's bucket every class is compared with the least one.
    Buckets whose members are by then one component are done. In the others, the
    members outside the most frequent component are the queries, compared with
    all members whose size allows the similarity; a task gets BLOCK queries and
    BLOCK members or so. They leave one link to each component they belong to,
    so no link between components is missed, and no list of pairs is made.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("__digest")
    keyed = materialize(map_columns(docs, ["doc_id", digest, "text"], _band_rows, "doc_id long, __digest binary, keys array<long>"), "signatures")
    reps = materialize(keyed.groupBy("__digest").agg(F.min("doc_id").alias("__class")).where(F.col("__class").isNotNull()), "classes")
    own = keyed.where(F.col("keys").isNotNull()).join(reps, "__digest").where(F.col("doc_id") == F.col("__class")).dropDuplicates(["doc_id"])
    rows = materialize(own.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key")), "bands")
    heads = rows.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("key", "head")
    active = materialize(rows.join(heads, "key"), "buckets")
    some = active.select(F.col("id").alias("doc_id")).distinct()
    side = F.broadcast(some) if some.count() * 16 <= BROADCAST_BYTES else some
    sets = materialize(map_columns(docs.join(side, "doc_id", "left_semi"), ["doc_id", "text"], _element_rows, "id long, size long, elements binary").dropDuplicates(["id"]), "shingles")
    pairs = active.where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    plain = sets.drop("size")
    stars = materialize(pairs.groupBy("a").count().where(F.col("count") > hot), "stars")
    both = join_hot(pairs, plain.withColumnsRenamed({"id": "a", "elements": "x"}), ["a"], stars).join(plain.withColumnsRenamed({"id": "b", "elements": "y"}), "b")
    tested = materialize(map_columns(both, ["a", "b", "x", "y"], functools.partial(_similar, similarity), "a long, b long, near boolean"), "tested")
    links = tested.where("near").select("a", "b")
    known = active.join(components(links).withColumnRenamed("component", "c"), "id", "left").select("key", "id", F.coalesce("c", "id").alias("component"))
    shares = known.groupBy("key", "component").count()
    per = shares.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("n")).where("n > 1")
    full = materialize(known.join(per.select("key", "main"), "key").join(sets.drop("elements"), "id").withColumn("class", size_class(F.col("size"), similarity)), "undecided")
    count = lambda df, name: df.groupBy("key", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    ask = full.where("component <> main").withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    parts = materialize(count(full, "blocks").join(count(ask, "asks"), ["key", "class"]), "blocks")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    items = full.join(parts, ["key", "class"]).withColumn("block", block("blocks")).withColumn("ask", every("asks")).join(sets.drop("size"), "id")
    queries = ask.join(parts, ["key", "class"]).withColumn("ask", block("asks")).withColumn("block", every("blocks")).join(sets.drop("size"), "id")
    items = items.select(*[F.col(c).alias(c) for c in items.columns])  # columns of its own, as a cogroup asks
    cell = ["key", "class", "block", "ask"]
    cross = queries.groupBy(*cell).cogroup(items.groupBy(*cell)).applyInPandas(functools.partial(_cross_links, similarity), "a long, b long")
    more = materialize(cross.distinct(), "cross-links")
    return keyed.select("doc_id", "__digest").join(reps, "__digest", "left"), links.unionByName(more)


def components(links: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, component): the least id reachable over links; ids without links are not in it. Ids with more than `hot` links are joined by broadcast."""
    both = materialize(links.union(links.select("b", "a")).toDF("u", "v").distinct(), "edges")
    centres = materialize(both.groupBy("v").count().where(F.col("count") > hot), "centres")
    state = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "labels")
    while True:
        heard = join_hot(both, state.withColumnsRenamed({"u": "v", "c": "near"}), ["v"], centres).groupBy("u").agg(F.min("near").alias("near"))
        nxt = state.join(heard, "u").select("u", F.least("c", "near").alias("c"), F.col("c").alias("was"))
        root = state.select(F.col("u").alias("c"), F.col("c").alias("up"))
        jumped = nxt.join(root, "c", "left").select("u", F.least("c", F.coalesce("up", "c")).alias("c"), "was")
        new = materialize(jumped, "labels")
        changed = not new.where("c <> was").isEmpty()
        state = new.select("u", "c")
        if not changed:
            return state.select(F.col("u").alias("id"), F.col("c").alias("component"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept for each row of docs: class_id is the least doc_id of its near-duplicate component.

    Equal texts are one class. Empty and blank texts have no shingles and link
    to equal texts only. kept marks rows whose doc_id is their class_id. Rows
    without doc_id get the class of equal texts, or null.
    """
    texts, links = verified_links(docs, similarity)
    label = components(links).withColumnsRenamed({"id": "__class"})
    out = texts.join(label, "__class", "left").select("doc_id", F.coalesce("component", "__class").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def keep_representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, that stand for their component; of repeated rows of one id, one. Rows without doc_id stay."""
    keep = near_duplicates(docs, similarity).where("kept").select(F.col("doc_id").alias("__keep")).distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    return named.join(keep, named["doc_id"] == keep["__keep"], "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull()))
