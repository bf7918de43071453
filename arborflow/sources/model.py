"""Models as Parquet nodes and JSON settings; predictions and metric logs."""

from __future__ import annotations

import dataclasses
import functools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arborflow.params import Params
from arborflow.plans.trainer import Forest
from arborflow.plans.tree import Node, Tree
from arborflow.workers import ensure_importable

NODES = "round int, k int, nid int, g long, h long, n long, weight double, gain double, fid int, bid int, cut double, default_right boolean, is_leaf boolean, is_pruned boolean, passes boolean"


def forest_frame(spark: SparkSession, forest: Forest) -> DataFrame:
    """A row for each node."""
    rows = [(r, k, *dataclasses.astuple(x)) for r, trees in enumerate(forest.trees) for k, t in enumerate(trees) for x in t.nodes.values()]
    names = [f.name for f in dataclasses.fields(Node)]
    order = [c.split()[0] for c in NODES.split(", ")]
    return spark.createDataFrame([tuple(dict(zip(["round", "k", *names], row))[c] for c in order) for row in rows], NODES)


def save_model(spark: SparkSession, forest: Forest, path: str) -> None:
    forest_frame(spark, forest).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = json.dumps({"params": dataclasses.asdict(forest.params), "n_features": forest.n_features, "cuts": forest.cuts, "widths": forest.widths})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> Forest:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    params = Params(**meta["params"])
    trees: dict[tuple[int, int], Tree] = {}
    for r in spark.read.parquet(f"{path}/nodes").collect():  # a model is small by its depth and rounds
        tree = trees.setdefault((r["round"], r.k), Tree(0, 0, params.reg_lambda))
        tree.nodes[r.nid] = Node(**{f.name: r[f.name] for f in dataclasses.fields(Node) if f.name in r})
    rounds = max((k[0] for k in trees), default=-1) + 1
    return Forest(params, [[trees[r, k] for k in range(params.classes)] for r in range(rounds)], meta["n_features"], meta["cuts"], widths=meta.get("widths"))


# models in the binary form of a C++ struct a node

#: The fields before a node's gradient sums, as a C++ compiler lays them out; r stands for the real type. What follows differs by build.
RECORD = [("place", "i4"), ("left", "i4"), ("right", "i4"), ("parent", "i4"), ("gain", "r"), ("weight", "r"), ("fid", "i4"), ("pid", "i4"), ("cut", "r"), ("bid", "u1"), ("default_right", "u1"), ("is_leaf", "u1"), ("is_valid", "u1"), ("is_pruned", "u1")]
BINARY_NODES = "objective string, learning_rate double, num_class int, bagging boolean, round int, k int, place int, left int, right int, weight double, gain double, fid int, bid int, cut double, default_right boolean, is_leaf boolean"


def record_type(real: str, size: int) -> np.dtype:
    """The record of `size` bytes with reals of type real, each field at a multiple of its own size."""
    names, kinds, offsets, at = [], [], [], 0
    for name, kind in RECORD:
        kind = np.dtype("<" + kind.replace("r", real))
        at = -(-at // kind.itemsize) * kind.itemsize
        names.append(name)
        kinds.append(kind)
        offsets.append(at)
        at += kind.itemsize
    return np.dtype({"names": names, "formats": kinds, "offsets": offsets, "itemsize": size})


def _is_tree(nodes: np.ndarray) -> bool:
    """Whether the links from the first node reach each of some nodes once, with flags of 0 and 1 and finite numbers."""
    seen, todo = set(), [0]
    while todo:
        at = todo.pop()
        if at in seen or not 0 <= at < len(nodes):
            return False
        seen.add(at)
        x = nodes[at]
        if x["is_leaf"] > 1 or x["default_right"] > 1 or not (np.isfinite(x["weight"]) and np.isfinite(x["cut"])):
            return False
        if not x["is_leaf"]:
            if x["fid"] < 0:
                return False
            todo += [int(x["left"]), int(x["right"])]
    return True


def _trees(data: bytes, start: int, rounds: int, kind: np.dtype) -> list[tuple[int, int, np.ndarray]] | None:
    """(round, class, nodes) if records of this type fill the data to its end, else None."""
    out, at = [], start
    for r in range(rounds):
        if at + 4 > len(data):
            return None
        (trees,) = struct.unpack_from("<i", data, at)
        at += 4
        for k in range(trees):
            if at + 8 > len(data):
                return None
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            if n < 1 or at + n * kind.itemsize > len(data):
                return None
            nodes = np.frombuffer(data, kind, n, at)
            if not _is_tree(nodes):
                return None
            out.append((r, k, nodes))
            at += n * kind.itemsize
    return out if at == len(data) else None


def decode_binary(data: bytes) -> list[tuple]:
    """Rows of BINARY_NODES. The record's size, which hangs on the build, and the width of reals are those that fill the file exactly."""
    (n,) = struct.unpack_from("<i", data, 0)
    objective = data[4 : 4 + n].decode()
    rate, classes, _, bagging, rounds = struct.unpack_from("<fii?i", data, 4 + n)
    start = 4 + n + struct.calcsize("<fii?i")
    for real, align in (("f4", 4), ("f8", 8)):
        least = record_type(real, 1 << 10)
        for size in range(-(-(least.fields["is_pruned"][1] + 1) // align) * align, 513, 4):
            trees = _trees(data, start, rounds, record_type(real, size))
            if trees is not None:
                return [(objective, rate, classes, bagging, r, k, i, int(x["left"]), int(x["right"]), float(x["weight"]), float(x["gain"]), int(x["fid"]), int(x["bid"]), float(x["cut"]), bool(x["default_right"]), bool(x["is_leaf"])) for r, k, nodes in trees for i, x in enumerate(nodes)]
    raise ValueError("no record size fills the file")


def _decoded(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0).to_pylist():
            columns = zip(*decode_binary(content))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def binary_nodes(spark: SparkSession, path: str) -> DataFrame:
    """BINARY_NODES of a model file that holds a C++ struct a node."""
    ensure_importable(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(functools.partial(_decoded, to_arrow_schema(T._parse_datatype_string(BINARY_NODES))), BINARY_NODES)


def import_model(spark: SparkSession, path: str) -> Forest:
    """A forest from such a file. Nodes get their place in the heap from the links; what pruning left behind is not reached."""
    rows = binary_nodes(spark, path).collect()  # a model is small by its depth and rounds
    if not rows:
        raise ValueError(f"{path} holds no trees")
    found: dict[tuple[int, int], dict[int, Row]] = {}
    for r in rows:
        found.setdefault((r["round"], r.k), {})[r.place] = r
    head, trees = rows[0], {}
    for key, nodes in found.items():
        tree, todo = Tree(0, 0, 1.0), [(0, 0)]
        while todo:
            nid, place = todo.pop()
            x = nodes[place]
            tree.nodes[nid] = Node(nid, 0, 0, 0, x.weight, x.gain, -1 if x.is_leaf else x.fid, -1 if x.is_leaf else x.bid, x.cut, x.default_right, x.is_leaf)
            todo += [] if x.is_leaf else [(2 * nid + 1, x.left), (2 * nid + 2, x.right)]
        trees[key] = tree
    rounds, classes = max(r for r, _ in trees) + 1, max(k for _, k in trees) + 1
    width = 1 + max((x.fid for t in trees.values() for x in t.nodes.values()), default=-1)
    params = Params(mode="centralized", objective=head.objective, learning_rate=head.learning_rate, num_class=head.num_class if head.objective.startswith("multi:") else 1, n_trees=rounds, bagging=head.bagging)
    return Forest(params, [[trees[r, k] for k in range(classes)] for r in range(rounds)], width)


def write_predictions(predictions: DataFrame, path: str, column: str = "prediction") -> None:
    """One value a line, in order of row_id within each file."""
    value = F.to_json(column) if predictions.schema[column].dataType.typeName() == "array" else F.col(column).cast("string")
    predictions.repartitionByRange("row_id").sortWithinPartitions("row_id").select(value.alias("value")).write.mode("overwrite").text(path)


def metric_log(spark: SparkSession, forest: Forest | list[Forest]) -> DataFrame:
    """(party_id, round, score) of a watched training; party_id is null unless parties trained forests of their own."""
    rows = [(k, r, s) for k, f in enumerate(forest) for r, s in enumerate(f.scores)] if isinstance(forest, list) else [(None, r, s) for r, s in enumerate(forest.scores)]
    return spark.createDataFrame(rows, "party_id int, round int, score double")
