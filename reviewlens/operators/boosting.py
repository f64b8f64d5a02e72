"""Leaf-wise gradient boosting on quantile histograms.

Feature values become bin numbers once, by quantiles of the training rows. A tree grows best-first: of all leaves the
one whose best split gains most is split, until there are ``num_leaves`` leaves or no split gains anything. The best
split of a leaf follows from its gradient histogram, sums of gradient, hessian and rows by (leaf, feature, bin): tasks
make them from their own rows with bincounts, Spark adds them up, and the driver, which holds at most
``leaves x features x bins`` sums, finds the splits. (The binned rows are blocks of arrays, and the sums are arrays added up in two
levels by ``treeReduce``: a pass is one short job, and a fit has hundreds.) Of two siblings only the smaller one is counted; the other is the
parent less its sibling.

What a split of one leaf gains does not depend on the other leaves, so one pass over the rows serves every leaf that
could still be chosen: growing replays the best-first order over the splits known so far and asks for a pass only when
it comes to a leaf whose children are not counted yet. A pass also adds the trees that were finished since the raw
scores were last stored (every ``STORED`` trees), so nothing is written for a single tree.

Logistic loss: the score starts at the log-odds of the labels, a leaf's value is -rate * G / (H + l2), a split gains
GL^2/(HL + l2) + GR^2/(HR + l2) - G^2/(H + l2). Equal gains go to the lower feature, then the lower bin, then the older
leaf. A row goes left where its value is at most the threshold; NaN and null go right. Without a labelled row, or with
one label alone, no tree is grown.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import write_table

MAX_BIN = 255
#: Training rows of a task: a pass over few rows is one task without a shuffle.
ROWS_PER_TASK = 1 << 15
#: Trees after which the raw scores are stored anew.
STORED = 10
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, gain double, rows bigint"


@dataclass
class Tree:
    """Nodes in the order they were made; ``left`` is -1 at a leaf. ``bin`` or ``threshold``: the last that goes left."""
    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray


@dataclass
class LeafwiseModel:
    base: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels, probabilities) of rows of feature values."""
        raw = np.full(len(x), self.base)
        for tree in self.trees:
            raw += tree.value[_leaves(x, tree, tree.threshold)]
        p = _sigmoid(raw)
        return (p > 0.5).astype(np.int32), p

    def table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, left, right, value, gain, rows): a row for each node."""
        rows = [(i, j, int(t.feature[j]), float(t.threshold[j]), int(t.left[j]), int(t.right[j]), float(t.value[j]), float(t.gain[j]), int(t.rows[j]))
                for i, t in enumerate(self.trees) for j in range(len(t.left))]
        return spark.createDataFrame(rows, NODES)


def model_from(base: float, nodes: DataFrame) -> LeafwiseModel:
    """The model of a ``table``."""
    trees: dict[int, list] = {}
    for r in nodes.orderBy("tree", "node").toLocalIterator():
        trees.setdefault(r["tree"], []).append(r)
    column = lambda rows, name, kind: np.array([r[name] for r in rows], kind)
    return LeafwiseModel(base, [
        Tree(column(rows, "feature", np.int64), np.zeros(len(rows), np.int64), column(rows, "threshold", float), column(rows, "left", np.int64),
             column(rows, "right", np.int64), column(rows, "value", float), column(rows, "gain", float), column(rows, "rows", np.int64))
        for _, rows in sorted(trees.items())])


def _leaves(values: np.ndarray, tree: Tree, cut: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``values`` (rows x features), ``cut`` being the tree's bins or thresholds."""
    at = np.zeros(len(values), np.int64)
    rows = np.flatnonzero(tree.left[at] >= 0)
    while len(rows):
        node = at[rows]
        at[rows] = np.where(values[rows, tree.feature[node]] <= cut[node], tree.left[node], tree.right[node])
        rows = rows[tree.left[at[rows]] >= 0]
    return at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of equal lengths; null rows and values are NaN."""
    filled = column.fill_null([np.nan] * width) if column.null_count else column
    return filled.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def quantile_cuts(rows: DataFrame, features: str, width: int, max_bin: int = MAX_BIN) -> list[np.ndarray]:
    """Upper ends of each feature's bins but the last, ascending: values of the rows, at most ``max_bin - 1``."""
    values = rows.select(F.posexplode(features).alias("f", "v")).where("NOT isnan(v)")
    shares = f"array({', '.join(f'{i / max_bin!r}D' for i in range(1, max_bin))})"
    found = values.groupBy("f").agg(F.expr(f"percentile_approx(v, {shares}, {20 * max_bin})").alias("q"), F.max("v").alias("m")).collect()
    cuts = {r["f"]: np.array(sorted({x for x in r["q"] if x < r["m"]})) for r in found}
    return [cuts.get(i, np.zeros(0)) for i in range(width)]


BLOCK = "bins binary, y binary, raw binary"


def _binned(rows: DataFrame, features: str, label: str, cuts: list[np.ndarray], base: float) -> DataFrame:
    """Blocks of rows: a byte for each row and feature, labels, raw scores."""
    width = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), width)
            bins = np.empty(x.shape, np.uint8)
            for i, cut in enumerate(cuts):
                bins[:, i] = np.searchsorted(cut, x[:, i], "left")  # NaN sorts last
            if len(x):
                yield _block(bins, batch.column(1).to_numpy(), np.full(len(x), base))

    return rows.select(features, F.col(label).cast("double").alias("y")).mapInArrow(run, BLOCK)


def _block(bins: np.ndarray, y: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, y.astype("<f8"), raw)], ["bins", "y", "raw"])


def _arrays(row, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["bins"], np.uint8).reshape(-1, width), np.frombuffer(row["y"], "<f8"), np.frombuffer(row["raw"], "<f8")


def _raw(bins: np.ndarray, raw: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for tree in trees:
        raw = raw + tree.value[_leaves(bins, tree, tree.bin)]
    return raw


@dataclass
class _Node:
    """A node of the tree being grown: its sums by feature and bin, and its best split."""
    sums: np.ndarray
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: tuple[int, int] | None = None
    total: np.ndarray = field(default_factory=lambda: np.zeros(3))


class _Grower:
    def __init__(self, cuts: list[np.ndarray], rate: float, num_leaves: int, least_rows: int, least_hessian: float, l2: float):
        self.cuts, self.rate, self.num_leaves = cuts, rate, num_leaves
        self.least_rows, self.least_hessian, self.l2 = least_rows, least_hessian, l2
        self.width, self.bins = len(cuts), max((len(c) for c in cuts), default=0) + 1

    def node(self, sums: np.ndarray) -> _Node:
        total = sums[0].sum(axis=0)
        node, left = _Node(sums, total=total), np.cumsum(sums, axis=1)[:, :-1]
        right = total - left
        if not left.size:
            return node
        allowed = (left[..., 2] >= self.least_rows) & (right[..., 2] >= self.least_rows) & (left[..., 1] >= self.least_hessian) & (right[..., 1] >= self.least_hessian)
        part = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + self.l2, 1e-300)
        gain = np.where(allowed, part(left) + part(right) - part(total), -np.inf)
        best = int(np.argmax(gain))  # the first of equal gains
        if gain.flat[best] > 1e-12:
            node.gain, (node.feature, node.bin) = float(gain.flat[best]), map(int, divmod(best, gain.shape[1]))
        return node

    def replay(self, nodes: list[_Node]) -> tuple[list[int], list[tuple[int, int, int]], bool]:
        """(leaves, splits (node, left, right) in order, whether a leaf to split has no children yet)."""
        leaves, splits, heap = [0], [], [(-nodes[0].gain, 0)]
        while heap and len(leaves) < self.num_leaves:
            gain, at = heapq.heappop(heap)
            if not -gain > 0:
                break
            if nodes[at].children is None:
                return leaves, splits, True
            left, right = nodes[at].children
            leaves[leaves.index(at)] = left
            leaves.append(right)
            splits.append((at, left, right))
            for child in (left, right):
                heapq.heappush(heap, (-nodes[child].gain, child))
        return leaves, splits, False

    def wanted(self, nodes: list[_Node], leaves: list[int]) -> list[int]:
        """Nodes worth counting the children of: those without, below leaves to come too, that gain most, as many as
        splits are left. The leaf that the replay stopped at is one of them."""
        able = [at for at in range(len(nodes)) if nodes[at].children is None and nodes[at].gain > 0]
        first = max((at for at in leaves if nodes[at].children is None), key=lambda at: (nodes[at].gain, -at))
        best = sorted(able, key=lambda at: (-nodes[at].gain, at))[:self.num_leaves - len(leaves)]
        return best if first in best else [*best[:-1], first]

    def routing(self, nodes: list[_Node]) -> Tree:
        """All nodes known so far as a tree of bins."""
        n = len(nodes)
        left, right = (np.array([(node.children or (-1, -1))[i] for node in nodes]) for i in (0, 1))
        inner = left >= 0
        feature, bin_ = np.array([node.feature for node in nodes]), np.array([node.bin for node in nodes])
        zero = np.zeros(n)
        return Tree(np.where(inner, feature, 0), bin_, zero, left, right, zero, zero, zero)

    def tree(self, nodes: list[_Node], splits: list[tuple[int, int, int]]) -> Tree:
        """The chosen part of the nodes, numbered in the order they were made."""
        order = [0, *(child for _, *children in splits for child in children)]
        number, chosen = {at: i for i, at in enumerate(order)}, {at: (a, b) for at, a, b in splits}
        held = [nodes[at] for at in order]
        links = [chosen.get(at) for at in order]
        value = np.array([0.0 if c else -self.rate * n.total[0] / (n.total[1] + self.l2) for n, c in zip(held, links)])
        return Tree(
            np.array([n.feature if c else -1 for n, c in zip(held, links)]), np.array([n.bin if c else -1 for n, c in zip(held, links)]),
            np.array([self.cuts[n.feature][n.bin] if c else np.nan for n, c in zip(held, links)]),
            *(np.array([number[c[i]] if c else -1 for c in links]) for i in (0, 1)),
            value, np.array([n.gain if c else 0.0 for n, c in zip(held, links)]), np.array([int(n.total[2]) for n in held]))


def histograms(blocks: RDD, trees: list[Tree], routing: Tree, targets: list[int], width: int, bins: int) -> np.ndarray:
    """Sums (gradient, hessian, rows) of each target node by feature and bin, from one pass over the rows."""
    place = np.full(len(routing.left), -1)
    place[targets] = np.arange(len(targets))
    size = len(targets) * width * bins

    def partial(rows: Iterator) -> Iterator[np.ndarray]:
        sums = np.zeros((3, size))
        for b, y, raw in rows:
            target = place[_leaves(b, routing, routing.bin)]
            mine = np.flatnonzero(target >= 0)
            p = _sigmoid(_raw(b[mine], raw[mine], trees))
            cell = ((target[mine, None] * width + np.arange(width)) * bins + b[mine]).ravel()
            for k, weights in enumerate((np.repeat(p - y[mine], width), np.repeat(p * (1 - p), width), None)):
                sums[k] += np.bincount(cell, weights, size)
        yield sums

    whole = blocks.mapPartitions(partial).treeReduce(np.add)
    return whole.T.reshape(len(targets), width, bins, 3)


def _held(stored: DataFrame, tasks: int, width: int) -> RDD:
    """Stored blocks as arrays in at most so many partitions, kept by the executors; a lost one is read again."""
    return stored.coalesce(tasks).rdd.map(lambda row: _arrays(row, width)).persist(StorageLevel.MEMORY_AND_DISK)


def _grow(rows: RDD, trees: list[Tree], grower: _Grower) -> Tree | None:
    start = Tree(*(np.array([x]) for x in (0, -1, 0.0, -1, -1, 0.0, 0.0, 0)))
    nodes = [grower.node(histograms(rows, trees, start, [0], grower.width, grower.bins)[0])]
    while True:
        leaves, splits, blocked = grower.replay(nodes)
        if not blocked:
            return grower.tree(nodes, splits) if splits else None
        smaller: list[tuple[int, int, int]] = []  # the child to count, its sibling, their parent
        for at in grower.wanted(nodes, leaves):
            node, left = nodes[at], len(nodes)
            before = node.sums[node.feature, :node.bin + 1, 2].sum()
            node.children = (left, left + 1)
            nodes += [_Node(node.sums), _Node(node.sums)]
            smaller.append((left, left + 1, at) if 2 * before <= node.total[2] else (left + 1, left, at))
        counted = histograms(rows, trees, grower.routing(nodes), [s[0] for s in smaller], grower.width, grower.bins)
        for (child, sibling, parent), sums in zip(smaller, counted):
            nodes[child], nodes[sibling] = grower.node(sums), grower.node(nodes[parent].sums - sums)


def fit_leafwise(train: DataFrame, features: str = "svd", label: str = "score", trees: int = 100, num_leaves: int = 31, rate: float = 0.1,
                 least_rows: int = 20, least_hessian: float = 1e-3, l2: float = 0.0, max_bin: int = MAX_BIN, log=None) -> LeafwiseModel:
    """Boosted trees of the rows with a label of 0 or 1. ``features``: an array column, equally long in all rows."""
    spark = train.sparkSession
    data = train.where(F.col(label).isin(0, 1)).select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    seen = data.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.max(F.size("x")).alias("width")).first()
    if not seen["n"] or seen["ones"] in (0, seen["n"]):
        share = np.clip((seen["ones"] or 0) / seen["n"], 1e-15, 1 - 1e-15) if seen["n"] else 0.5
        return LeafwiseModel(float(np.log(share / (1 - share))), [])
    share = seen["ones"] / seen["n"]
    base = float(np.log(share / (1 - share)))
    data = data.where(F.col("x").isNotNull())
    cuts = quantile_cuts(data, "x", seen["width"], max_bin)
    tasks = -(-seen["n"] // ROWS_PER_TASK)
    grower = _Grower(cuts, rate, num_leaves, least_rows, least_hessian, l2)
    stored = write_table(_binned(data, "x", "y", cuts, base), "boosting-rows")
    rows = _held(stored, tasks, grower.width)
    done: list[Tree] = []
    pending: list[Tree] = []  # not yet in the stored raw scores
    for i in range(trees):
        tree = _grow(rows, pending, grower)
        if tree is None:
            break
        done.append(tree)
        pending.append(tree)
        if log:
            log(f"tree {i}: {int((tree.left < 0).sum())} leaves")
        if len(pending) == STORED:
            stored, pending = write_table(_with_raw(stored, pending, grower.width), "boosting-rows"), []
            rows.unpersist()
            rows = _held(stored, tasks, grower.width)
    rows.unpersist()
    return LeafwiseModel(base, done)


def _with_raw(stored: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bins, y, raw = _arrays(row, width)
                yield _block(bins, y, _raw(bins, raw, trees))

    return stored.mapInArrow(run, BLOCK)


def score_leafwise(df: DataFrame, model: LeafwiseModel, features: str = "svd", key: str = "doc_id", keep: list[str] | tuple = ()) -> DataFrame:
    """``(key, *keep, pred_gbt, prob_gbt)``: positive above one half. The trees travel with the task: their size is
    that of the model, trees x leaves."""
    columns = [key, *keep]
    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("pred_gbt", T.IntegerType()), T.StructField("prob_gbt", T.DoubleType())])
    width = int(max((t.feature.max() for t in model.trees), default=0)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, p = model.predict(_matrix(batch.column(len(columns)), width))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(label), pa.array(p)], schema.names)

    # values beyond the last feature a tree asks for are not sent
    sent = F.slice(F.col(features).cast("array<double>"), 1, width)
    return df.select(*columns, sent.alias("_gbt_x")).mapInArrow(run, schema)
