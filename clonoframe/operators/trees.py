"""Forests with out-of-bag error, and second-order boosting, grown from histograms.

Columns are cut into at most ``BINS`` quantile bins once. A pass over the rows then adds up, for
every open node of many trees, what its splits need: class counts for a forest, gradients and
curvatures for boosting. What reaches the driver is histograms, whose size depends on nodes,
columns and bins and not on rows; trees are grown in groups so that a pass adds at most
``CELLS`` numbers. A forest's nodes of few rows are grown in tasks and stay there.

Which rows and columns a tree sees is a hash of (row, tree) and (tree, node, column). So nothing
is stored per row and tree: a later pass replays the draw, which is what makes out-of-bag votes
and out-of-bag permutation importance plain passes, without windows or joins.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoframe.operators.passes import added
from clonoframe.session import cut_lineage, packed, partitions

BINS = 64
CELLS = 1 << 21
ROWS_PER_TASK = 20_000
FOREST_ROWS = 4_000  # rows a task of a forest's pass, which visits them once a tree
LOCAL = 1 << 15  # rows of a node whose subtree one task grows
VISITS_PER_TASK = 5_000_000
REFRESH = 10  # boosting rounds between rewrites of the rows' margins
_STEP = np.uint64(0x9E3779B97F4A7C15)


def draw(key: np.ndarray | int, *of: int | np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1), a function of the key and the given numbers (or arrays of them) alone."""
    x = np.asarray(key).astype(np.int64).view(np.uint64) if np.ndim(key) else np.array([key], np.uint64)
    with np.errstate(over="ignore"):
        for number in (*of, 0):
            x = (x + np.asarray(number + 1).astype(np.uint64)) * _STEP
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


#: Cumulative probabilities of how often a bootstrap draw takes a row (Poisson with mean 1).
_TIMES = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def times(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often the bootstrap sample of a tree holds each row; 0 is out of bag."""
    return np.searchsorted(_TIMES, draw(key, seed, tree), side="right")


class Taken:
    """How often a bootstrap sample holds the rows of groups of ``sizes`` rows that agree.

    That is the sum of as many draws of ``times``: Poisson with the size as mean, by its inverse.
    """

    def __init__(self, sizes: np.ndarray) -> None:
        each, self.table = np.unique(sizes, return_inverse=True)
        self.low, marks = np.zeros(len(each), np.int64), []
        for i, m in enumerate(each.tolist()):
            if m <= 1:
                marks.append(np.r_[_TIMES, 1.0] if m else np.ones(1))
                continue
            self.low[i] = max(0, math.floor(m - 12 * math.sqrt(m)))
            at = np.arange(self.low[i], math.ceil(m + 12 * math.sqrt(m)) + 20)
            first = at[0] * math.log(m) - m - math.lgamma(at[0] + 1)
            share = np.exp(first + np.r_[0, np.cumsum(math.log(m) - np.log(at[1:]))])
            marks.append(np.r_[np.minimum(np.cumsum(share), 1.0), 1.0])
        self.last = np.cumsum([len(m) for m in marks]) - 1
        self.start = np.r_[0, self.last[:-1] + 1]
        self.marks = np.concatenate([i + m for i, m in enumerate(marks)])

    def by(self, uniform: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.marks, self.table + uniform, side="right")
        return np.minimum(at, self.last[self.table]) - self.start[self.table] + self.low[self.table]


@dataclass
class Tree:
    """Nodes by number; rows with bin <= cut go to ``left``, others to the node after it."""

    feature: list[int] = field(default_factory=lambda: [-1])  # -1: leaf
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, values: tuple) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        self.feature += [-1, -1]
        self.cut += [0, 0]
        self.left += [0, 0]
        self.value += list(values)
        return at, at + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """Node each row ends in."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            inside = feature[node] >= 0
            if not inside.any():
                return node
            f = np.where(inside, feature[node], 0)
            right = bins[rows, f] > cut[node]
            node = np.where(inside, left[node] + right, node)


def binned(
    rows: DataFrame, p: int, columns: Sequence[str] = ("sample_id", "class", "label", "fold"),
    rows_per_task: int = ROWS_PER_TASK, numbered: bool = False,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (key, bins, given columns, ``row`` number if wanted) and the upper edges of the bins of each column."""
    x = rows.withColumn("x", vector_to_array("x"))
    marks = [(i + 1) / BINS for i in range(BINS - 1)]
    found = x.select(F.array(*[F.percentile_approx(F.col("x")[i], marks, 10_000) for i in range(p)]).alias("q")).first()["q"]
    edges = [np.unique(np.array(q if q is not None else [], float)) for q in found]
    kept = [c for c in columns if c in rows.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"])
            cells = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(p)], axis=1)
            out = batch[["key", *kept]].copy()
            out["bins"] = [r.tobytes() for r in cells.astype(np.uint8)]
            yield out

    slim = x.select(F.xxhash64("sample_id").alias("key"), *kept, "x")
    schema = slim.drop("x").withColumn("bins", F.lit(b"")).schema
    cells = slim.mapInPandas(run, schema)
    if numbered:
        cells = cells.withColumn("row", F.monotonically_increasing_id())
    return packed(cells, rows_per_task), edges


def _bins(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _columns(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class _Drawn:
    """A batch of a forest's rows, and what each tree learns from and judges."""

    def __init__(self, batch: pa.RecordBatch, seed: int, n_trees: int, n_folds: int) -> None:
        self.seed, self.n_trees, self.n_folds = seed, n_trees, n_folds
        self.bins, self.key, self.row = _bins(batch), _column(batch, "key"), _column(batch, "row")
        if n_folds:
            self.many, self.holds, self.fold = _columns(batch, "many"), _columns(batch, "holds"), -1
        else:
            self.label = _column(batch, "label")

    def learnt(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in the sample of a tree, with their labels and how often they are held."""
        if not self.n_folds:
            weight = times(self.key, self.seed, t)
            at = np.flatnonzero(weight)
            return at, self.label[at], weight[at]
        if self.fold != t // self.n_trees:
            self.fold = t // self.n_trees
            self.taken = Taken(self.many.sum(axis=1) - self.many[:, self.fold])
        weight = self.taken.by(draw(self.key, self.seed, t))[:, None] * self.holds
        at, label = np.nonzero(weight)
        return at, label, weight[at, label]

    def judged(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows a tree judges, their labels (with folds there are several) and the numbers of their votes."""
        if not self.n_folds:
            at = np.flatnonzero(times(self.key, self.seed, t) == 0)
            return at, self.label[at], self.row[at]
        fold = t // self.n_trees
        at = np.flatnonzero(self.many[:, fold])
        return at, np.zeros(len(at), np.int64), self.row[at] * self.n_folds + fold


# ---- forests ---------------------------------------------------------------------------


def _leaves(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, k: int, p: int, pick, min_node: int, depth: int, share: bool) -> tuple[Tree, np.ndarray]:
    """A Gini tree over rows held in memory, a level at a time, and the gain by column.

    ``pick(nodes)`` gives the columns each node may split on. Only cells that hold rows are looked
    at, so a level costs about rows x columns, however many nodes it has.
    """
    def said(counts: np.ndarray) -> list:
        return (counts / counts.sum(axis=1, keepdims=True)).tolist() if share else counts.argmax(axis=1).tolist()

    tree, gains = Tree(), np.zeros(p)
    total = np.stack([np.bincount(label[label == c], weight[label == c], k)[c : c + 1] for c in range(k)], axis=1)
    tree.value = said(total)
    node, open_ = np.zeros(len(bins), np.int64), np.array([0])
    if total.sum() <= min_node or (total > 0).sum() < 2:
        return tree, gains
    for _ in range(depth):
        slot = np.full(len(tree.feature), -1)
        slot[open_] = np.arange(len(open_))
        rows = np.flatnonzero(slot[node] >= 0)
        s, columns = slot[node[rows]], pick(open_)
        mtry = columns.shape[1]
        cell = ((s[:, None] * mtry + np.arange(mtry)) * BINS + bins[rows[:, None], columns[s]]).ravel()
        of, times_ = np.repeat(label[rows], mtry), np.repeat(weight[rows], mtry)
        size = len(open_) * mtry * BINS
        if size <= 16 * len(cell):
            sums = np.stack([np.bincount(cell[of == c], times_[of == c], size) for c in range(k)], axis=1)
            held = np.flatnonzero(sums.any(axis=1))
            sums = sums[held]
        else:
            held, at = np.unique(cell, return_inverse=True)
            sums = np.stack([np.bincount(at[of == c], times_[of == c], len(held)) for c in range(k)], axis=1)
        # counts up to a cell within its node and column
        upto, group = np.cumsum(sums, axis=0), held // BINS
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        last = np.r_[first[1:], len(held)] - 1
        before = np.r_[np.zeros((1, k)), upto[last[:-1]]]
        run = np.repeat(np.arange(len(first)), last - first + 1)
        left, whole = upto - before[run], (upto[last] - before)[run]
        right = whole - left
        n_left, n_right = left.sum(axis=1), right.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left**2).sum(axis=1) / n_left + (right**2).sum(axis=1) / n_right - (whole**2).sum(axis=1) / whole.sum(axis=1)
        gain = np.where(n_right > 0, gain, -1)
        owner = group // mtry
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.maximum.reduceat(gain, start)
        which = np.flatnonzero(gain == np.repeat(best, np.diff(np.r_[start, len(gain)])))
        which = which[np.r_[True, owner[which][1:] != owner[which][:-1]]]  # the first of equal ones
        which = which[gain[which] > 1e-9]
        if not len(which):
            break
        parents = open_[owner[which]]
        feature = columns[owner[which], group[which] % mtry]
        np.add.at(gains, feature, gain[which])
        at, count = len(tree.feature), len(which)
        sides = np.stack([left[which], right[which]], axis=1).reshape(2 * count, k)
        for v, f, c, child in zip(parents.tolist(), feature.tolist(), (held[which] % BINS).tolist(), range(at, at + 2 * count, 2), strict=True):
            tree.feature[v], tree.cut[v], tree.left[v] = f, c, child
        tree.feature += [-1] * (2 * count)
        tree.cut += [0] * (2 * count)
        tree.left += [0] * (2 * count)
        tree.value += said(sides)
        split, cut, child = np.full(at, -1), np.zeros(at, np.int64), np.zeros(at, np.int64)
        split[parents], cut[parents], child[parents] = feature, held[which] % BINS, np.arange(at, at + 2 * count, 2)
        moved = np.flatnonzero(split[node] >= 0)
        v = node[moved]
        node[moved] = child[v] + (bins[moved, split[v]] > cut[v])
        open_ = at + np.flatnonzero((sides.sum(axis=1) > min_node) & ((sides > 0).sum(axis=1) > 1))
        if not len(open_):
            break
    return tree, gains


_VISITS = "tree int, node int, part long, kind int, label binary, weight binary, bins binary, row binary, key binary"
_GROWN = "what int, tree int, node int, block long, low binary, say binary, body string, gains array<double>, fall array<double>"
_BLOCK = 12  # bits of a row number inside its block of votes


def _arrow(batch: dict, ddl: str) -> pa.RecordBatch:
    kinds = {
        "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(),
        "array<double>": pa.list_(pa.float64()),
    }
    fields = [field.split(" ") for field in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(batch[n], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


class Forest:
    """Gini trees on bootstrap samples, with their out-of-bag votes and importances.

    Nodes of more than ``LOCAL`` rows are split by passes over all rows. The rows of a smaller one
    meet in a task, packed by tree and node, and its subtree is grown there; the rows that are to
    be judged by it come along, so neither subtrees nor votes pass the driver, which holds about
    rows / ``LOCAL`` nodes a tree.

    With ``n_folds`` there is a forest for each fold, all abreast, that leaves the fold's rows out
    and judges them by the mean of the shares of classes in the leaves. Rows that agree in all bins are
    then one row: samples whose rows also agree in their labels are drawn by one number, how often
    they are held together. So the work follows the different rows of bins, not the samples.
    """

    def __init__(
        self, rows: DataFrame, p: int, n_classes: int, n_trees: int = 500, mtry: int | None = None,
        min_node: int = 1, max_depth: int = 30, seed: int = 42, n_folds: int = 0, local: int = LOCAL,
    ) -> None:
        """``rows``: those of ``prepare`` (sample_id, class, label, vector ``x``), with ``fold`` if there are folds."""
        self.p, self.k, self.seed, self.n_trees, self.n_folds = p, n_classes, seed, n_trees, n_folds
        self.mtry = mtry or max(1, int(math.sqrt(p)))
        self.min_node, self.max_depth, self.local = min_node, max_depth, local
        if "fold" not in rows.columns:
            rows = rows.withColumn("fold", F.lit(-1))
        self.rows, self.edges = binned(rows, p, rows_per_task=FOREST_ROWS if not n_folds else ROWS_PER_TASK, numbered=not n_folds)
        if n_folds:
            self.members = self.rows
            self.rows = packed(self._agreeing(self.members).withColumn("row", F.monotonically_increasing_id()), FOREST_ROWS)
        self.n = self.rows.count()
        self.tops = [Tree() for _ in range(n_trees * max(1, n_folds))]
        self.handed: list[dict[int, int]] = [{} for _ in self.tops]  # node: its depth
        self.gini = np.zeros((len(self.tops), p))
        self._grow()
        self._shares = self._margins() if not n_folds else None
        self.grown = cut_lineage(self._local(False))
        sums = self.grown.where("what = 0").groupBy("tree").agg(
            *[F.sum(F.col("gains")[j]).alias(f"g{j}") for j in range(p)],
            *[F.sum(F.col("fall")[j]).alias(f"f{j}") for j in range(p + 2)],
        ).toPandas().sort_values("tree")
        self._fall = np.zeros((len(self.tops), p + 2))
        at = sums["tree"].to_numpy(int)
        self.gini[at] += sums[[f"g{j}" for j in range(p)]].to_numpy(float)
        self._fall[at] = sums[[f"f{j}" for j in range(p + 2)]].to_numpy(float)

    def features(self, tree: int, node: int) -> np.ndarray:
        """Columns a node of the upper tree may split on."""
        return np.argsort(draw(np.arange(self.p), self.seed, tree, node), kind="stable")[: self.mtry]

    def _grow(self) -> None:
        """The upper part of every tree, down to nodes of at most ``local`` rows."""
        if self.n <= self.local:
            self.handed = [{0: 0} for _ in self.tops]
            return
        open_nodes = [(t, 0) for t in range(len(self.tops))]
        for depth in range(self.max_depth):
            size = self.mtry * BINS * self.k
            grown: list[tuple[int, int]] = []
            for a in range(0, len(open_nodes), max(1, CELLS // size)):
                part = open_nodes[a : a + max(1, CELLS // size)]
                for (t, node), counts in zip(part, self._counts(part), strict=True):
                    for child, weight in self._split(t, node, counts):
                        if weight <= self.local:
                            self.handed[t][child] = depth + 1
                        else:
                            grown.append((t, child))
            open_nodes = grown
            if not open_nodes:
                return

    def _agreeing(self, members: DataFrame) -> DataFrame:
        """(bins, holds, many, key): labels of a sample's rows, and the samples of each fold that have these bins and labels.

        The key is the least of the samples', so that a sample alone is drawn by its own.
        """
        label, fold, one = F.col("label").cast("int"), F.col("fold"), F.lit(1).cast("long")
        holds = F.array(*[F.count(F.when(label == c, one)) for c in range(self.k)])
        many = F.array(*[F.count(F.when(fold == f, one)) for f in range(self.n_folds)])
        samples = members.groupBy("key", "bins", "fold").agg(holds.alias("holds"))
        return samples.groupBy("bins", "holds").agg(many.alias("many"), F.min("key").alias("key"))

    def _counts(self, nodes: list[tuple[int, int]]) -> np.ndarray:
        """(nodes, mtry, bins, classes) counts of the rows each bootstrap sample holds.

        With folds a last class counts the rows that agree once.
        """
        by_tree: dict[int, list[tuple[int, int]]] = {}
        for slot, (t, node) in enumerate(nodes):
            by_tree.setdefault(t, []).append((slot, node))
        trees, mtry, folds = {t: self.tops[t] for t in by_tree}, self.mtry, bool(self.n_folds)
        k, drawn = self.k + folds, (self.seed, self.n_trees, self.n_folds)
        columns = np.stack([self.features(t, node) for t, node in nodes])

        def sums(batch: pa.RecordBatch) -> np.ndarray:
            held = _Drawn(batch, *drawn)
            size = mtry * BINS * k
            out = np.zeros(len(nodes) * size)
            for t, open_ in by_tree.items():
                (at, label, weight), leaf = held.learnt(t), trees[t].leaf_of(held.bins)
                slot = np.full(len(trees[t].feature), -1)
                for s, node in open_:
                    slot[node] = s
                inside = slot[leaf[at]] >= 0
                rows, label, weight = at[inside], label[inside], weight[inside]
                s, a = slot[leaf[rows]], open_[0][0]  # a tree's slots follow each other
                for j in range(mtry):
                    cell = (((s - a) * mtry + j) * BINS + held.bins[rows, columns[s, j]]) * k
                    part = np.bincount(cell + label, weight, len(open_) * size)
                    if folds:
                        part += np.bincount(cell + k - 1, minlength=len(open_) * size)
                    out[a * size : (a + len(open_)) * size] += part
            return out

        return added(self.rows, sums).reshape(len(nodes), mtry, BINS, k)

    def _said(self, counts: np.ndarray) -> int | list[float]:
        return (counts / counts.sum()).tolist() if self.n_folds else int(np.argmax(counts))

    def _split(self, t: int, node: int, counts: np.ndarray) -> list[tuple[int, float]]:
        """Split a node where Gini impurity falls most; its children that are to go on, and their rows."""
        rows, counts = counts.sum(axis=-1) if not self.n_folds else counts[..., -1], counts[..., : self.k]
        tree, total = self.tops[t], counts[0].sum(axis=0)
        n = total.sum()
        if node == 0:
            tree.value[0] = self._said(total) if n else 0 if not self.n_folds else [0.0] * self.k
        if n <= self.min_node or (total > 0).sum() < 2:
            return []
        left = np.cumsum(counts, axis=1)[:, :-1]
        right = total - left
        n_left, n_right = left.sum(axis=2), right.sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left**2).sum(axis=2) / n_left + (right**2).sum(axis=2) / n_right - (total**2).sum() / n
        gain = np.where((n_left > 0) & (n_right > 0), gain, -1)
        j, cut = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[j, cut] <= 1e-9:
            return []
        feature = int(self.features(t, node)[j])
        self.gini[t, feature] += gain[j, cut]
        sides = (left[j, cut], right[j, cut])
        children = tree.split(node, feature, int(cut), tuple(self._said(s) for s in sides))
        upto = rows[j, : cut + 1].sum()
        held = (upto, rows[j].sum() - upto)
        return [(c, h) for c, h, s in zip(children, held, sides, strict=True) if s.sum() > self.min_node and (s > 0).sum() > 1]

    def _margins(self) -> np.ndarray:
        """Cumulative distribution of each column's bins."""
        p = self.p

        def margin(batch: pa.RecordBatch) -> np.ndarray:
            bins = _bins(batch)
            return np.concatenate([np.bincount(bins[:, j], minlength=BINS) for j in range(p)])

        share = np.cumsum(added(self.rows, margin).reshape(p, BINS), axis=1)
        return share / share[:, -1:]

    def _visits(self) -> DataFrame:
        """The rows of each tree's lower nodes, packed by tree, node and batch.

        Kind 0 are rows a tree learns from, 1 those it judges, 2 + j those it judges with column j
        spoilt, where the upper tree splits on j. A final leaf of the upper tree only judges, so each
        batch makes a group of its own of it.
        """
        tops, handed, seed, share = self.tops, self.handed, self.seed, self._shares
        drawn, wide = (seed, self.n_trees, self.n_folds), np.uint32 if self.n_folds else np.uint8
        used = [sorted({f for f in tree.feature if f >= 0}) for tree in tops]
        empty = np.zeros(0, np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                part = _Drawn(batch, *drawn)
                bins, key = part.bins, part.key
                out: dict[str, list] = {field.split(" ")[0]: [] for field in _VISITS.split(", ")}
                held = 0

                def put(t: int, kind: int, rows: np.ndarray, label: np.ndarray, cells: np.ndarray, weight: np.ndarray, votes: np.ndarray) -> None:
                    if not len(rows):
                        return
                    leaf = tops[t].leaf_of(cells)
                    order = np.argsort(leaf, kind="stable")
                    at = np.flatnonzero(np.r_[True, np.diff(leaf[order]) != 0])
                    for a, b in zip(at, np.r_[at[1:], len(order)], strict=True):
                        node, some = int(leaf[order[a]]), order[a:b]
                        if kind == 0 and node not in handed[t]:
                            continue
                        line = (
                            t, node, 0 if node in handed[t] else int(part.row[0]) + 1, kind, label[some].astype(np.int16).tobytes(),
                            weight[some].astype(wide).tobytes(), cells[some].tobytes(),
                            (votes[some] if kind == 1 else empty).tobytes(),
                            (key[rows[some]] if kind == 1 and share is not None else empty).tobytes(),
                        )
                        for name, value in zip(out, line, strict=True):
                            out[name].append(value)

                for t in range(len(tops)):
                    inside, label, weight = part.learnt(t)
                    away, said, votes = part.judged(t)
                    none = np.zeros(len(away))
                    put(t, 0, inside, label, bins[inside], weight, empty)
                    put(t, 1, away, said, bins[away], none, votes)
                    if share is not None:
                        for j in used[t]:
                            put(t, 2 + j, away, said, _spoilt(bins[away], key[away], share, seed, t, j), none, votes)
                    held += len(inside) + len(away) * (1 + len(used[t]))
                    if held > 500_000:
                        yield _arrow(out, _VISITS)
                        out, held = {name: [] for name in out}, 0
                if out["tree"]:
                    yield _arrow(out, _VISITS)

        return self.rows.mapInArrow(run, _VISITS)

    def _local(self, subtrees: bool) -> DataFrame:
        """Grow the lower nodes: sums for importances and votes by block of rows, or only the subtrees."""
        tops, handed, seed, share, p, k, mtry = self.tops, self.handed, self.seed, self._shares, self.p, self.k, self.mtry
        min_node, max_depth, folds = self.min_node, self.max_depth, bool(self.n_folds)
        wide = np.uint32 if folds else np.uint8
        used = [{f for f in tree.feature if f >= 0} for tree in tops]

        def joined(table: pa.Table, kind: int, name: str, dtype: type) -> np.ndarray:
            return np.frombuffer(b"".join(v for v, q in zip(table[name].to_pylist(), kinds(table), strict=True) if q == kind), dtype)

        def kinds(table: pa.Table) -> list[int]:
            return table["kind"].to_pylist()

        def cells(table: pa.Table, kind: int) -> np.ndarray:
            return joined(table, kind, "bins", np.uint8).reshape(-1, p)

        def run(table: pa.Table) -> pa.Table:
            t, top = table["tree"][0].as_py(), table["node"][0].as_py()
            gains = np.zeros(p)
            if top in handed[t]:
                def pick(nodes: np.ndarray) -> np.ndarray:
                    of = (top, nodes[:, None]) if top else (nodes[:, None],)
                    return np.argsort(draw(np.arange(p)[None, :], seed, t, *of), axis=1, kind="stable")[:, :mtry]

                label = joined(table, 0, "label", np.int16).astype(np.int64)
                if len(label):
                    weight = joined(table, 0, "weight", wide).astype(float)
                    tree, gains = _leaves(cells(table, 0), label, weight, k, p, pick, min_node, max_depth - handed[t][top], folds)
                else:  # a tree whose sample is empty
                    tree = Tree(value=[[0.0] * k] if folds else [0])
            else:
                tree = Tree(value=[tops[t].value[top]])
            out: dict[str, list] = {field.split(" ")[0]: [] for field in _GROWN.split(", ")}

            def put(**line) -> None:
                for name in out:
                    out[name].append(line.get(name))

            if subtrees:
                put(what=0, tree=t, node=top, body=json.dumps([tree.feature, tree.cut, tree.left, tree.value]))
                return pa.Table.from_batches([_arrow(out, _GROWN)])
            bins, label, row = cells(table, 1), joined(table, 1, "label", np.int16), joined(table, 1, "row", np.int64)
            value, leaf = np.array(tree.value), tree.leaf_of(bins)
            fall = np.zeros(p + 2)
            if share is not None:
                key, own = joined(table, 1, "key", np.int64), {f for f in tree.feature if f >= 0}
                right = (value[leaf] == label).sum()
                fall[p], fall[p + 1] = len(label), right
                for j in range(p):
                    if j in used[t]:
                        said = value[tree.leaf_of(cells(table, 2 + j))]
                        fall[j] = (said == joined(table, 2 + j, "label", np.int16)).sum()
                    elif j in own:
                        fall[j] = (value[tree.leaf_of(_spoilt(bins, key, share, seed, t, j))] == label).sum()
                    else:
                        fall[j] = right
            put(what=0, tree=t, node=top, gains=gains.tolist(), fall=fall.tolist())
            say = (value if folds else np.eye(k)[value]).astype(np.float32)[leaf]
            order = np.argsort(row, kind="stable")
            block = row[order] >> _BLOCK
            at = np.flatnonzero(np.diff(block, prepend=-1) != 0)
            for a, b in zip(at, np.r_[at[1:], len(order)], strict=False):
                some = order[a:b]
                low = (row[some] & ((1 << _BLOCK) - 1)).astype(np.uint16)
                put(what=1, tree=t, block=int(block[a]), low=low.tobytes(), say=say[some].tobytes())
            return pa.Table.from_batches([_arrow(out, _GROWN)])

        spark = self.rows.sparkSession
        tasks = max(partitions(spark), spark.sparkContext.defaultParallelism, -(-self.n * len(tops) // VISITS_PER_TASK))
        by = ["tree", "node", "part"]
        return self._visits().repartition(tasks, *by).groupBy(*by).applyInArrow(run, _GROWN)

    def _judged(self) -> DataFrame:
        """The numbered rows with ``votes``: the sums of what the trees that judge a row say of it."""
        k = self.k

        def run(table: pa.Table) -> pa.Table:
            low = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint16).astype(np.int64)
            say = np.frombuffer(b"".join(table["say"].to_pylist()), np.float32).reshape(-1, k)
            votes = np.stack([np.bincount(low, say[:, c], 1 << _BLOCK) for c in range(k)], axis=1)
            rows = np.unique(low)
            first = table["block"][0].as_py() << _BLOCK
            return pa.table({"row": first + rows, "votes": pa.array(votes[rows].tolist(), pa.list_(pa.float64()))})

        blocks = self.grown.where("what = 1").select("block", "low", "say")
        votes = blocks.groupBy("block").applyInArrow(run, "row long, votes array<double>")
        none = F.array(*[F.lit(0.0)] * k)
        if not self.n_folds:
            return self.rows.join(votes, "row", "left").withColumn("votes", F.coalesce("votes", none))
        folds = F.explode(F.sequence(F.lit(0), F.lit(self.n_folds - 1)))
        asked = self.rows.select("bins", "row", folds.alias("fold"))
        found = asked.withColumn("row", F.col("row") * self.n_folds + F.col("fold")).join(votes, "row")
        # rows of bins that differ in their labels are judged alike
        said = found.groupBy("bins", "fold").agg(F.first("votes").alias("votes"))
        return self.members.join(said, ["bins", "fold"], "left").withColumn("votes", F.coalesce("votes", none))

    @property
    def trees(self) -> list[Tree]:
        """Whole trees, gathered: to look into forests of small tables; no query needs them."""
        whole = [Tree(list(t.feature), list(t.cut), list(t.left), list(t.value)) for t in self.tops]
        for r in self._local(True).collect():
            if r["node"] not in self.handed[r["tree"]]:
                continue
            tree, (feature, cut, left, value) = whole[r["tree"]], json.loads(r["body"])
            shift, top = len(tree.feature) - 1, r["node"]
            left = [v + shift for v in left]
            tree.feature[top], tree.cut[top], tree.left[top], tree.value[top] = feature[0], cut[0], left[0], value[0]
            tree.feature += feature[1:]
            tree.cut += cut[1:]
            tree.left += left[1:]
            tree.value += value[1:]
        return whole

    def out_of_bag(self) -> DataFrame:
        """(sample_id, class, label, votes, n_votes, prediction) by the trees that did not see a row.

        A row every tree saw has no votes and a null prediction.
        """
        own = [c for c in ("sample_id", "class", "label") if c in self.rows.columns]
        voted = self._judged().select(*own, F.col("votes").cast("array<bigint>").alias("votes"))
        n = F.aggregate("votes", F.lit(0).cast("long"), lambda a, x: a + x)
        first = F.array_position("votes", F.array_max("votes")) - 1
        return voted.withColumn("n_votes", n).withColumn("prediction", F.when(n > 0, first.cast("double")))

    def held_out(self) -> DataFrame:
        """(sample_id, class, label, prediction, score, fold) by the forest that left the fold out."""
        votes = self._judged()
        first = (F.array_position("votes", F.array_max("votes")) - 1).cast("double")
        score = F.col("votes")[1] / self.n_trees if self.k == 2 else F.lit(None).cast("double")
        return votes.select("sample_id", "class", "label", first.alias("prediction"), score.alias("score"), "fold")

    def importance(self, columns: Sequence[str]) -> DataFrame:
        """(feature, accuracy, scaled, gini): fall of out-of-bag accuracy without the column.

        A column is spoilt by drawing its bin anew from its own distribution, by a hash of row,
        tree and column; ``accuracy`` is the mean over trees, ``scaled`` in standard errors.
        """
        p, n = self.p, len(self.tops)
        each = (self._fall[:, p + 1 :] - self._fall[:, :p]) / np.maximum(self._fall[:, p : p + 1], 1)
        mean, error = each.mean(axis=0), each.std(axis=0, ddof=1) / math.sqrt(n)
        table = pd.DataFrame({
            "feature": list(columns), "accuracy": mean, "scaled": np.where(error > 0, mean / np.maximum(error, 1e-300), 0),
            "gini": self.gini.sum(axis=0) / n,
        })
        return self.rows.sparkSession.createDataFrame(table, "feature string, accuracy double, scaled double, gini double")

    def gain_shares(self, columns: Sequence[str]) -> DataFrame:
        """(feature, importance): mean over trees of each column's share of a tree's gain."""
        whole = self.gini.sum(axis=1, keepdims=True)
        share = (self.gini / np.where(whole > 0, whole, 1)).mean(axis=0)
        table = pd.DataFrame({"feature": list(columns), "importance": share / (share.sum() or 1)})
        return self.rows.sparkSession.createDataFrame(table, "feature string, importance double")


def _spoilt(bins: np.ndarray, key: np.ndarray, share: np.ndarray, seed: int, t: int, j: int) -> np.ndarray:
    """The bins with column j drawn anew from its own distribution."""
    out = bins.copy()
    out[:, j] = np.searchsorted(share[j], draw(key, seed, t, j + 1, 7), side="right") if len(key) else 0
    return out


def out_of_bag_error(votes: DataFrame) -> DataFrame:
    """(n, n_voted, error) of out-of-bag votes."""
    wrong = (F.col("prediction") != F.col("label")).cast("double")
    return votes.agg(F.count("*").alias("n"), F.count("prediction").alias("n_voted"), F.avg(wrong).alias("error"))


# ---- boosting --------------------------------------------------------------------------


class Boosted:
    """Second-order boosting with the logistic or softmax loss, all folds abreast.

    Model 0 learns from all rows, model f + 1 from those outside fold f. Each round adds one tree
    per class (one in all for two classes) of depth ``max_depth``, on a hashed share of the rows
    and columns; leaf weights are -G / (H + l2) times eta.
    """

    def __init__(
        self, rows: DataFrame, p: int, n_classes: int, n_folds: int = 0, n_rounds: int = 100,
        max_depth: int = 4, eta: float = 0.1, subsample: float = 0.8, colsample: float = 0.8,
        l2: float = 1.0, min_weight: float = 1.0, seed: int = 42,
    ) -> None:
        self.p, self.k = p, 1 if n_classes == 2 else n_classes
        self.models, self.depth, self.eta, self.l2 = n_folds + 1, max_depth, eta, l2
        self.subsample, self.min_weight, self.seed = subsample, min_weight, seed
        self.n_columns = max(1, round(colsample * p))
        if "fold" not in rows.columns:
            rows = rows.withColumn("fold", F.lit(0))
        self.rows, self.edges = binned(rows, p)
        zero = [0.0] * (self.models * self.k)
        self.rows = self.rows.withColumn("margin", F.array(*[F.lit(z) for z in zero]))
        self.trees: list[list[Tree]] = []  # per round, models x classes
        self.gain = np.zeros((self.models, p))
        self.losses: list[tuple] = []
        self.pending: list[list[Tree]] = []  # rounds the rows' margins do not hold yet
        for number in range(n_rounds):
            self._round(number)
            if len(self.pending) == REFRESH:
                self._refresh()
        self._refresh()
        self._note(n_rounds, self._sums([], 0, None)[1])

    def _margin(self, batch: pa.RecordBatch, bins: np.ndarray, pending: list[list[Tree]]) -> np.ndarray:
        held = batch.column("margin").flatten().to_numpy(zero_copy_only=False)
        out = held.reshape(batch.num_rows, -1).copy()
        for trees in pending:
            for i, tree in enumerate(trees):
                out[:, i] += np.array(tree.value, float)[tree.leaf_of(bins)]
        return out.reshape(batch.num_rows, self.models, self.k)

    def _refresh(self) -> None:
        if not self.pending:
            return
        pending, margin, names = self.pending, self._margin, self.rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    new = margin(batch, _bins(batch), pending).reshape(batch.num_rows, -1)
                    at = names.index("margin")
                    yield batch.set_column(at, "margin", pa.array(new.tolist(), pa.list_(pa.float64())))

        # only plain values travel with the function
        bare = object.__new__(Boosted)
        bare.models, bare.k = self.models, self.k
        margin = bare._margin
        self.rows, self.pending = cut_lineage(self.rows.mapInArrow(run, self.rows.schema)), []

    def _sums(self, trees: list[Tree], level: int, columns: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and curvatures by (model, class, open node, column, bin); losses by model."""
        m, k, p, seed, share = self.models, self.k, self.p, self.seed, self.subsample
        pending, number = self.pending, len(self.trees)
        bare = object.__new__(Boosted)
        bare.models, bare.k = m, k
        nodes = 1 << level
        slots = [{n: i for i, n in enumerate(o)} for o in self._open] if trees else []

        def sums(batch: pa.RecordBatch) -> np.ndarray:
            bins, label, key, fold = _bins(batch), _column(batch, "label"), _column(batch, "key"), _column(batch, "fold")
            margin = bare._margin(batch, bins, pending)
            train = fold[:, None] != np.arange(-1, m - 1)[None, :]
            if k == 1:
                probability = 1 / (1 + np.exp(-margin))
                target = (label == 1)[:, None, None]
                loss = np.logaddexp(0, margin[:, :, 0]) - label[:, None] * margin[:, :, 0]
                wrong = (margin[:, :, 0] > 0) != (label[:, None] == 1)
                curve = probability * (1 - probability)
            else:
                e = np.exp(margin - margin.max(axis=2, keepdims=True))
                probability = e / e.sum(axis=2, keepdims=True)
                target = label[:, None, None] == np.arange(k)
                loss = -np.log(np.maximum(np.take_along_axis(probability, label[:, None, None], 2)[:, :, 0], 1e-300))
                wrong = margin.argmax(axis=2) != label[:, None]
                curve = 2 * probability * (1 - probability)
            head = np.concatenate([
                train.sum(axis=0), (loss * train).sum(axis=0), (~train).sum(axis=0),
                (loss * ~train).sum(axis=0), (wrong & ~train).sum(axis=0),
            ])
            if not trees:
                return head
            pull = probability - target
            body = np.zeros((m * k, 2, nodes * p * BINS))
            for i, tree in enumerate(trees):
                model, c = divmod(i, k)
                leaf = tree.leaf_of(bins)
                slot = np.full(len(tree.feature), -1)
                for n, s in slots[i].items():
                    slot[n] = s
                seen = train[:, model] & (draw(key, seed, number, model, 3) < share) & (slot[leaf] >= 0)
                r = np.flatnonzero(seen)
                f = columns[i]
                cell = (slot[leaf[r]][:, None] * p + f[None, :]) * BINS + bins[r][:, f]
                for j, v in enumerate((pull[r, model, c], curve[r, model, c])):
                    body[i, j] = np.bincount(cell.ravel(), np.repeat(v, len(f)), minlength=nodes * p * BINS)
            return np.concatenate([head, body.ravel()])

        flat = added(self.rows, sums)
        head, body = flat[: 5 * m].reshape(5, m), flat[5 * m :]
        return body.reshape(len(trees), 2, nodes, p, BINS) if trees else body, head

    def _note(self, number: int, head: np.ndarray) -> None:
        n, loss, held, held_loss, wrong = head
        for model in range(self.models):
            out = held[model] or math.nan
            self.losses.append((number, model - 1, loss[model] / n[model], held_loss[model] / out, wrong[model] / out))

    def _round(self, number: int) -> None:
        trees = [Tree() for _ in range(self.models * self.k)]
        columns = [
            np.sort(np.argsort(draw(np.arange(self.p), self.seed, number, i, 5), kind="stable")[: self.n_columns])
            for i in range(len(trees))
        ]
        self._open = [[0] for _ in trees]
        for level in range(self.depth):
            body, head = self._sums(trees, level, columns)
            if level == 0:
                self._note(number, head)
            grown: list[list[int]] = []
            for i, tree in enumerate(trees):
                grown.append([])
                for s, node in enumerate(self._open[i]):
                    grown[i] += self._split(tree, node, body[i, :, s][:, columns[i]], columns[i], i // self.k)
            self._open = grown
            if not any(grown):
                break
        self.trees.append(trees)
        self.pending.append(trees)

    def _leaf(self, g: float, h: float) -> float:
        return -g / (h + self.l2) * self.eta

    def _split(self, tree: Tree, node: int, sums: np.ndarray, columns: np.ndarray, model: int) -> list[int]:
        g, h = sums[0], sums[1]
        all_g, all_h = g[0].sum(), h[0].sum()
        if node == 0:
            tree.value[0] = self._leaf(all_g, all_h)
        left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + self.l2) + right_g**2 / (right_h + self.l2) - all_g**2 / (all_h + self.l2)
        gain = np.where((left_h >= self.min_weight) & (right_h >= self.min_weight), gain / 2, -1)
        j, cut = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[j, cut] <= 1e-9:
            return []
        self.gain[model, columns[j]] += gain[j, cut]
        values = (self._leaf(left_g[j, cut], left_h[j, cut]), self._leaf(right_g[j, cut], right_h[j, cut]))
        return list(tree.split(node, int(columns[j]), int(cut), values))

    def curve(self) -> DataFrame:
        """(round, fold, train_loss, held_loss, held_error) before each round and after the last; fold -1 is all rows."""
        table = pd.DataFrame(self.losses, columns=["round", "fold", "train_loss", "held_loss", "held_error"])
        table = table.astype(object).where(table.notna(), None)
        return self.rows.sparkSession.createDataFrame(table, "round int, fold int, train_loss double, held_loss double, held_error double")

    def predictions(self, held_out: bool = True) -> DataFrame:
        """(sample_id, class, label, fold, prediction, score): by the model that did not see the fold."""
        model = F.when(F.lit(held_out), F.col("fold") + 1).otherwise(0).cast("int")
        own = F.slice("margin", model * self.k + 1, F.lit(self.k))
        if self.k == 1:
            score = 1 / (1 + F.exp(-own[0]))
            prediction = (own[0] > 0).cast("double")
        else:
            score = F.lit(None).cast("double")
            prediction = (F.array_position(own, F.array_max(own)) - 1).cast("double")
        return self.rows.select("sample_id", "class", "label", "fold", prediction.alias("prediction"), score.alias("score"))

    def importance(self, columns: Sequence[str]) -> DataFrame:
        """(feature, importance): share of the gain of all splits of the model of all rows."""
        gain = self.gain[0] / (self.gain[0].sum() or 1)
        table = pd.DataFrame({"feature": list(columns), "importance": gain})
        return self.rows.sparkSession.createDataFrame(table, "feature string, importance double")
