"""Tree ensembles as small node tables, and exact Shapley values of their predictions.

A node table holds, per node, the column it asks (or none), the threshold (up to it goes left), its children, the value
of a leaf and the cover, the weight of training rows that reached it. Tables are as large as the model and go to the
tasks; rows pass through numpy in one Arrow pass without a shuffle.

Shapley values are path-dependent: where a column is not known, both children count by their cover. For a leaf with d
columns on its path, o (whether the row goes its way at all nodes of a column) and z (the product of the cover shares
there) give the share of each column as a sum over subset sizes, by the coefficients of the product of z + o t over the
other columns. A leaf has at most 2^d patterns of o, so its values are tabled once. What a row adds for all leaves of a small
subtree depends on its pattern above it and on the ways it goes at the subtree's nodes, so their tables are added up to one, and
a row costs a lookup for each column of each such subtree. Means over rows are summed in the tasks, which send a row a group.
"""

from __future__ import annotations

import math
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Tree:
        """rows of (feature, threshold, left, right, value, cover), the root first."""
        f, t, a, b, v, c = zip(*rows, strict=True)
        return cls(np.array(f, np.int64), np.array(t, float), np.array(a, np.int64), np.array(b, np.int64), np.array(v, float), np.array(c, float))

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of x reaches."""
        at, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:  # a node's rows are parted by one column, which lies together in blocks
            node, on = todo.pop()
            f = int(self.feature[node])
            if f < 0:
                at[on] = node
            elif len(on):
                left = x[:, f][on] <= self.threshold[node]
                todo += [(int(self.left[node]), on[left]), (int(self.right[node]), on[~left])]
        return at

    def paths(self) -> Iterator[tuple[float, list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """Of every leaf: value, columns on its path, the open-closed interval that each must lie in, and cover shares."""
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            node, seen = todo.pop()
            f = int(self.feature[node])
            if f < 0:
                low, high, z = (np.array([s[k] for s in seen.values()], float) for k in range(3))
                yield float(self.value[node]), list(seen), low, high, z
                continue
            low, high, z = seen.get(f, (-math.inf, math.inf, 1.0))
            cut = float(self.threshold[node])
            for child, a, b in ((int(self.left[node]), low, min(high, cut)), (int(self.right[node]), max(low, cut), high)):
                share = float(self.cover[child] / self.cover[node]) if self.cover[node] else 0.0
                todo.append((child, seen | {f: (a, b, z * share)}))

    def leaves(self) -> Iterator[tuple[int, Leaf]]:
        """The leaves by node, as paths() gives them."""
        todo, found = [0], self.paths()
        while todo:
            node = todo.pop()
            if self.feature[node] < 0:
                yield node, Leaf(*next(found))
            else:
                todo += [int(self.left[node]), int(self.right[node])]

    def codes(self, columns: np.ndarray, wanted: Container[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(wanted node, the number of every row's pattern): bit k says whether the row goes the node's way at all nodes of the
        path's k-th column. columns[column, row]; each node is asked once for all that lie below it."""
        todo: list[tuple[int, dict[int, int], np.ndarray]] = [(0, {}, np.zeros(columns.shape[1], np.int64))]
        while todo:
            node, seen, code = todo.pop()
            f = int(self.feature[node])
            if node in wanted:
                yield node, code
            if node in wanted or f < 0:
                continue
            k = seen.get(f, len(seen))
            left = (columns[f] <= self.threshold[node]).astype(np.int64) << min(k, BITS)
            right = left ^ (1 << min(k, BITS))
            for child, goes, not_so in ((int(self.left[node]), left, right), (int(self.right[node]), right, left)):
                todo.append((child, seen | {f: k}, code & ~not_so if f in seen else code | goes))

    def inner(self, node: int) -> list[int]:
        """The nodes from this one down that ask a column."""
        if self.feature[node] < 0:
            return []
        return [node, *self.inner(int(self.left[node])), *self.inner(int(self.right[node]))]

    def mean(self) -> float:
        """The prediction where no column is known."""
        return sum(v * float(np.prod(z)) for v, _, _, _, z in self.paths())


def predicted(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for t in trees:
        out += t.value[t.leaves_of(x)]
    return out


def from_spark(model) -> list[Tree]:
    """Node tables of a fitted forest or boosted trees of Spark; a tree's weight is in its values."""
    weights = list(model.treeWeights) if "GBT" in type(model).__name__ else [1 / model.getNumTrees] * model.getNumTrees
    out = []
    for tree, weight in zip(model.trees, weights, strict=True):
        rows: list[list] = []

        def walk(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, 0, 0, 0.0, float(node.impurityStats().count())])  # noqa: B023
            if node.getClass().getSimpleName() == "LeafNode":
                rows[at][4] = weight * node.prediction()  # noqa: B023
            else:
                rows[at][0], rows[at][1] = node.split().featureIndex(), node.split().threshold()  # noqa: B023
                rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())  # noqa: B023
            return at

        walk(tree._java_obj.rootNode())
        out.append(Tree.of([tuple(r) for r in rows]))
    return out


def sizes(o: np.ndarray, z: np.ndarray, without: tuple[int, ...]) -> np.ndarray:
    """Coefficients of the product of z + o t over the columns that are not left out, one row a pattern."""
    c = np.zeros((len(o), len(z) + 1))
    c[:, 0] = 1
    for j in range(len(z)):
        if j not in without:
            c[:, 1:] = c[:, 1:] * z[j] + c[:, :-1] * o[:, j : j + 1]
            c[:, 0] *= z[j]
    return c


def patterns(x: np.ndarray, on: list[int], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of o, and which of them each row of x has."""
    if len(x) == 0:
        return np.zeros((0, len(on))), np.zeros(0, np.int64)
    own = x[:, on]
    distinct, which = np.unique((own > low) & (own <= high), axis=0, return_inverse=True)
    return distinct.astype(float), which.reshape(-1)


#: Columns on the path to a subtree and nodes in it up to which its values are tabled, and bits of a pattern's number.
TABLED, BITS = 10, 62


@dataclass
class Leaf:
    value: float
    on: list[int]
    low: np.ndarray
    high: np.ndarray
    z: np.ndarray

    def alone(self, o: np.ndarray) -> np.ndarray:
        """[column on the path, pattern]: Shapley values."""
        d = len(self.on)
        weight = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
        return np.array([self.value * (o[:, i] - self.z[i]) * (sizes(o, self.z, (i,))[:, :d] @ weight) for i in range(d)]).reshape(d, len(o))

    def joint(self, o: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
        """[pair of places on the path, pattern]: half of the pair's joint effect."""
        d = len(self.on)
        weight = np.array([math.factorial(s) * math.factorial(d - s - 2) / (2 * math.factorial(d - 1)) for s in range(d - 1)])
        return np.array([self.value * (o[:, i] - self.z[i]) * (o[:, j] - self.z[j]) * (sizes(o, self.z, (i, j))[:, : d - 1] @ weight) for i, j in pairs]).reshape(len(pairs), len(o))


def unpacked(codes: np.ndarray, d: int) -> np.ndarray:
    """Patterns as rows of 0 and 1, of their numbers."""
    return ((codes[:, None] >> np.arange(d)) & 1).astype(float)


class Explainer:
    """Sums over the leaves of all trees of what make(leaf, patterns) gives for the slots that put(leaf) names. A leaf's
    values depend on the row by its pattern only, so they are made once for all patterns, added up over the leaves of each
    largest subtree whose patterns are few, and looked up by row."""

    def __init__(self, trees: list[Tree], slots: int, put, make):
        self.slots, self.make, self.trees = slots, make, []
        for t in trees:
            leaves = {node: (leaf, to) for node, leaf in t.leaves() if (to := put(leaf))}
            tables, alone, todo = {}, {}, [(0, [])]
            while todo:
                node, on = todo.pop()
                inner = t.inner(node)
                if len(on) + len(inner) <= TABLED:
                    table = self.table(t, leaves, node, on, inner)
                    if table:
                        tables[node] = (len(on), inner, table)
                elif not inner:
                    if node in leaves:
                        alone[node] = leaves[node]
                else:
                    f = int(t.feature[node])
                    below = on if f in on else [*on, f]
                    todo += [(int(t.left[node]), below), (int(t.right[node]), below)]
            self.trees.append((t, tables, alone, tables.keys() | alone.keys()))

    def table(self, t: Tree, leaves: dict, root: int, on: list[int], inner: list[int]) -> dict[int, np.ndarray]:
        """By slot, what the leaves below root give in all, for each pattern of the columns on above it and, in the bits after
        them, for each way (1: left) at the inner nodes."""
        if not inner:
            leaf, to = leaves.get(root, (None, []))
            return dict(zip(to, self.make(leaf, unpacked(np.arange(1 << len(on)), len(on))), strict=True)) if to else {}
        codes, found = np.arange(1 << len(on) + len(inner)), {}
        bit = lambda k: (codes >> k & 1).astype(bool)
        todo = [(root, {f: bit(k) for k, f in enumerate(on)})]
        while todo:
            node, goes = todo.pop()
            f = int(t.feature[node])
            if f >= 0:
                left = bit(len(on) + inner.index(node))
                todo += [(int(child), goes | {f: goes[f] & way if f in goes else way}) for child, way in ((t.left[node], left), (t.right[node], ~left))]
            elif node in leaves:
                leaf, to = leaves[node]
                code = sum((goes[c].astype(np.int64) << k for k, c in enumerate(leaf.on)), np.zeros(len(codes), np.int64))
                for slot, values in zip(to, self.make(leaf, unpacked(np.arange(1 << len(leaf.on)), len(leaf.on))), strict=True):
                    found[slot] = found.get(slot, 0.0) + values[code]
        return found

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """[slot, row]"""
        out, columns, one = np.zeros((self.slots, len(x))), np.ascontiguousarray(x.T), np.zeros(len(x))
        for t, tables, alone, wanted in self.trees:
            for node, code in t.codes(columns, wanted):
                if node in tables:
                    above, inner, table = tables[node]
                    for k, n in enumerate(inner, above):
                        code = code | (columns[t.feature[n]] <= t.threshold[n]).astype(np.int64) << k
                    for k, values in table.items():
                        out[k] += np.take(values, code, out=one, mode="clip")
                    continue
                leaf, to = alone[node]
                if len(leaf.on) > BITS:
                    o, which = patterns(x, leaf.on, leaf.low, leaf.high)
                else:
                    distinct, which = np.unique(code, return_inverse=True)
                    o = unpacked(distinct, len(leaf.on))
                for k, values in zip(to, self.make(leaf, o), strict=True):
                    out[k] += values[which]
        return out


def explainer(trees: list[Tree], width: int) -> Explainer:
    """Shapley values, a slot a column."""
    return Explainer(trees, width, lambda leaf: leaf.on, lambda leaf, o: leaf.alone(o))


def pair_explainer(trees: list[Tree], pairs: list[tuple[int, int]]) -> Explainer:
    """Interaction values of the given pairs of columns, a slot a pair."""
    both = lambda leaf: [(k, (leaf.on.index(i), leaf.on.index(j))) for k, (i, j) in enumerate(pairs) if i in leaf.on and j in leaf.on]
    return Explainer(trees, len(pairs), lambda leaf: [k for k, _ in both(leaf)], lambda leaf, o: leaf.joint(o, [at for _, at in both(leaf)]))


def shapley(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Shapley values, one row a row of x and one column a column; with the trees' means they add up to the prediction."""
    return explainer(trees, x.shape[1])(x).T


def interactions(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Shapley interaction values [row, column, column]: pairs get half their joint effect on either side, the diagonal is
    what is left, so that a row of the matrix adds up to the column's Shapley value."""
    out = np.zeros((*x.shape, x.shape[1]))
    for t in trees:
        for value, on, low, high, z in t.paths():
            d = len(on)
            if d < 2:
                continue
            weight = np.array([math.factorial(s) * math.factorial(d - s - 2) / (2 * math.factorial(d - 1)) for s in range(d - 1)])
            o, which = patterns(x, on, low, high)
            for i in range(d):
                for j in range(i):
                    both = (value * (o[:, i] - z[i]) * (o[:, j] - z[j]) * (sizes(o, z, (i, j))[:, : d - 1] @ weight))[which]
                    out[:, on[i], on[j]] += both
                    out[:, on[j], on[i]] += both
    at = np.arange(x.shape[1])
    out[:, at, at] = shapley(trees, x) - out.sum(axis=2)
    return out


def matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    """The array column x of a batch as rows of doubles."""
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)


def contributions(trees: list[Tree], df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The keep columns of df, and the Shapley value of every column under its name; columns must be doubles without nulls."""
    ship(df.sparkSession)
    width = len(columns)
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.array(*[F.col(f"`{c}`") for c in columns]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = explainer(trees, width)
        for b in batches:
            found = of(matrix(b, width))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(found[i]) for i in range(width))], names=[*names, *(f"c{i}" for i in range(width))])

    schema = T.StructType([*(T.StructField(n, df.schema[c].dataType) for c, n in zip(keep, names, strict=True)), *(T.StructField(f"c{i}", T.DoubleType()) for i in range(width))])
    return rows.mapInArrow(run, schema).toDF(*keep, *columns)


def mean_absolute(trees: list[Tree], df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """(rows, a mean absolute Shapley value for every column), one row in all or, with group, one for each of its values,
    which must be few: a task sends a row of sums for each."""
    ship(df.sparkSession)
    width = len(columns)
    key = F.col(f"`{group}`") if group else F.lit("")
    rows = df.select(key.cast("string").alias("g"), F.array(*[F.col(f"`{c}`") for c in columns]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = explainer(trees, width), {}
        for b in batches:
            found, g = np.abs(of(matrix(b, width))), b.column("g").dictionary_encode()
            at = g.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for k, name in [*enumerate(g.dictionary.to_pylist()), (-1, None)]:
                n = int((at == k).sum())
                if n:
                    before = sums.get(name, (0, 0.0))
                    sums[name] = (before[0] + n, before[1] + (found if n == len(at) else found[:, at == k]).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t.tolist() for _, t in sums.values()], pa.list_(pa.float64()))], names=["g", "n", "total"])

    found = rows.mapInArrow(run, "g string, n long, total array<double>").groupBy("g").agg(F.sum("n").alias("rows"), *[(F.sum(F.col("total")[i]) / F.sum("n")).alias(f"c{i}") for i in range(width)])
    return found.toDF(group, "rows", *columns) if group else found.drop("g").toDF("rows", *columns)


def mean_interactions(trees: list[Tree], df: DataFrame, columns: list[str], wanted: list[tuple[str, str]] | None = None) -> DataFrame:
    """(feature, other, mean_abs, mean): interaction values over all rows, each pair once and the diagonal, or only of the
    wanted pairs of different columns; a task sends one row of sums a pair."""
    ship(df.sparkSession)
    width = len(columns)
    place = {c: k for k, c in enumerate(columns)}
    pairs = None if wanted is None else sorted({tuple(sorted((place[a], place[b]))) for a, b in wanted})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(width) if pairs is None else np.array(pairs, int).reshape(-1, 2).T
        total, plain, n = np.zeros(len(i)), np.zeros(len(i)), 0
        of = pair_explainer(trees, pairs) if pairs is not None else lambda x: interactions(trees, x)[:, i, j].T
        step = 512 if pairs is None else 1 << 14  # whole matrices are large
        for b in batches:
            for at in range(0, b.num_rows, step):
                found = of(matrix(b.slice(at, step), width))
                total, plain, n = total + np.abs(found).sum(axis=1), plain + found.sum(axis=1), n + found.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total), pa.array(plain), pa.array(np.full(len(i), n), pa.int64())], names=["i", "j", "total", "plain", "n"])

    sums = df.select(F.array(*[F.col(f"`{c}`") for c in columns]).alias("x")).mapInArrow(run, "i int, j int, total double, plain double, n long")
    found = sums.groupBy("i", "j").agg(F.sum("total").alias("total"), F.sum("plain").alias("plain"), F.sum("n").alias("n")).where("n > 0")
    name = F.array(*[F.lit(c) for c in columns])
    return found.select(F.element_at(name, F.col("i") + 1).alias("feature"), F.element_at(name, F.col("j") + 1).alias("other"), (F.col("total") / F.col("n")).alias("mean_abs"), (F.col("plain") / F.col("n")).alias("mean"))
