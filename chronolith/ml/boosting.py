"""Gradient boosting by gradients and Hessians over binned columns.

Columns are cut at approximate quantiles into at most `bins` bins, once. A tree grows best split first: one Spark job
sums gradients, Hessians and rows per (node, column, bin) for every open node, pre-summed in each task, so a task sends
as many cells as the model's shape allows, whatever the number of rows. Of two children only the one of fewer rows is
summed, the other is what is left of their parent. Jobs look ahead: the children of every leaf
with a known split are summed together, so growing by level (no limit of leaves) takes a job a level, and growing by leaf
(`leaves`) few more. A split's gain is the rise of G^2 / (H + reg_lambda), halved, less gamma; a leaf is worth
-G / (H + reg_lambda), with G drawn towards zero by reg_alpha. With the absolute loss the tree grows on the signs of
the residuals and each leaf takes the median residual of its rows.

Binned rows are kept in checkpointed blocks of some thousand rows, column by column, so a pass moves a few large values
and counts one column at a time. Margins are in the blocks and brought up to date every REFRESH trees; in between the
trees since are applied where the blocks are read. Medians are exact: their bits are found by passes of counts, so no task and no
state holds all residuals.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, forget, ship
from .trees import Tree, matrix, predicted

REFRESH = 8


@dataclass
class Params:
    n_estimators: int = 12
    learning_rate: float = 0.3
    max_depth: int = 5
    leaves: int | None = None  # grow by leaf up to so many
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    min_child_samples: int = 1
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    absolute: bool = False
    bins: int = 64
    seed: int = 42


@dataclass
class Node:
    depth: int
    sums: tuple[float, float, float] = (0.0, 0.0, 0.0)  # gradients, Hessians, rows
    split: tuple[float, int, int] | None = None  # gain, column, last bin that goes left
    children: tuple[int, int] | None = None
    real: bool = False  # whether the split is part of the tree
    cells: np.ndarray | None = None  # [column, bin, (g, h, n)] until the children have theirs


def drawn(g: float, alpha: float) -> float:
    return max(abs(g) - alpha, 0.0) * (1 if g > 0 else -1)


def score(g, h, p: Params):
    g = np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0.0)
    return np.divide(g * g, h + p.reg_lambda, out=np.zeros_like(np.asarray(h, float)), where=(h + p.reg_lambda) > 0)


def best_split(cells: np.ndarray, on: list[int], p: Params) -> tuple[float, int, int] | None:
    """cells[column, bin, (g, h, n)] -> the split of greatest gain, ties to the first column and bin."""
    if cells.shape[1] < 2:
        return None
    left = np.cumsum(cells, axis=1)[:, :-1]
    total = cells.sum(axis=1)
    right = total[:, None] - left
    gain = 0.5 * (score(left[..., 0], left[..., 1], p) + score(right[..., 0], right[..., 1], p) - score(total[:, 0], total[:, 1], p)[:, None]) - p.gamma
    fine = (np.minimum(left[..., 1], right[..., 1]) >= p.min_child_weight) & (np.minimum(left[..., 2], right[..., 2]) >= max(p.min_child_samples, 1))
    gain = np.where(fine, np.round(gain, 9), -np.inf)
    gain[np.setdiff1d(np.arange(len(gain)), on)] = -np.inf
    f, b = divmod(int(np.argmax(gain)), gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-9 else None


@dataclass
class Boosted:
    """A fitted model: base value, trees over raw columns, and each column's share of the gain."""

    columns: list[str]
    base: float
    trees: list[Tree]
    gains: np.ndarray
    stages: list = field(default_factory=list)

    def __post_init__(self):
        self.stages = [self]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  as Spark's models call it
        return DenseVector(self.gains / (self.gains.sum() or 1.0))

    def transform(self, df: DataFrame) -> DataFrame:
        """df with pred_log; the columns must be doubles without nulls."""
        ship(df.sparkSession)
        base, trees = self.base, self.trees

        width = len(self.columns)

        def scored(x: pa.Array) -> pa.Array:
            return pa.array(base + predicted(trees, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)))

        scored = F.arrow_udf(scored, "double")
        return df.withColumn("pred_log", scored(F.array(*[F.col(f"`{c}`") for c in self.columns])))


def edges_of(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Upper ends of all bins but the last, of every column."""
    at = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`"), at, 10_000).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(e or [], float)) for e in row]


BLOCK = "n int, x binary, y binary, margin binary"
#: Bits of a median that a pass finds, and rows of which the last pass counts whole values.
DIGIT, FEW = 12, 1 << 16


def binned(df: DataFrame, columns: list[str], label: str, edges: list[np.ndarray], base: float) -> DataFrame:
    """(id, n, x, y, margin), checkpointed: blocks of n rows, x with a byte, the bin, for each column and row."""
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.ascontiguousarray(matrix(b, width).T)
                bins = np.array([np.searchsorted(e, c).astype(np.uint8) for e, c in zip(edges, x, strict=True)], np.uint8)
                yield block(b.num_rows, bins, b.column("y").to_numpy(zero_copy_only=False), np.full(b.num_rows, base))

    rows = df.select(F.array(*[F.col(f"`{c}`") for c in columns]).alias("x"), F.col(f"`{label}`").cast("double").alias("y")).where("y is not null")
    return checkpointed(rows.mapInArrow(run, BLOCK).select(F.monotonically_increasing_id().alias("id"), "*"))


def block(n: int, x: np.ndarray, y: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (x, y, margin))], names=["n", "x", "y", "margin"])


def read(batches: Iterator[pa.RecordBatch], width: int, since: list[Tree]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Id, bins [row, column], label and margin of each block; since: trees over bins that the margins lack."""
    for b in batches:
        for k in range(b.num_rows):
            n, (x, y, margin) = b.column("n")[k].as_py(), (b.column(c)[k].as_buffer() for c in ("x", "y", "margin"))
            x, y, margin = np.frombuffer(x, np.uint8).reshape(width, n).T, np.frombuffer(y), np.frombuffer(margin)
            yield b.column("id")[k].as_py() if "id" in b.schema.names else 0, x, y, margin + predicted(since, x) if since else margin


def drawn_rows(block_id: int, n: int, share: float, seed: int) -> np.ndarray:
    """Which of a block's rows a tree sees, by a hash of block, row and seed."""
    h = np.arange(n, dtype=np.uint64) + np.uint64((block_id * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(44) < int(share * (1 << 20))


def table(nodes: list[Node], values: dict[int, float] | None = None, number: bool = False) -> Tree:
    """Nodes as a tree over bins; with number, every leaf's value is its node, over all nodes that exist."""
    rows = []
    for k, n in enumerate(nodes):
        go = n.children is not None and (n.real or number)
        a, b = n.children if go else (0, 0)
        f, cut = (n.split[1], n.split[2]) if go else (-1, 0)
        rows.append((f, cut, a, b, float(k) if number else 0.0 if go else (values or {}).get(k, 0.0), n.sums[2]))
    return Tree.of(rows)


def histograms(rows: DataFrame, nodes: list[Node], want: list[int], width: int, on: list[int], bins: int, since: list[Tree], p: Params, seed: int) -> np.ndarray:
    """[node, column, bin, (g, h, n)] of the wanted nodes; columns that are not on stay empty. A row's Hessian is 1."""
    tree = table(nodes, number=True)
    slot = np.full(len(nodes), -1, np.int64)
    slot[want] = np.arange(len(want))
    absolute, subsample, size = p.absolute, p.subsample, len(want) * bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((width, size)), np.zeros((width, size), np.int64)
        for at, x, y, margin in read(batches, width, since):
            node = slot[tree.leaves_of(x)]
            seen = node >= 0
            if subsample < 1:
                seen &= drawn_rows(at, len(y), subsample, seed)
            g = np.sign(margin - y) if absolute else margin - y
            some = slice(None) if seen.all() else np.flatnonzero(seen)
            g, node = g[some], node[some] * bins
            for c in on:
                cell = node + x[:, c][some]
                total[c] += np.bincount(cell, g, size)
                count[c] += np.bincount(cell, minlength=size)
        for k in range(len(want)):
            g, n = (a[:, k * bins : (k + 1) * bins].ravel() for a in (total, count))
            some = np.flatnonzero(n)
            if len(some):
                yield cells_of(k, some, g[some], n[some])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, cell, g, n in cells_in(batches):
            total, count = sums.setdefault(k, (np.zeros(width * bins), np.zeros(width * bins, np.int64)))
            total[cell] += g
            count[cell] += n
        for k, (total, count) in sums.items():
            some = np.flatnonzero(count)
            yield cells_of(k, some, total[some], count[some])

    each = rows.select("id", "n", "x", "y", "margin").mapInArrow(run, CELLS)
    out = np.zeros((len(want), width * bins, 3))
    for k, cell, g, n in cells_in(each.repartition("node").mapInArrow(added, CELLS).toArrow().to_batches()):  # as many as the open nodes have bins
        out[k, cell] = np.column_stack([g, n, n])
    return out.reshape(len(want), width, bins, 3)


#: The cells of a node that have rows, their gradients and counts, as a task sends them: a row a node, not a row a cell.
CELLS = "node int, cell binary, g binary, n binary"


def cells_of(k: int, cell: np.ndarray, g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (cell.astype(np.int32), g, n))], names=["node", "cell", "g", "n"])


def cells_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for k in range(b.num_rows):
            cell, g, n = (b.column(c)[k].as_buffer() for c in ("cell", "g", "n"))
            yield b.column("node")[k].as_py(), np.frombuffer(cell, np.int32), np.frombuffer(g), np.frombuffer(n, np.int64)


def grown(rows: DataFrame, width: int, bins: int, since: list[Tree], p: Params, seed: int, of: list[int]) -> list[Node]:
    """A tree on some columns, best split first, up to p.leaves leaves and p.max_depth levels."""
    rnd = random.Random(seed)
    on = sorted(rnd.sample(of, max(1, round(p.colsample_bytree * len(of))))) if p.colsample_bytree < 1 else sorted(of)
    nodes = [Node(0)]
    heap: list[tuple[float, int]] = []
    limit, leaves = p.leaves or 1 << 30, 1

    def given(k: int, cells: np.ndarray) -> None:
        nodes[k].split = best_split(cells, on, p) if on and nodes[k].depth < p.max_depth else None
        nodes[k].cells = cells if nodes[k].split else None

    def summed(parents: list[int]) -> None:
        """Both children of each node: their sums are those of its split; of their histograms only that of the child with
        fewer rows is counted, the other one is the node's less that. At the last level there is nothing to count."""
        want = []
        for j in parents:
            (_, f, b), (left, right) = nodes[j].split, nodes[j].children
            less, total = nodes[j].cells[f, : b + 1].sum(axis=0), nodes[j].cells[f].sum(axis=0)
            nodes[left].sums, nodes[right].sums = tuple(less), tuple(total - less)
            if nodes[left].depth < p.max_depth:
                want.append((j, left, right) if nodes[left].sums[2] <= nodes[right].sums[2] else (j, right, left))
        found = histograms(rows, nodes, [few for _, few, _ in want], width, on, bins, since, p, seed) if want else []
        for (j, few, many), cells in zip(want, found, strict=True):
            rest = nodes[j].cells - cells
            rest[rest[..., 2] == 0] = 0.0
            given(few, cells)
            given(many, rest)
        for j in parents:
            nodes[j].cells = None

    def offered(k: int) -> None:
        if nodes[k].split:
            heapq.heappush(heap, (-nodes[k].split[0], k))

    cells = histograms(rows, nodes, [0], width, on, bins, since, p, seed)[0]
    nodes[0].sums = tuple(cells[on[0]].sum(axis=0)) if on else (0.0, 0.0, 0.0)
    given(0, cells)
    offered(0)
    while heap and leaves < limit:
        k = heap[0][1]
        if nodes[k].children is None:  # sums of the children of all leaves that may split
            want = []
            # Without a limit every split will be made, whether or not it is its turn: a job a level.
            for j in [j for _, j in sorted(heap)[: limit - leaves]] if p.leaves else [j for j, n in enumerate(nodes) if n.split]:
                if nodes[j].children is None:
                    nodes[j].children = (len(nodes), len(nodes) + 1)
                    want.append(j)
                    nodes += [Node(nodes[j].depth + 1), Node(nodes[j].depth + 1)]
            summed(want)
        heapq.heappop(heap)
        nodes[k].real, leaves = True, leaves + 1
        for child in nodes[k].children:
            offered(child)
    return nodes


def ordered(r: np.ndarray) -> np.ndarray:
    """Whole numbers without sign in the order of the doubles."""
    u = (r + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def back(u: int) -> float:
    return float(np.array([u ^ (1 << 63) if u >> 63 else u ^ ((1 << 64) - 1)], np.uint64).view(float)[0])


def ordered(r: np.ndarray) -> np.ndarray:
    """Whole numbers without sign in the order of the doubles."""
    u = (r + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63) > 0, ~u, u | np.uint64(1 << 63))


def residual(u: int) -> float:
    """The double that ordered() made u of."""
    return float(np.array([u ^ (1 << 63) if u >> 63 else u ^ ((1 << 64) - 1)], np.uint64).view(np.float64)[0])


def combined(found: list[np.ndarray]) -> np.ndarray:
    """Rows of (leaf, beginning, count) with the counts of equal ones added up."""
    rows = np.concatenate(found)
    distinct, which = np.unique(rows[:, :2], axis=0, return_inverse=True)
    return np.column_stack([distinct, np.bincount(which.reshape(-1), rows[:, 2], len(distinct)).astype(np.uint64)])


def counted(rows: DataFrame, tree: Tree, width: int, since: list[Tree], bits: int, last: int, wanted: dict[int, list[int]] | None) -> dict[int, list[tuple[int, int]]]:
    """By leaf, how many residuals have each beginning (all but their last bits), in order; with wanted, only of those
    that begin, up to the bits `last`, as is wanted of their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros((0, 3), np.uint64)]
        for _, x, y, margin in read(batches, width, since):
            leaf, u = tree.leaves_of(x).astype(np.uint64), ordered(y - margin)
            if wanted is not None:
                on, begins = np.zeros(len(u), bool), u >> np.uint64(last)
                for k, ends in wanted.items():
                    for end in set(ends):
                        on |= (leaf == np.uint64(k)) & (begins == np.uint64(end))
                leaf, u = leaf[on], u[on]
            each, n = np.unique(np.column_stack([leaf, u >> np.uint64(bits)]), axis=0, return_counts=True)
            found.append(np.column_stack([each, n.astype(np.uint64)]))
            if len(found) > 32:
                found = [combined(found)]
        some = np.ascontiguousarray(combined(found).T).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in some], names=["leaf", "at", "n"])

    sums = rows.select("n", "x", "y", "margin").mapInArrow(run, "leaf long, at long, n long").groupBy("leaf", "at").agg(F.sum("n").alias("n"))
    out: dict[int, list[tuple[int, int]]] = {}
    for leaf, at, n in sums.collect():  # 2^DIGIT for each wanted beginning, or FEW
        out.setdefault(leaf, []).append((at % (1 << 64), n))
    return {leaf: sorted(cells) for leaf, cells in out.items()}


def medians(rows: DataFrame, tree: Tree, width: int, since: list[Tree]) -> dict[int, float]:
    """The median residual of every leaf's rows, exact: each pass finds the next DIGIT bits of a leaf's two middle residuals
    from counts; once FEW rows begin as they do, a pass counts whole values."""
    bits, last, wanted, ranks = 64 - DIGIT, 64, None, {}
    while True:
        cells = counted(rows, tree, width, since, bits, last, wanted)
        ends: dict[int, list[int]] = {}
        left: dict[tuple[int, int], int] = {}
        for leaf, some in cells.items():
            if wanted is None:
                n = sum(n for _, n in some)
                ranks[leaf] = [(n - 1) // 2, n // 2]
            for k in (0, 1):
                rank = ranks[leaf][k]
                for at, n in some:
                    if wanted is not None and at >> (last - bits) != wanted[leaf][k]:
                        continue
                    if rank < n:
                        break
                    rank -= n
                ranks[leaf][k] = rank
                ends.setdefault(leaf, []).append(at)
                left[leaf, at] = n
        if not bits:
            return {leaf: (residual(a) + residual(b)) / 2 for leaf, (a, b) in ends.items()}
        bits, last, wanted = max(bits - DIGIT, 0) if sum(left.values()) > FEW else 0, bits, ends


@dataclass
class Blocks:
    """Binned rows (see binned()) of some columns, and the base value, for any number of fits."""

    columns: list[str]
    edges: list[np.ndarray]
    base: float
    rows: DataFrame

    @property
    def bins(self) -> int:
        return max([len(e) + 1 for e in self.edges], default=1)


def blocks_of(df: DataFrame, columns: list[str], label: str, p: Params) -> Blocks:
    ship(df.sparkSession)
    rows = df.where(F.col(label).isNotNull())
    base = (rows.agg(F.percentile(label, 0.5) if p.absolute else F.avg(label)).first()[0]) or 0.0
    edges = edges_of(rows, columns, min(p.bins, 256))
    return Blocks(columns, edges, base, binned(rows, columns, label, edges, base))


def fit_boosted(df: DataFrame, columns: list[str], label: str = "label", params: Params | None = None) -> Boosted:
    """Boosted trees for label; the columns must be doubles without nulls, at most 256 bins each."""
    p = params or Params()
    return boosted(blocks_of(df, columns, label, p), columns, p)


def boosted(blocks: Blocks, columns: list[str], p: Params) -> Boosted:
    """Boosted trees on the given columns of the blocks; the same as from blocks of these columns alone."""
    at = {c: k for k, c in enumerate(blocks.columns)}
    few, width, bins, edges = [at[c] for c in columns], len(blocks.columns), blocks.bins, blocks.edges
    data, since, raw, gains = blocks.rows, [], [], np.zeros(width)
    place = np.full(width + 1, -1, np.int64)  # of a block's column in columns; the last one stands for no column
    place[few] = np.arange(len(few))
    for k in range(p.n_estimators):
        nodes = grown(data, width, bins, since, p, p.seed + k, few)
        leaf = [i for i, n in enumerate(nodes) if not n.real]
        if p.absolute:
            values = medians(data, table(nodes), width, since)
        else:
            values = {i: -drawn(nodes[i].sums[0], p.reg_alpha) / (nodes[i].sums[1] + p.reg_lambda) if nodes[i].sums[1] + p.reg_lambda else 0.0 for i in leaf}
        tree = table(nodes, {i: p.learning_rate * v for i, v in values.items()})
        for n in nodes:
            if n.real:
                gains[n.split[1]] += n.split[0]
        since.append(tree)
        cut = np.array([edges[f][int(t)] if f >= 0 else 0.0 for f, t in zip(tree.feature, tree.threshold, strict=True)])
        raw.append(Tree(place[tree.feature], cut, tree.left, tree.right, tree.value, tree.cover))
        if len(since) == REFRESH and k + 1 < p.n_estimators:
            data, old, since = moved(data, width, since), data, []
            if old is not blocks.rows:
                forget(old)
    if data is not blocks.rows:
        forget(data)
    return Boosted(columns, blocks.base, raw, gains[few])


def moved(data: DataFrame, width: int, since: list[Tree]) -> DataFrame:
    """The blocks with margins that hold all trees so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins = [m.astype(float).tobytes() for _, _, _, m in read([b], width, since)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "n", "x", "y")), pa.array(margins, pa.binary())], names=["id", "n", "x", "y", "margin"])

    return checkpointed(data.mapInArrow(run, f"id long, {BLOCK}"))
