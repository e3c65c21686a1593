"""Exact top-k search by inner product: a ball tree per shard, branch and bound against a shared k-th score.

Vectors are quantised to integers, so scores are exact. Each shard of at most SHARD vectors builds a ball tree
(split at the median of the coordinate that spreads most); a node's bound for query q is <q, centre> + |q| * radius.
A block of queries descends a tree together: nodes come by falling upper bound, and at each node only those queries
go on whose bound reaches their own k-th score so far. That score starts at a floor from one small seed shard, which k
real candidates reach, and is handed on from shard to shard of a deal, so later shards open fewer nodes. Ties stay,
as only lower bounds are dropped.

The query set is stated (ids divisible by `every`); blocks of queries stream past the shards of their deal, of which
each task builds on one deal's trees. Every deal gives at most k candidates a query.

Defined cases: null vectors and vectors with null or non-finite components, or with components that no long holds,
take no part; components of any other size count exactly (beyond what doubles hold exactly, in whole numbers of any
length; scores beyond a long are cut to its range before they are ranked); repeated vectors tie to the smaller id; a query row meets every row
but itself, other rows of its own id included, and each of several query rows of one id has its own k results; fewer
than k candidates give fewer rows; vectors of other dimensions don't meet; an empty table gives none; columns but vec_id
and embedding are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, numbered, rows_out, ship, small_join

SHARD, BLOCK, SEED, LEAF, DEALS, BUILD = 8192, 1024, 2048, 64, 256, 4
LONG = 1 << 63


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, q array<long>, copy) of the rows that take part; copy tells rows of one id apart, in order of q."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(LONG) / scale)))
    v = cut(v.where(fine).select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("q")))
    twice = cut(v.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
    if twice.isEmpty():
        return v.withColumn("copy", F.lit(0).cast("long"))
    once = small_join(v, twice, ["vec_id"], "left_anti").select("vec_id", "q", F.lit(0).cast("long").alias("copy"))
    return cut(once.unionByName(numbered(small_join(v, twice, ["vec_id"], "left_semi"), ["vec_id", "q"]).withColumnRenamed("number", "copy")))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of x with all rows of q: in doubles where they hold every partial sum, else in
    whole numbers of any length."""
    most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * x.shape[1]
    if most < 2.0**52:
        return x.astype(np.float64) @ q.astype(np.float64).T
    return np.clip(x.astype(object) @ q.astype(object).T, -LONG, LONG - 1)


def lowered(floor: np.ndarray) -> np.ndarray:
    """Floors as doubles that are surely no higher; the least long is also what lower scores are cut to."""
    floor = floor.astype(np.float64)
    floor = np.where(np.abs(floor) >= 2.0**53, floor - np.abs(floor) * 1e-15, floor)
    return np.where(floor <= -LONG, -np.inf, floor)


class Ball:
    """A ball tree over integer vectors: nodes with centres and radii, leaves are slices of one reordered matrix."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.slices, self.children, todo = [(0, len(ids))], [None], [0]
        y = x.astype(np.float64)
        while todo:
            node = todo.pop()
            a, b = self.slices[node]
            part = y[order[a:b]]
            spread = part.max(axis=0) - part.min(axis=0)
            if b - a <= leaf or not spread.any():  # equal vectors need no further split
                continue
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, int(np.argmax(spread))], mid)]
            self.children[node] = (len(self.slices), len(self.slices) + 1)
            self.slices += [(a, a + mid), (a + mid, b)]
            self.children += [None, None]
            todo += self.children[node]
        self.ids, self.copies, self.x = ids[order], copies[order], x[order]
        y = y[order]
        self.centre = np.array([y[a:b].mean(axis=0) for a, b in self.slices])
        self.radius = np.array([np.sqrt(((y[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(self.slices, self.centre, strict=True)])

    def search(self, best: Best) -> int:
        """best takes in this tree's vectors; returns how many pairs of a query and a node were opened."""
        q = best.q.astype(np.float64)
        bound = q @ self.centre.T + best.norm[:, None] * self.radius[None, :]
        bound += 1e-6 + np.abs(bound) * 1e-12 + best.norm[:, None] * (np.abs(self.centre).max(axis=1, initial=0) + self.radius)[None, :] * 1e-12  # rounding must not lose a tie
        todo = [(-float(bound[:, 0].max(initial=-np.inf)), 0, np.arange(len(q)))]
        opened = 0
        while todo:
            _, node, on = heapq.heappop(todo)
            on = on[bound[on, node] >= best.floor[on]]  # k-th scores may have risen since
            if not len(on):
                continue
            opened += len(on)
            if self.children[node] is None:
                a, b = self.slices[node]
                best.take(on, self.ids[a:b], self.copies[a:b], products(self.x[a:b], best.q[on]).T)
                continue
            for child in self.children[node]:
                go = on[bound[on, child] >= best.floor[on]]
                if len(go):
                    heapq.heappush(todo, (-float(bound[go, child].max()), child, go))
        return opened


class Best:
    """The k best of every query of a block so far; floor is each query's k-th score, or what was known to be reached."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.copies, self.q, self.k = ids, copies, q, k
        self.floor = lowered(floor)
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.found: list[list[tuple]] = [[] for _ in ids]  # (-score, vec_id, copy), sorted

    def take(self, on: np.ndarray, ids: np.ndarray, copies: np.ndarray, scores: np.ndarray) -> None:
        """scores[i, j]: of query on[i] and vector j."""
        hit = scores >= self.floor[on][:, None]
        hit &= (ids[None, :] != self.ids[on][:, None]) | (copies[None, :] != self.copies[on][:, None])
        rows = np.flatnonzero(hit.any(axis=1))
        for r in rows.tolist():
            i, at = int(on[r]), np.flatnonzero(hit[r])
            new = list(zip((-scores[r, at]).tolist(), ids[at].tolist(), copies[at].tolist(), strict=True))
            self.found[i] = sorted(self.found[i] + new)[: self.k]
            if len(self.found[i]) == self.k:
                self.floor[i] = max(self.floor[i], float(lowered(np.array(-float(self.found[i][-1][0])))))

    def hits(self) -> Iterator[tuple]:
        for i, c, found in zip(self.ids.tolist(), self.copies.tolist(), self.found, strict=True):
            for s, v, vc in found:
                yield i, c, v, vc, -int(s)


HITS = pa.schema([(c, pa.int64()) for c in ("query_id", "query_copy", "vec_id", "vec_copy", "score")])
HITS_SQL = "query_id long, query_copy long, vec_id long, vec_copy long, score long"
PACKED = pa.schema([("dim", pa.int32()), ("number", pa.int64()), ("pack", pa.binary())])


def packed(rows: DataFrame, size: int, shape) -> DataFrame:
    """Rows of (vec_id, copy, q[, floor]) as blocks of at most `size`, one binary each, as they lie in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {}

        def out(dim: int, held: list[tuple]) -> pa.RecordBatch:
            ids, copies, q, floor = zip(*held, strict=True)
            one = shape(np.array(ids, np.int64), np.array(copies, np.int64), np.array(q, np.int64).reshape(len(ids), dim), np.array(floor, np.float64))
            return rows_out(PACKED, ([dim], [ids[0]], [pickle.dumps(one)]))

        for b in batches:
            low = b.column("floor").to_pylist() if "floor" in b.schema.names else [None] * b.num_rows
            for i, c, q, f in zip(*(b.column(x).to_pylist() for x in ("vec_id", "copy", "q")), low, strict=True):
                held = kept.setdefault(len(q), [])
                held.append((i, c, q, -np.inf if f is None else f))
                if len(held) == size:
                    yield out(len(q), kept.pop(len(q)))
        for dim, held in kept.items():
            yield out(dim, held)

    return rows.mapInArrow(run, "dim int, number long, pack binary")


def trees(rows: DataFrame, size: int, leaf: int) -> DataFrame:
    return packed(rows, size, lambda ids, copies, x, _: Ball(ids, copies, x, leaf))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    return packed(rows, size, lambda *columns: columns).select("dim", F.col("pack").alias("block"))


def search(pairs: DataFrame, k: int) -> DataFrame:
    """pairs(block, pack) -> the k best of every query of a block in all shards that follow one another with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, None

        def out() -> Iterator[pa.RecordBatch]:
            found = list(best.hits()) if best else []
            if found:
                yield rows_out(HITS, zip(*found, strict=True))

        for b in batches:
            for block, pack in zip(b.column("block"), b.column("pack"), strict=True):
                block = block.as_py()
                if block != last:
                    yield from out()
                    last, best = block, Best(*pickle.loads(block), k)
                pickle.loads(pack.as_py()).search(best)
        yield from out()

    return pairs.mapInArrow(run, HITS_SQL)


def best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id", "vec_copy")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def deals_of(parts: int) -> int:
    """How many deals that many shards make: at least DEALS where there are enough, and at most BUILD shards in each, so
    that what a task builds has one size whatever the table's."""
    return max(min(parts, DEALS), -(-parts // BUILD))


def dealt(vectors: DataFrame, parts: int) -> DataFrame:
    """(dim, number, pack, deal): the shards' trees, dealt by the partition that they were built in."""
    shards = trees(vectors.repartition(parts, F.xxhash64("vec_id", "copy")), SHARD, LEAF)
    return cut(shards.withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(deals_of(parts))).cast("int")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): queries(vec_id, q, copy) against all rows of vectors(vec_id, q, copy) but the query itself."""
    ship(vectors.sparkSession)
    parts = max(1, -(-vectors.count() // SHARD))
    deals, shards = deals_of(parts), dealt(vectors, parts)
    ask = cut(queries)
    asked = max(1, -(-ask.count() // BLOCK))

    # Floors: the k-th score over one seed shard of fixed size, itself an exact search.
    few = vectors.orderBy(F.xxhash64("vec_id", "copy")).limit(SEED)
    first = blocks(ask.repartition(asked, "vec_id", "copy"), BLOCK).join(F.broadcast(trees(few.coalesce(1), SEED, LEAF)), "dim")  # SEED vectors
    floor = best(search(first.select("block", "pack"), k), k).groupBy("query_id", "query_copy").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k)
    floor = floor.select(F.col("query_id").alias("vec_id"), F.col("query_copy").alias("copy"), F.col("floor").cast("double").alias("floor"))
    known = cut(ask.join(floor, ["vec_id", "copy"], "left").select("vec_id", "copy", "q", "floor"))
    # Blocks stream past the trees of their deal, which are the side that is built. As many partitions as deals: by hash a
    # task gets one on average, and a few at most.
    each = blocks(known.repartition(asked, "vec_id", "copy"), BLOCK).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    built = shards.select("deal", "dim", "pack").repartition(deals, "deal", "dim")
    pairs = each.repartition(deals, "deal", "dim").join(built.hint("shuffle_hash"), ["deal", "dim"])
    return best(search(pairs.select("block", "pack"), k), k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


ORACLE_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(CAST(x AS DOUBLE)) >= 144115188075855872)) = 0),
n AS (SELECT vec_id, q, row_number() OVER (PARTITION BY vec_id ORDER BY q) AS copy FROM v),
s AS (
  SELECT a.vec_id AS query_id, a.copy AS query_copy, b.vec_id AS vec_id, b.copy AS vec_copy,
         greatest(least(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])), 9223372036854775807), -9223372036854775808) AS score
  FROM n a JOIN n b ON (a.vec_id <> b.vec_id OR a.copy <> b.copy) AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query_copy ORDER BY score DESC, vec_id, vec_copy) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
