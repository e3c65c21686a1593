"""SimHash near-duplicates: pivot distance tables discard pairs, exact distances verify the rest.

Every distinct fingerprint takes part once, however many rows carry it. Two fingerprints at d <= 2 differing bits
agree on at least two of their four 16-bit blocks, so the six pairs of blocks are keys under which every link meets.
Within a key, each fingerprint's distances to fixed reference fingerprints (pivots) are tabled; by the triangle
inequality a pair whose distances to any pivot differ by more than d is no link. What is left is verified by exact
distance, and only a spanning forest of a key's links is emitted. A key with more than HOT fingerprints is taken
apart instead: each of its fingerprints is keyed by itself and its 64 one-bit neighbours. Links at two bits share a
neighbour, and no such key can have more than 65 distinct fingerprints.

The pipeline's stage, which keeps one document of each group, is in similar.py.

Defined cases: null and empty texts have fingerprint zero and link like any other; a null doc_id keeps its
fingerprint and takes the smallest non-null doc_id of its component (null if there is none); repeated rows and different
texts under one doc_id each have a row; texts of any length are read whole; an empty table gives none; columns but
doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, rows_out, salted_join, ship, shuffle_partitions, slices
from .components import connected_components

#: Fingerprints under one key of two blocks beyond which the key is taken apart.
HOT = 2048
PIVOTS = 24
MASK = (1 << 64) - 1


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: a fixed pseudo-random sequence (splitmix64), the same on every executor."""
    found, state = [], 42
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & MASK
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        found.append(z ^ (z >> 31))
    return np.array(found, np.uint64)


def shingles(text: bytes | None, words: int = 3, seed: int = 42) -> list[int]:
    """The hash of each word shingle of a text; fewer words are one shingle, no words are none."""
    found = (text or b"").lower().split()  # bytes: A-Z only, and exactly \x20\x09-\x0d part words
    if not found:
        return []
    h, joined = xxhash.xxh64_intdigest, b" ".join(found)
    if len(found) < words:
        return [h(joined, seed)]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [h(joined[a:b], seed) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; a bit is set if over half of the shingles' hashes set it."""
    hashes = shingles(text, words, seed)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    flat = np.array(hashes, "<u8")
    for at in range(0, len(flat), 255):  # sums of at most 255 bits fit a byte
        bits = np.unpackbits(flat[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(flat), bitorder="little").view("<u8")[0])


FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield rows_out(FINGERPRINTS, (b.column("doc_id"), fps))

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def forest(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links at `bits` or fewer differing bits within runs of equal keys (sorted), thinned to a spanning forest per run."""
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(bounds)
    lefts, rights = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, table.shape[1], 8):  # the table first, a few pivots at a time
            near = np.abs(table[i, at : at + 8] - table[j, at : at + 8]).max(axis=1, initial=0) <= bits
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        lefts.append(i[near])
        rights.append(j[near])

    end = np.repeat(bounds[1:], sizes)
    small = np.repeat(sizes <= 64, sizes)
    at = np.flatnonzero(small)
    for lag in range(1, 64):
        at = at[at + lag < end[at]]
        if not len(at):
            break
        keep(at, at + lag)
    for a, b in zip(bounds[:-1][sizes > 64], bounds[1:][sizes > 64], strict=True):
        for x in range(a, b):
            near = np.flatnonzero(np.abs(table[x + 1 : b, 0] - table[x, 0]) <= bits) + x + 1
            keep(np.full(len(near), x), near)
    i, j = np.concatenate(lefts or [np.zeros(0, np.int64)]), np.concatenate(rights or [np.zeros(0, np.int64)])
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    used = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            used[k] = True
    return fps[i[used]], fps[j[used]]


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def linked(keyed: DataFrame, bits: int) -> DataFrame:
    """keyed(key, fp) -> (a, b) links; rows of a key meet in one partition, sorted, and are read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = forest(k, f, bits)
            return rows_out(EDGES, (a.view(np.int64), b.view(np.int64)))

        for b in batches:
            keys = np.concatenate([keys, b.column("key").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) > 1 << 16:
                last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                yield out(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        yield out(keys, fps)

    n = shuffle_partitions(keyed.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def block_key(i: int, j: int) -> Column:
    """Which two blocks, and their 32 bits, as one long."""
    part = lambda k: F.shiftrightunsigned(F.col("fp"), 16 * k).bitwiseAND(F.lit(0xFFFF))
    return (F.lit(i * 4 + j).cast("long") * F.lit(1 << 32)) + part(i) * F.lit(1 << 16) + part(j)


def links(distinct: DataFrame, bits: int = 2, hot: int = HOT) -> DataFrame:
    """distinct(fp) -> (a, b): links that join what is within `bits` (at most 2) differing bits."""
    if bits > 2:
        raise ValueError("two shared blocks of four are sure for at most two differing bits")
    ship(distinct.sparkSession)
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keyed = distinct.select("fp", F.explode(F.array(*[block_key(i, j) for i, j in pairs])).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(counts, "key").select("key", "fp", "n"))
    usual = linked(met.where(F.col("n") <= hot).select("key", "fp"), bits)
    apart = met.where(F.col("n") > hot).select("fp").distinct()
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)]]
    return usual.unionByName(linked(apart.select(F.explode(F.array(*flips)).alias("key"), "fp"), bits))


def near_duplicates(docs: DataFrame, bits: int = 2, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable over links."""
    each = cut(fingerprints(docs))
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(links(distinct.select("fp"), bits, hot))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = labelled.groupBy("root").agg(F.min("rep").alias("least"))
    moved = cut(labelled.join(least, "root").select("fp", "least"))
    classes = distinct.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return salted_join(each, cut(classes), "fp").select("doc_id", "fp", "component_id")  # one fingerprint may hold a third of all rows


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
