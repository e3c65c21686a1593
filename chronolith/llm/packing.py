"""Best-fit packing with several capacities per bin.

A piece demands tokens, one document place and attention cost (its squared length). Pieces come longest first; of the
open bins that can hold a piece under every constraint, the one with the smallest weighted residual norm afterwards
(or the largest weighted dot product of demand and residual) takes it, else a new bin opens.

The pieces are dealt into groups of about `group` full bins and at most about ROWS pieces, each packed by itself, so no task
grows with the input and each group wastes at most one bin. They are dealt by hash of their place in the checkpointed
table too, so rows that repeat don't share a group. Numbers of bins are unique over all groups.

op8 bounds tokens only, as its contract does: its other two capacities are what the tokens imply and never bind.
best_fit() takes tighter ones, and tests pack under each of them.

Defined cases: null texts pack as one end token; null or repeated doc_ids and repeated rows are pieces like others; texts
of any length are cut into pieces; an empty table gives none; columns but doc_id and text are not read, so their names
can't clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import token_pieces
from .common import cut, rows_out, ship, shuffle_partitions


ROWS = 1 << 18  # pieces of a group, about


def pack(lengths: np.ndarray, tokens: int, docs: int, attention: float, rule: str = "norm", weights: tuple = (1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; capacities hold in each dimension of every bin."""
    if len(lengths) and (lengths.max() > tokens or docs < 1 or float(lengths.max()) ** 2 > attention):
        raise ValueError("a piece exceeds an empty bin")
    cap = np.array([tokens, docs, attention], float)
    w = np.array(weights, float)
    left = np.empty((1024, 3))
    open_bins = np.empty(1024, np.int64)  # numbers of the bins that may still take something
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = made = 0
    order = np.argsort(-lengths, kind="stable")
    shortest = int(lengths.min()) if len(lengths) else 0
    for i in order.tolist():
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        now = left[:n]
        fits = np.flatnonzero((now >= need).all(axis=1))
        if len(fits):
            after = (now[fits] - need) / cap
            score = -(after * after * w).sum(axis=1) if rule == "norm" else (now[fits] / cap * (need / cap) * w).sum(axis=1)
            b = int(fits[int(np.argmax(score))])
        else:
            if n == len(left):
                left, open_bins = np.concatenate([left, np.empty_like(left)]), np.concatenate([open_bins, np.empty_like(open_bins)])
            left[n], open_bins[n], b = cap, made, n
            n, made = n + 1, made + 1
        bins[i], offsets[i] = open_bins[b], tokens - left[b, 0]
        left[b] -= need
        if left[b, 0] < shortest or left[b, 1] < 1:  # full: the last open bin takes its row
            n -= 1
            left[b], open_bins[b] = left[n], open_bins[n]
    return bins, offsets


PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def best_fit(pieces: DataFrame, tokens: int = 4096, docs: int | None = None, attention: float | None = None, rule: str = "norm", group: int = 1024) -> DataFrame:
    """Sequence and offset of every row of pieces(doc_id, piece, start, length, ids_crc32).

    docs and attention bound the documents and the summed squared lengths of a sequence; left out, they are what the
    tokens allow at most.
    """
    docs, attention = docs or tokens, attention or float(tokens) ** 2
    spark = pieces.sparkSession
    ship(spark)
    pieces = cut(pieces)
    sums = pieces.agg(F.sum("length"), F.count("*"), F.sum(F.col("length") * F.col("length"))).first()
    full = max((sums[0] or 0) / tokens, (sums[1] or 0) / docs, (sums[2] or 0) / attention)
    groups = max(1, round(full / group), -(-(sums[1] or 0) // ROWS))
    bits = 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            b, offsets = pack(rows.column("length").to_numpy(), tokens, docs, attention, rule)
            ids = b + (rows.column("g")[0].as_py() << bits)
            return rows_out(PACKED, [*(rows.column(x.name).combine_chunks() for x in list(PACKED)[:5]), ids, offsets])

        held: list[pa.RecordBatch] = []  # of one group, which ends where the next begins
        for b in batches:
            g = b.column("g").to_numpy()
            for start, end in itertools.pairwise([*np.flatnonzero(np.r_[True, g[1:] != g[:-1]]).tolist(), len(g)] if len(g) else []):
                if held and held[0].column("g")[0].as_py() != g[start]:
                    yield out(held)
                    held = []
                held.append(b.slice(start, end - start))
        if held:
            yield out(held)

    # A task holds one group at a time, of about ROWS pieces; places and row order are fixed, so that a rerun packs alike.
    keyed = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    dealt = keyed.repartition(min(groups, shuffle_partitions(spark) * 4), "g").sortWithinPartitions("g", "doc_id", "piece", "ids_crc32", "length")
    return dealt.select("g", *[x.name for x in list(PACKED)[:5]]).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokens: int = 4096, path: str | None = None) -> DataFrame:
    return best_fit(token_pieces(docs, tokens, path=path), tokens)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
