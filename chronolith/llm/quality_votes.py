"""Quality by nearest-neighbour votes in a latent-semantic space.

A bounded, stratified sample of labelled documents (REFERENCES of each class at most, by hash of the id) is turned
into term vectors of two fields, hashed byte n-grams and word n-gram patterns (a window of words by which of them are
equal, whatever they are); idf, each field at unit length and a truncated SVD give the latent space. The latent vectors of the
sample, a few hundred kilobytes whatever the corpus size, are broadcast. Every document is projected, its cosine with
every reference is computed exactly in blocks, and its nearest references vote with their similarity; a class's votes
are weighted so that the stratified sample counts as the labels do.

Figures on the supplied labels, which tests hold: see the README. Byte n-grams alone leave out a quarter of the bad documents,
as they hardly see that words repeat.

Defined cases: a text without n-grams (null, empty, one byte) has no neighbours and gets the share of good labels;
without any usable label every score is 0.5; null labels are no labels; a document labelled more than once counts by
the mean of its labels; rows that repeat are scored alike; texts of any length are read whole; an empty table gives
none; columns of any name go through keep_good as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, rows_out, ship, slices

REFERENCES, BINS, WINDOW, RANK, NEIGHBOURS, SHARP, BLOCK = 1024, 4096, 4, 64, 32, 4.0, 512
THRESHOLD = 0.7
PATTERNS = WINDOW ** (WINDOW - 1)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def grams(text: bytes | None) -> np.ndarray:
    """Dampened counts of hashed byte pairs and triples, and of the patterns of word windows, over the whole text."""
    b = np.frombuffer(text or b"", np.uint8).astype(np.uint32)
    found = np.zeros(BINS + PATTERNS, np.float32)
    for n in (2, 3):
        if len(b) >= n:
            code = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                code = code * np.uint32(257) + b[k : len(b) - n + 1 + k]
            code = (code * np.uint32(2654435761)) >> np.uint32(20)  # the upper 12 of 32 bits
            found[:BINS] += np.bincount(code, minlength=BINS)
    words = (text or b"").split()
    n = len(words) - WINDOW + 1
    if n > 0:
        h = np.fromiter(map(hash, words), np.int64, len(words))
        code = np.zeros(n, np.int64)
        for i in range(1, WINDOW):  # each word of a window by the first one that is equal to it
            first = np.full(n, i)
            for j in range(i - 1, -1, -1):
                first[h[i : i + n] == h[j : j + n]] = j
            code = code * WINDOW + first
        found[BINS:] = np.bincount(code, minlength=PATTERNS)
    return np.log1p(found)


def rows_normal(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term vectors of unit length, to which both fields give alike."""
    x = x * idf
    return rows_normal(np.hstack([rows_normal(x[:, :BINS]), rows_normal(x[:, BINS:])]))


class Votes:
    """What scoring needs: idf, basis, latent references, their labels and vote weights. All of fixed size bounds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float, rank: int = RANK, seed: int = 7):
        self.prior, self.y = prior, y.astype(np.float32)
        n = len(x)
        self.idf = np.log((1 + n) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        x = weighted(x, self.idf)
        # Truncated SVD by power iterations from a seeded start.
        q = np.random.default_rng(seed).standard_normal((n, min(rank, n))).astype(np.float32)
        for _ in range(4):
            q = np.linalg.qr(x @ (x.T @ q))[0]
        self.basis = np.linalg.svd(q.T @ x, full_matrices=False)[2].T.astype(np.float32)
        self.latent = rows_normal(x @ self.basis)
        good = max(float(y.sum()), 1e-9)
        bad = max(float(n - y.sum()), 1e-9)
        self.weight = np.where(y > 0.5, prior / good, (1 - prior) / bad).astype(np.float32)

    def score(self, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Shares of the weighted votes for good, of one block of rows."""
        z = rows_normal(weighted(x, self.idf) @ self.basis)
        cos = z @ self.latent.T
        k = min(k, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0) ** SHARP * self.weight[near]
        total = w.sum(axis=1)
        votes = (w * (self.y[near] > 0.5)).sum(axis=1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior).astype(np.float64)


def references(docs: DataFrame, labels: DataFrame, per_class: int = REFERENCES) -> tuple[DataFrame, float]:
    """(doc_id, good) of the sample, and the share of good labels among all that may be learnt from."""
    each = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("q"))
    known = each.where(~held_out(F.col("doc_id"))).select("doc_id", (F.col("q") >= 0.5).cast("int").alias("good"))
    share = known.agg(F.avg("good")).first()[0]
    sample = None
    for good in (0, 1):
        part = known.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    return cut(sample), 0.5 if share is None else float(share)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = REFERENCES) -> Votes | None:
    ship(docs.sparkSession)
    sample, prior = references(docs, labels, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [grams(t) for t in b.column("text").to_pylist()]
            at = [np.flatnonzero(x) for x in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("good"), pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array([x[i].astype("<f4").tobytes() for x, i in zip(rows, at, strict=True)], pa.binary())], names=["doc_id", "good", "at", "value"])

    texts = id_text(docs).join(F.broadcast(sample), "doc_id").mapInArrow(run, "doc_id long, good int, at binary, value binary")
    found = sorted(texts.collect(), key=lambda r: (r.doc_id, r.at, r.value))  # at most 2 * per_class labels, sparse
    seen, x, y = set(), [], []
    for r in found:
        if r.doc_id not in seen and len(r.at):  # of repeated ids the first by content
            seen.add(r.doc_id)
            v = np.zeros(BINS + PATTERNS, np.float32)
            v[np.frombuffer(r.at, "<u2")] = np.frombuffer(r.value, "<f4")
            x.append(v)
            y.append(r.good)
    return Votes(np.array(x), np.array(y), prior) if x else None


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scorer(model: Votes | None):
    """Texts to scores, a block of rows at a time."""

    def score(texts: list[bytes | None]) -> np.ndarray:
        if model is None:
            return np.full(len(texts), 0.5)
        return np.concatenate([model.score(np.array([grams(t) for t in texts[i : i + BLOCK]])) for i in range(0, len(texts), BLOCK)] or [np.zeros(0)])

    return score


def scores(docs: DataFrame, labels: DataFrame, per_class: int = REFERENCES) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for b in slices(batches):
            yield rows_out(SCORES, (b.column("doc_id"), score(b.column("text").to_pylist())))

    found = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = REFERENCES) -> DataFrame:
    """The rows of docs with all their columns whose score reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for b in slices(batches):
            yield b.filter(pa.array(score(b.column("text").cast(pa.binary()).to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_votes(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return scores(read("documents"), read("labels"))
