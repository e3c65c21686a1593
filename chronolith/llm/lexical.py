"""Ranked lexical search: Block-Max WAND over segments of compressed posting blocks.

Index: documents are taken as they lie, in segments of at most SEGMENT bytes of text. A segment holds every term of its
documents, sorted; per term its postings in blocks of BLOCK; per block the last document, the greatest impact and the
place of its bytes (gaps and frequencies as bytes of variable length). An impact is what a posting adds to a score
before the term's weight; it needs the corpus' number of documents and terms, which a pass before the index counts.

Search: queries come in blocks of at most ASK (a stated set, whatever the corpus' size). Document frequencies of their
terms are summed over the segments' dictionaries. Then every segment answers every query of the block: terms are
ordered by their current document; the pivot is the first at which the sum of the terms' greatest impacts reaches the
k-th score so far; the terms up to it move by block ends alone to the blocks that hold the pivot (shallow moves). If
these blocks' greatest impacts don't reach the k-th score, all documents up to the first block end are skipped and
nothing is decompressed; else the blocks are, and all documents up to that end are scored at once. The k-th score
starts at a floor from a few seed segments, an exact search of its own, and goes from segment to segment in a task.
Only what can't reach it is skipped, so ties stay and results are exact.

Memory: a task holds one segment and k results a query; what is broadcast is a block of at most ASK queries with at most
ASK_TERMS terms.

Defined cases: a null text has no terms, is no hit and not counted; a text of any length is one document (a longer one
is a segment of its own); rows with equal or null ids are documents of their own, nulls come last among ties; repeated
or null items each get their results; items without terms and items that no document shares a term with get no row; an
empty table gives none; columns but doc_id, item_id and text are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Words
from .common import cut, id_text, literal_table, numbered, release, rows_out, ship, slices, tidy

SEGMENT, BLOCK = 16 << 20, 128
SEEDS = 2  # segments whose k-th scores are the first floor
ASK, ASK_TERMS = 512, 1 << 18
OPENED = 1 << 14  # blocks of a segment that stay decompressed for the next query
NONE = 1 << 62  # past every document

#: Bytes that stand in terms, A-Z as a-z; all others become spaces, so that split() gives the terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(FOLD).split()


def counted(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = [len(terms(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [sum(map(bool, n))], "l": [sum(n)]})

    r = docs.mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return r[0] or 0, r[1] or 0


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of documents that have it tf times among their `length` terms."""
    m = 50 + (50 * length * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes of 7 bits, the last of a number marked, and where each number ends."""
    size = 1 + sum((x >= 1 << (7 * k)).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[ends[has] - size[has] + k] = (x[has] >> (7 * k)) & 127
    out[ends - 1] |= 128
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    if (raw >= 128).all():
        return (raw & 127).astype(np.int64)
    last = np.flatnonzero(raw >= 128)
    first = np.r_[0, last[:-1] + 1]
    shift = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * shift), first)


class Segment:
    """The postings of some documents, numbered from 0 by rising length, so that the impacts of a block are much alike."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], n: int, total: int):
        by = sorted(range(len(ids)), key=lambda i: len(texts[i] or b""))
        ids, texts = [ids[i] for i in by], [texts[i] for i in by]
        index, flat, lengths = Words(), [], []
        for t in texts:
            words = terms(t)
            flat.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            lengths.append(len(words))
        self.lengths, self.known = np.array(lengths, np.int64), [i is not None for i in ids]
        self.ids = np.array([i or 0 for i in ids], np.int64)
        names = sorted(index)
        self.terms = b" ".join(names)
        place = np.empty(len(names), np.int64)
        place[np.fromiter(map(index.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
        docs = len(ids)
        key = np.sort(place[np.concatenate(flat)] * docs + np.repeat(np.arange(docs), self.lengths)) if flat else np.zeros(0, np.int64)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[new, len(key)])
        term, doc = np.divmod(key[new], max(docs, 1))
        head = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        self.df = np.diff(np.r_[head, len(term)]).astype(np.int32)
        at = np.arange(len(term)) - np.repeat(head, self.df)
        start = np.flatnonzero(at % BLOCK == 0)  # of each block
        size = np.diff(np.r_[start, len(term)])
        gap = np.diff(np.r_[0, doc])
        gap[start] = doc[start] + 1  # of a block's first posting from before all documents
        raw, ends = packed(np.c_[gap, tf].ravel())
        self.raw = raw
        self.offset = np.r_[0, ends[2 * (start + size) - 1]].astype(np.int64 if len(raw) >= 1 << 31 else np.int32) if len(start) else np.zeros(1, np.int64)
        self.last = doc[start + size - 1].astype(np.int32) if len(start) else np.zeros(0, np.int32)
        impact = impacts(tf, self.lengths[doc], n, max(total, 1))
        self.most = np.maximum.reduceat(impact, start).astype(np.int32) if len(start) else np.zeros(0, np.int32)
        self.first = np.r_[0, np.cumsum(-(-self.df // BLOCK))].astype(np.int32)  # block of each term
        self.n, self.total = n, total

    def find(self, wanted: list[bytes]) -> list[int]:
        """Numbers of terms, -1 where the segment lacks them."""
        names = self.terms.split(b" ") if self.terms else []
        out = []
        for w in wanted:
            i = bisect_left(names, w)
            out.append(i if i < len(names) and names[i] == w else -1)
        return out

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block's postings."""
        pairs = unpacked(self.raw[self.offset[b] : self.offset[b + 1]]).reshape(-1, 2)
        doc = np.cumsum(pairs[:, 0]) - 1
        return doc, impacts(pairs[:, 1], self.lengths[doc], self.n, self.total)


class Found:
    """The k best (score, doc_id) of a query so far, nulls last among ties; floor is a score that k documents reach."""

    def __init__(self, k: int, floor: int = 1):
        self.k, self.floor, self.heap = k, max(floor, 1), []

    def take(self, scores: np.ndarray, docs: np.ndarray, segment: Segment) -> None:
        for s, d in zip(scores.tolist(), docs.tolist(), strict=True):
            entry = (s, segment.known[d], -int(segment.ids[d]))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)
        if len(self.heap) == self.k:
            self.floor = max(self.floor, self.heap[0][0])


Opened = dict[int, tuple[list[int], np.ndarray, np.ndarray]]  # blocks that are decompressed: documents, twice, and impacts


def wand(segment: Segment, term: np.ndarray, weight: np.ndarray, found: Found, opened: Opened) -> tuple[int, int]:
    """found takes in a segment's documents for a query's terms that the segment has; blocks read, and blocks in all.

    A block that is read adds its gains to all its documents at once. Up to the border of the documents being scored all
    blocks are read, so scores are whole there; documents that are skipped later keep a part of theirs, which nobody asks for.
    """
    begin, end = segment.first[term].tolist(), segment.first[term + 1].tolist()
    lasts = [segment.last[a:b].tolist() for a, b in zip(begin, end, strict=True)]
    mosts = [(segment.most[a:b].astype(np.int64) * w).tolist() for a, b, w in zip(begin, end, weight.tolist(), strict=True)]
    top, weight = [max(m) for m in mosts], weight.tolist()
    scores = np.zeros(len(segment.ids), np.int64)
    block, current = [0] * len(top), [0] * len(top)  # the block at hand, and a document that no posting left lies before
    read, heap = [-1] * len(top), [(0, i) for i in range(len(top))]  # the last block read
    reads = 0

    def shallow(i: int, doc: int) -> None:
        """To the first block of a term that ends at doc or after it; nothing is read but block ends."""
        at, b = lasts[i], block[i]
        if at[-1] < doc:
            current[i] = NONE
            return
        if at[b] < doc:
            block[i] = b = bisect_left(at, doc, b)
        if read[i] == b:
            docs = opened[begin[i] + b][0]
            current[i] = docs[bisect_left(docs, doc)]
        else:
            current[i] = max(doc, at[b - 1] + 1) if b else doc

    while True:
        # Terms by current document, until their greatest impacts in all reach the floor: the last one's is the pivot.
        taken, reach, pivot = [], 0, NONE
        while heap and reach < found.floor:
            pivot, i = heapq.heappop(heap)
            taken.append(i)
            reach += top[i]
        if reach < found.floor:
            return reads, sum(map(len, lasts))
        while heap and heap[0][0] <= pivot:
            taken.append(heapq.heappop(heap)[1])
        bound, border = 0, NONE
        for i in taken:
            if current[i] < pivot:
                shallow(i, pivot)
            if current[i] < NONE:
                b = block[i]
                bound += mosts[i][b]
                border = min(border, lasts[i][b])
        if border == NONE:  # none of them is left
            continue
        if bound < found.floor:
            # Terms that come in before the border can lift the bound: skip to where the first does that matters.
            while heap and heap[0][0] <= border:
                doc, i = heap[0]
                if bound + top[i] >= found.floor:
                    border = doc - 1
                    break
                bound += top[i]
                taken.append(heapq.heappop(heap)[1])
        else:
            while heap and heap[0][0] <= border:
                taken.append(heapq.heappop(heap)[1])
            for i in taken:
                while current[i] <= border:
                    if read[i] != block[i]:
                        if (b := begin[i] + block[i]) not in opened:
                            docs, impact = segment.block(b)
                            opened[b] = docs.tolist(), docs, impact
                        _, docs, impact = opened[b]
                        scores[docs] += impact * weight[i]
                        read[i] = block[i]
                        reads += 1
                    if lasts[i][block[i]] > border:
                        break
                    shallow(i, lasts[i][block[i]] + 1)
            hit = np.flatnonzero(scores[pivot : border + 1] >= found.floor) + pivot
            if len(hit):
                found.take(scores[hit], hit, segment)
        for i in taken:
            if current[i] <= border:
                shallow(i, border + 1)
            if current[i] < NONE:
                heapq.heappush(heap, (current[i], i))


def segments(docs: DataFrame, n: int, total: int, size: int = SEGMENT) -> DataFrame:
    """(number, segment) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size):
            one = Segment(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), n, total)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([pickle.dumps(one)], pa.binary())})

    return docs.mapInArrow(run, "segment binary").select(F.monotonically_increasing_id().alias("number"), "segment")


def asked(items: DataFrame) -> DataFrame:
    """(number, item_id, term) of the distinct terms of every item that has any; rows with one id have numbers of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(n, i, t) for n, i, raw in zip(*(b.column(c).to_pylist() for c in ("number", "item_id", "text")), strict=True) for t in sorted(set(terms(raw)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["number", "item_id", "term"])

    ship(items.sparkSession)
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return cut(numbered(plain, ["item_id", "text"]).select("number", "item_id", "text").mapInArrow(run, "number long, item_id long, term binary"))


Query = tuple[int, list[bytes], list[int]]  # number, terms, weights


def document_frequencies(segs: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """How many documents have each term of a block of queries."""
    sent = segs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for raw in b.column("segment"):
                one = pickle.loads(raw.as_py())
                at = np.array(one.find(sent.value))
                total[at >= 0] += one.df[at[at >= 0]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "df"])

    found = segs.mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()  # a row per term of the block
    sent.unpersist()
    return {wanted[r["at"]]: r["df"] for r in found}


HITS = "number long, doc_id long, score long"


def search(segs: DataFrame, queries: list[Query], k: int, floors: dict[int, int]) -> DataFrame:
    """At most k hits a query and partition, all that can be among the k best of the segments."""
    wanted = sorted({t for _, ts, _ in queries for t in ts})
    sent = segs.sparkSession.sparkContext.broadcast((queries, wanted, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted, floors = sent.value
        place = {t: i for i, t in enumerate(wanted)}
        own = [(number, np.array([place[t] for t in ts]), np.array(ws, np.int64), Found(k, floors.get(number, 1))) for number, ts, ws in queries]
        for b in batches:
            for raw in b.column("segment"):
                one = pickle.loads(raw.as_py())
                at, opened = np.array(one.find(wanted)), {}
                for _, ts, ws, found in own:
                    has = (at[ts] >= 0) & (ws > 0)
                    if has.any():
                        wand(one, at[ts][has], ws[has], found, opened)
                    if len(opened) > OPENED:
                        opened.clear()
        rows = [(number, -d if known else None, s) for number, _, _, found in own for s, known, d in found.heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["number", "doc_id", "score"])
        tidy()

    return segs.mapInArrow(run, HITS)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best a query: first within parts of the hits, so that no task gets what all partitions found for a query."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = hits.withColumn("part", F.spark_partition_id() % 64)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("number", "part").orderBy(*order))).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def blocks(items: DataFrame) -> Iterator[tuple[list[int], DataFrame]]:
    """Item terms in blocks of at most ASK items and ASK_TERMS terms (or one item)."""
    counts = items.groupBy("number").agg(F.count("*").alias("n"))
    spans = counts.withColumn("block", F.floor(F.col("number") / ASK)).groupBy("block").agg(F.min("number").alias("a"), F.max("number").alias("b"), F.sum("n").alias("n"))
    todo = [(r["a"], r["b"], r["n"]) for r in spans.orderBy("block").toLocalIterator()]
    while todo:
        a, b, n = todo.pop(0)
        own = items.where(F.col("number").between(a, b))
        if n > ASK_TERMS and a < b:
            half = (a + b) // 2
            todo = [(x, y, own.where(F.col("number").between(x, y)).count()) for x, y in ((a, half), (half + 1, b))] + todo
        elif n:
            yield own


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of every item, ties by doc_id."""
    spark = docs.sparkSession
    docs = id_text(docs)
    n, total = counted(docs)
    segs = cut(segments(docs, n, total))
    seeds = [r["number"] for r in segs.select("number").orderBy(F.xxhash64("number"), "number").limit(SEEDS).collect()]
    ask = asked(items)
    out = []
    for own in blocks(ask):
        rows = own.select("number", "term").collect()  # a block of queries
        df = document_frequencies(segs, sorted({bytes(r["term"]) for r in rows}))
        grouped: dict[int, Query] = {}
        for r in sorted(rows):
            if t := df.get(bytes(r["term"])):
                q = grouped.setdefault(r["number"], (r["number"], [], []))
                q[1].append(bytes(r["term"]))
                q[2].append(math.floor(1000 * math.log((2 * n + 2) / (2 * t + 1))))
        queries = list(grouped.values())
        if not queries:
            continue
        first = best(search(segs.where(F.col("number").isin(seeds)), queries, k, {}), k)
        floors = {r["number"]: r["score"] for r in first.where(F.col("rank") == k).collect()}  # a row per query
        hits = cut(best(search(segs, queries, k, floors), k))
        release(spark)
        out.append(hits.join(F.broadcast(own.select("number", "item_id").distinct()), "number"))  # a block of queries
    if not out:
        return literal_table(spark, [], "item_id: bigint, rank: int, doc_id: bigint, score: bigint")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
dl AS (SELECT r, doc_id, CAST(len(ts) AS HUGEINT) AS n FROM d WHERE len(ts) > 0),
g AS (SELECT CAST(count(*) AS HUGEINT) AS docs, CAST(sum(n) AS HUGEINT) AS total FROM dl),
q AS (SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS t FROM benchmark)),
tf AS (SELECT r, t, CAST(count(*) AS HUGEINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS HUGEINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), g),
c AS (SELECT r, doc_id, t, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)) AS c FROM tf JOIN dl USING (r), g),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * c) AS BIGINT) AS score FROM q JOIN c USING (t) JOIN w USING (t) GROUP BY i, item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""
