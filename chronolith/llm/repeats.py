"""Removal of repeated byte strings across a corpus by suffix arrays.

A byte goes if a WINDOW-byte string that covers it also starts earlier (smaller doc_id, or same document and earlier
start). Suffix arrays are built where strings can repeat at all:

1. Anchors. Of every window, the GRAM-byte substring with the least hash is its anchor; it depends on the window's
   bytes alone, so equal windows have equal anchors at equal offsets. About one byte in 33 starts an anchor. An
   anchor's context is the stretch of the windows that have this anchor.
2. Classes. Anchors meet by the hash of their gram. Occurrences whose whole context is the same form a class; all but
   its first occurrence are covered. This is done within each batch of texts before the shuffle, so many copies leave
   few rows, and again after it, over rows that come sorted, of which none need be held.
3. Suffix order. Where one gram has several contexts, the first occurrence of each is fetched, and linear grouping
   (lyndon.suffix_arrays) sorts the suffixes of these contexts. Runs of neighbours that share WINDOW bytes are equal
   windows; all but the earliest are covered. Larger sets of contexts are first parted by the bytes in their middle.
4. Grams with over HOT contexts in all (a phrase that every third text has) are fetched too, but their windows meet by
   their own hash, so that no task holds the contexts of such a gram.

Grams and contexts are compared by pairs of independent 64-bit hashes, windows of the suffix order by their bytes.

Every row takes part. Its place in the order is (doc_id, part), of which part lies in the upper half of the long that
holds a start: zero for an id with one text, else a number by (doc_id, text hash) that only rows with repeated or null
ids get.

Defined cases: a null text is empty; texts shorter than WINDOW stay; rows with a null doc_id come after all others, by
text hash; equal rows of one doc_id count as one text and lose the same bytes; different texts under one doc_id come
in order of their hashes; texts of any length are read in overlapping pieces; an empty table gives none; columns of any
name go through as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, release, rows_out, ship, shuffle_partitions, slices, small_join, tidy
from .lyndon import ragged, suffix_arrays

WINDOW, GRAM = 100, 36
REACH = WINDOW - GRAM  # a window starts at most so far before its anchor
PIECE = 1 << 20  # bytes of a text hashed at once
BATCH = 16 << 20  # bytes of text whose equal contexts are combined before the shuffle
HOT = 1024  # contexts of a gram beyond which its windows meet by their own hash
LANE = 48  # contexts that are sorted together
PART = 32  # bits of a start; above them lies the part of its document
FLAT = 1 << 19  # symbols sorted in step: their arrays stay near the processor


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value per byte, and powers of an odd factor and of its inverse modulo 2^64."""
    n = PIECE + 2 * WINDOW
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factor = 0xD6E8FEB86659FD93
    up, down = np.full(n, factor, np.uint64), np.full(n, pow(factor, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hashed:
    """A text of at most PIECE + 2 * WINDOW bytes whose substrings hash in constant time."""

    def __init__(self, b: np.ndarray):
        values, up, self.down = powers()
        self.n = len(b)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(values[b] * up[: len(b)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self) -> np.ndarray:
        return mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: self.n - GRAM + 1])


def anchors(h: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every gram that is the least (the first of equals) of any window: start, hash, start and end of its context."""
    if h.n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = h.grams()
    low = np.uint64((1 << 21) - 1)
    least = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH + 1:
        least = np.minimum(least[: len(least) - (REACH + 1 - width)], least[REACH + 1 - width :])
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # windows of one anchor follow one another
    last = np.r_[first[1:], len(at)] - 1 + WINDOW
    at = at[first]
    return at, g[at], first, last


def pieces(b: np.ndarray) -> Iterator[tuple[int, Hashed]]:
    """Overlapping pieces such that each context lies within the piece that finds its anchor, and their places."""
    if len(b) <= PIECE:
        yield 0, Hashed(b)
        return
    step = PIECE - 2 * WINDOW
    for start in range(0, len(b), step):
        yield start, Hashed(b[max(0, start - WINDOW) : start + step + 2 * WINDOW])


def contexts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor of a text: gram hash, context hash, start and end of its context, place of the anchor in it."""
    out = []
    for start, h in pieces(b):
        base = max(0, start - WINDOW) if start else 0
        at, gram, first, last = anchors(h)
        sure = np.ones(len(at), bool)
        if base:  # what the piece's own ends may cut off belongs to its neighbours
            sure &= at >= REACH
        if base + h.n < len(b):
            sure &= at + WINDOW <= h.n
        at, gram, first, last = at[sure], gram[sure], first[sure], last[sure]
        left = at - first
        ctx = mixed(h.of(first, last) + left.astype(np.uint64) * np.uint64(1_000_003) + (last - at).astype(np.uint64))
        out.append((gram, ctx, first + base, last + base, left))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def batch_contexts(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Gram, context, doc_id, start and end of the context and place of the anchor in it, of all anchors of a batch."""
    texts = [np.frombuffer(t or b"", np.uint8) for t in b.column("text").to_pylist()]
    ids = b.column("doc_id").to_numpy(zero_copy_only=False)
    upper = b.column("part").to_numpy(zero_copy_only=False).astype(np.int64) << PART
    parts = [contexts(t) for t in texts]
    row = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    gram, ctx, first, last, left = (np.concatenate(x) for x in zip(*parts, strict=True))
    return gram, ctx, ids[row], first + upper[row], last + upper[row], left


def firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, where runs of equal keys (but for the last two) begin in it, and each row's run."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys[:-2]:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, new, np.cumsum(new) - 1


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans, per document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # Between the ends so far of one document and the next document's there is no order, so ends are ranked within each.
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    base = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(doc)]))
    by_end = np.lexsort((end, base))
    rank = np.empty(len(end), np.int64)
    rank[by_end] = np.arange(len(end))
    reach = end[by_end][np.maximum.accumulate(rank)]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(doc) - 1]
    return doc[new], start[new], reach[last]


ROWS = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("ctx", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("last", pa.int64())])
ROWS_SQL = "key long, kind int, ctx long, doc_id long, at long, last long"
#: Kinds of rows: an anchor, a context whose windows are wanted by hash, a span known to be covered, a context wanted for
#: suffix order. Of all but spans, kind also holds the anchor's place in the context, times KINDS.
ANCHOR, HOT_CONTEXT, COVERED, WANTED, KINDS = 0, 1, 2, 3, 4


def split_runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first of equal keys (but for the last two, document and place), and rows that come after one."""
    order, new, run_of = firsts(*keys)
    lead = order[new][run_of]
    doc, at = keys[-2:]
    return order[new], order[~new & ((doc[order] != doc[lead]) | (at[order] != at[lead]))]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """Rows of the first pass: per batch, each context once; what it repeats is covered already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BATCH):
            gram, ctx, doc, at, last, left = batch_contexts(b)
            k, late = split_runs(gram, ctx, doc, at)
            d, s, e = merged(doc[late], at[late], last[late])
            out = [
                (gram[k].view(np.int64), ANCHOR + left[k] * KINDS, ctx[k].view(np.int64), doc[k], at[k], last[k]),
                (mixed(d.view(np.uint64) + np.uint64(1)).view(np.int64), np.full(len(d), COVERED), np.zeros(len(d), np.int64), d, s, e),
            ]
            yield rows_out(ROWS, [np.concatenate(c) for c in zip(*out, strict=True)])

    return docs.mapInArrow(run, ROWS_SQL)


def keyed_stream(batches: Iterator[pa.RecordBatch], columns: list[str], least: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first one, in blocks of `least` rows or more that never part equal keys."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
        n += b.num_rows
        if n >= least:
            block = [np.concatenate(c) for c in zip(*held, strict=True)]
            at = int(np.searchsorted(block[0], block[0][-1]))
            if at:
                yield [c[:at] for c in block]
            held, n = [[c[at:] for c in block]], len(block[0]) - at
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]
    held = []
    tidy()


def resolved(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Covered spans, and the contexts that are wanted: by windows where a gram has over `hot` contexts, else for suffix order.

    Rows come sorted, so that of a gram only its first `hot` contexts are ever held.
    """
    names = [f.name for f in ROWS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # key, kind, ctx, doc, at of the run that goes on
        held = [np.zeros(0, np.int64) for _ in names]  # contexts of the last key, which wait for its number of them
        spent = None  # a key known to be hot, whose contexts don't wait

        def wanted(rows: list[np.ndarray], final: bool) -> tuple[np.ndarray, ...]:
            """First contexts in order of their keys -> those of keys that have several; the last key may go on."""
            nonlocal held, spent
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            key = rows[0]
            if not len(key):
                return tuple(rows)
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n = np.diff(np.r_[heads, len(key)])
            if spent is not None and key[0] == spent:
                n[0] += hot  # what has gone already
            many = np.repeat(n, np.diff(np.r_[heads, len(key)]))
            stay = np.zeros(len(key), bool)
            spent = key[-1] if n[-1] > hot else None
            if not final and spent is None:
                stay[heads[-1] :] = True
            held = [c[stay] for c in rows]
            go = ~stay & (many > 1)
            kind = np.where(many > hot, HOT_CONTEXT, WANTED)[go]
            return rows[0][go], rows[1][go] - ANCHOR + kind, *(c[go] for c in rows[2:])

        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            known = rows[1] == COVERED
            out = [tuple(c[known] for c in rows)]
            key, kind, ctx, doc, at, last = rows = [c[~known] for c in rows]
            if len(key):
                new = np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (ctx[1:] != ctx[:-1])]
                if lead is not None and lead[:3] == (key[0], kind[0], ctx[0]):
                    new[0] = False
                run_of = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
                of_doc, of_at = (np.where(run_of < 0, 0 if lead is None else lead[3 + i], c[run_of]) for i, c in enumerate((doc, at)))
                late = ~new & ((doc != of_doc) | (at != of_at))
                d, s, e = merged(doc[late], at[late], last[late])
                out.append((np.zeros(len(d), np.int64), np.full(len(d), COVERED), np.zeros(len(d), np.int64), d, s, e))
                lead = (key[-1], kind[-1], ctx[-1], of_doc[-1], of_at[-1])
                out.append(wanted([c[new] for c in rows], False))
            yield rows_out(ROWS, [np.concatenate(c) for c in zip(*out, strict=True)])
        yield rows_out(ROWS, wanted([np.zeros(0, np.int64) for _ in names], True))
        tidy()

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "kind", "ctx", "doc_id", "at").mapInArrow(run, ROWS_SQL)


CONTEXTS = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("left", pa.int32()), ("bytes", pa.binary())])


def hot_windows(text: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the start of every window of the given contexts of a text."""
    starts, out = np.unique(ragged(at, last - at - WINDOW + 1)), []
    for base, h in pieces(text):
        base = max(0, base - WINDOW) if base else 0
        s = starts[(starts >= base) & (starts + WINDOW <= base + h.n)]
        w = h.of(s - base, s - base + WINDOW)
        out.append((w, mixed(w ^ h.of(s - base, s - base + WINDOW // 2)), s))
    w, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return w.view(np.int64), c.view(np.int64), s


def wanted_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of every context that is wanted for suffix order (left: how far its anchor is from its start), and hashes of
    the windows of the others (left -1), each once per batch of texts; those that repeat in a batch are spans (left -2, ctx: end)."""
    own = F.shiftright("at", PART).cast("int").alias("part")
    place = [F.col(c).bitwiseAND(F.lit((1 << PART) - 1)).alias(c) for c in ("at", "last")]
    asked = wanted.select("doc_id", own, F.struct("key", "kind", *place).alias("a")).groupBy("doc_id", "part").agg(F.collect_list("a").alias("asked"))  # at most one in 33 bytes of a text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in slices(batches, BATCH):
            hot = []
            for doc, part, text, asked in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "text", "asked")), strict=True):
                if (doc, part) == before:  # equal rows follow one another
                    continue
                before, upper = (doc, part), part << PART
                rows = [(a["key"], 0, doc, a["at"] + upper, a["kind"] // KINDS, text[a["at"] : a["last"]]) for a in asked if a["kind"] % KINDS == WANTED]
                if rows:
                    yield rows_out(CONTEXTS, zip(*rows, strict=True))
                more = [(a["at"], a["last"]) for a in asked if a["kind"] % KINDS == HOT_CONTEXT]
                if more:
                    w, c, s = hot_windows(np.frombuffer(text, np.uint8), *np.array(more, np.int64).T)
                    hot.append((w, c, np.full(len(s), doc), s + upper))
            if hot:
                w, c, d, s = (np.concatenate(x) for x in zip(*hot, strict=True))
                k, late = split_runs(w, c, d, s)
                yield rows_out(CONTEXTS, (w[k], c[k], d[k], s[k], np.full(len(k), -1), pa.nulls(len(k), pa.binary())))
                d, s, e = merged(d[late], s[late], s[late] + WINDOW)
                yield rows_out(CONTEXTS, (mixed(d.view(np.uint64)).view(np.int64), e, d, s, np.full(len(d), -2), pa.nulls(len(d), pa.binary())))

    return docs.join(asked, ["doc_id", "part"]).select("doc_id", "part", "text", "asked").mapInArrow(run, "key long, ctx long, doc_id long, start long, left int, bytes binary")


Context = tuple[int, int, bytes, int]  # doc_id, start, bytes, left


def parted(group: list[Context], lane: int = LANE, low: int = -REACH, high: int = 0) -> Iterator[tuple[bool, list[Context]]]:
    """Sets of contexts in which every two with a common window meet, and whether a set is of one equal window.

    Windows start at low to high from the anchor. A set of over `lane` contexts is halved by these starts: windows of a
    half share the bytes in their middle, which part the set, down to single windows.
    """
    if len(group) <= lane:
        if len(group) > 1:
            yield False, group
        return
    if low == high:
        yield True, group
        return
    half = (low + high) // 2
    for a, b in ((low, half), (half + 1, high)):
        parts: dict[bytes, list[Context]] = {}
        for doc, start, text, left in group:
            first, last = max(a, -left), min(b, len(text) - left - WINDOW)
            if first <= last:
                parts.setdefault(text[left + b : left + a + WINDOW], []).append((doc, start + left + first, text[left + first : left + last + WINDOW], -first))
        for part in parts.values():
            yield from parted(part, lane, a, b)


def equal_covered(group: list[Context]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered spans of contexts that are one equal window."""
    first = min(c[:2] for c in group)
    late = np.array([c[:2] for c in group if c[:2] != first], np.int64).reshape(-1, 2)
    return merged(late[:, 0], late[:, 1], late[:, 1] + WINDOW)


def lanes_covered(lanes: list[list[Context]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered spans by the suffix order of each lane's contexts."""
    sizes = np.array([len(t) for lane in lanes for _, _, t, _ in lane])
    count = np.array([len(lane) for lane in lanes])
    doc = np.array([d for lane in lanes for d, _, _, _ in lane], np.int64)
    start = np.array([s for lane in lanes for _, s, _, _ in lane], np.int64)
    text = np.frombuffer(b"".join(t for lane in lanes for _, _, t, _ in lane), np.uint8)
    # A mark stands before each context, less than all bytes and falling, so that no word runs into the next context.
    first = np.cumsum(sizes + 1) - (sizes + 1)
    flat = np.empty(int((sizes + 1).sum()), np.int64)
    marks = np.repeat(count, count) - 1 - (np.arange(len(sizes)) - np.repeat(np.cumsum(count) - count, count))
    flat[first] = marks
    body = ragged(first + 1, sizes)
    flat[body] = text.astype(np.int64) + int(count.max())
    length = np.add.reduceat(sizes + 1, np.cumsum(count) - count)
    order = suffix_arrays(flat, length)
    of = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(len(flat)) - first[of] - 1
    whole = (offset >= 0) & (offset + WINDOW <= sizes[of])
    order = order[whole[order]]
    lane = np.repeat(np.arange(len(lanes)), count)[of[order]]
    # Neighbours in suffix order share a window if their first bytes agree; compared eight bytes at a time.
    raw = np.zeros(len(flat) + 8, np.uint8)
    raw[body] = text
    words = np.lib.stride_tricks.as_strided(raw, (len(flat), 8), (1, 1))
    same = np.flatnonzero(lane[1:] == lane[:-1])
    for k in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        left, right = words[order[same] + k], words[order[same + 1] + k]
        same = same[(left == right).all(axis=1)]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    run = np.cumsum(new) - 1
    d, s = doc[of[order]], start[of[order]] + offset[order]
    by = np.lexsort((s, d, run))
    head = by[np.flatnonzero(np.r_[True, run[by][1:] != run[by][:-1]])] if len(by) else by
    late = (d != d[head][run]) | (s != s[head][run])
    return merged(d[late], s[late], s[late] + WINDOW)


SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("last", pa.int64())])


def sorted_spans(found: DataFrame) -> DataFrame:
    """Covered spans among contexts that share a gram: contexts of one key meet, many keys are sorted in step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list[list[Context]], list[int]]] = {}  # lanes of like length end together
        for key, ctx, doc, start, left, text in keyed_stream(batches, ["key", "ctx", "doc_id", "start", "left", "bytes"], 1 << 14):
            known = left == -2
            yield rows_out(SPANS, (doc[known], start[known], ctx[known]))
            by_hash = left == -1
            if by_hash.any():
                _, late = split_runs(*(c[by_hash] for c in (key, ctx, doc, start)))
                d, s = doc[by_hash][late], start[by_hash][late]
                yield rows_out(SPANS, merged(d, s, s + WINDOW))
            key, doc, start, left, text = (c[left >= 0] for c in (key, doc, start, left, text))
            if not len(key):
                continue
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                for equal, group in parted(list(zip(doc[a:b].tolist(), start[a:b].tolist(), text[a:b], left[a:b].tolist(), strict=True))):
                    if equal:
                        yield rows_out(SPANS, equal_covered(group))
                        continue
                    lanes, sizes = waiting.setdefault(len(group).bit_length(), ([], []))
                    lanes.append(group)
                    sizes.append(sum(len(c[2]) + 1 for c in group))
                    if len(sizes) % 64 == 0 and sum(sizes) >= FLAT:
                        yield rows_out(SPANS, lanes_covered(lanes))
                        lanes.clear()
                        sizes.clear()
        for lanes, _ in waiting.values():
            if lanes:
                yield rows_out(SPANS, lanes_covered(lanes))

    n = shuffle_partitions(found.sparkSession)
    return found.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, start long, last long")


def placed(docs: DataFrame) -> DataFrame:
    """Every row of docs: its columns but the text in a struct row, doc_id and part (its place in the order) and text, null
    if it was. Only rows with null ids or with ids of several texts get a part, so others need no join."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() != "text"]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    raw = F.col("text").cast("binary")
    h = F.xxhash64(F.coalesce(raw, F.lit("").cast("binary")))
    none, last = F.col("doc_id").isNull().alias("none"), F.lit((1 << 63) - 1)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"))
    several = ids.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("doc_id is null or lo <> hi")
    several = cut(several.select(none, F.coalesce("doc_id", last).alias("doc_id")))
    d = docs.select(row.alias("row"), none, F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), raw.alias("text"))
    if several.isEmpty():
        return d.select("row", "doc_id", F.lit(0).alias("part"), "text")
    odd = small_join(ids.select(none, F.coalesce("doc_id", last).alias("doc_id"), "h"), several, ["none", "doc_id"], "left_semi").distinct()
    odd = cut(numbered(odd, ["none", "doc_id", "h"]).withColumn("part", (F.col("number") + 1).cast("int")).drop("number"))
    d = small_join(d.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("").cast("binary")))), odd, ["none", "doc_id", "h"], "left")
    return d.select("row", "doc_id", F.coalesce("part", F.lit(0)).alias("part"), "text")


def covered_spans(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """texts(doc_id, part, text) -> (doc_id, start, last) whose union is what every document loses; part is in start and last."""
    spark = texts.sparkSession
    texts = texts.select("doc_id", "part", F.coalesce("text", F.lit("").cast("binary")).alias("text"))
    rows = cut(resolved(anchor_rows(texts), hot))
    release(spark)
    kind = F.col("kind") % KINDS
    spans = cut(sorted_spans(wanted_contexts(texts, rows.where(kind.isin(WANTED, HOT_CONTEXT)))))
    release(spark)
    return rows.where(kind == COVERED).select("doc_id", F.col("at").alias("start"), "last").unionByName(spans)


KEPT = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def hex_digest(kept: bytes) -> bytes:
    return hashlib.sha256(kept).hexdigest().encode()


def whole_letters(kept: bytes) -> bytes:
    """Without the parts of letters that a cut inside a letter leaves."""
    return kept.decode("utf-8", "ignore").encode()


def without_repeats(docs: DataFrame, shape: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """Every row of docs: its columns but the text in a struct row, n_bytes, n_removed, n_spans, kept (shape of the bytes
    that stay; null texts are empty ones) and whether the text was null."""
    rest = [c for c in docs.columns if c.lower() != "text"]
    names = [f"c{i}" for i in range(len(rest))]
    d = placed(docs)
    place = [F.col(c).bitwiseAND(F.lit((1 << PART) - 1)).alias(c) for c in ("start", "last")]
    spans = covered_spans(d).select("doc_id", F.shiftright("start", PART).cast("int").alias("part"), F.struct(*place).alias("s"))
    spans = spans.groupBy("doc_id", "part").agg(F.collect_list("s").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                text = text or b""
                s = np.array([(x["start"], x["last"]) for x in spans or []], np.int64).reshape(-1, 2)
                _, start, last = merged(np.zeros(len(s), np.int64), s[:, 0], s[:, 1])
                kept = b"".join(text[a:z] for a, z in zip([0, *last.tolist()], [*start.tolist(), len(text)], strict=True))
                rows.append((len(text), len(text) - len(kept), len(start), shape(kept)))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("none"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), KEPT, strict=True))], names=["row", "none", *KEPT.names])

    found = d.join(spans, ["doc_id", "part"], "left").select("row", F.col("text").isNull().alias("none"), "text", "spans")
    kind = d.schema["row"].dataType.simpleString()
    out = found.mapInArrow(run, f"row {kind}, none boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("row", F.struct(*[F.col(f"row.{n}").alias(c) for c, n in zip(rest, names, strict=True)]))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with their columns and what stays of their texts; n_chars follows if it is there. A text that
    loses all goes."""
    found = without_repeats(docs, whole_letters).where("n_removed = 0 or octet_length(kept) > 0")
    text = F.when(~F.col("none"), F.col("kept").cast("string"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op2_repeats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = without_repeats(docs.select("doc_id", "text"), hex_digest)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
