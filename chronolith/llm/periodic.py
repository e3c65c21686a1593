"""Runs of words (maximal periodic stretches) by suffix trees and the smaller half of their leaf lists.

1. A run of MIN words or more, at least twice its period, shows a GRAM-word window again one period later; so every word
   of a run lies in a GRAM-word window that its document has twice. Stretches of such words are all that runs can lie
   in; the windows are compared by hash, so a stretch may hold too much, never too little.
2. Each stretch gets a suffix tree: suffixes sorted by prefix doubling (many stretches at once in numpy, only those
   still tied), depths of inner nodes by Kasai's walk, nodes by one pass with a stack. A node with many children stands
   as a chain of binary ones of the same depth.
3. Stoye and Gusfield: at a node of depth D, for each leaf i of the smaller half, leaf i + D or i - D in the other half
   means that two copies of a D-word string follow one another and that the next word breaks them: a branching repeat.
   Each is found once; all leaf lists together have at most n log n entries and are walked in bounded pieces.
4. A branching repeat ends where its run ends. Rotating it to the left while the words one period apart agree gives the
   run's start. Repeats of one end are taken by rising period; those that a run of a shorter period contains are merged
   into it.

Every document is handled by itself where it lies: no shuffle; memory is a batch of texts or the longest one.

Defined cases: a null or empty text has no words, no runs and four nulls, and both digests are of nothing; a null doc_id
rewrites nothing (it has no decimal form); repeated rows give equal rows; a text of any length is one piece of work of
n log n steps; ties for the longest run go to the smaller start, then period; an empty table gives none; columns but
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Words
from .common import id_text, rows_out, slices
from .lyndon import ragged
from .repeats import mixed

MIN, GRAM = 12, 6
PIECE = 1 << 20  # leaf-list entries looked at together
BITS = 22  # of the table that tells repeated windows

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, end, period


def repeated_words(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word lies in a GRAM-word window that its document has twice; now and then true for others too."""
    cover = np.zeros(len(ids), bool)
    n = len(ids) - GRAM + 1
    if n < 2:
        return cover
    v, h = mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0xD6E8FEB86659FD93) + v[j : n + j]
    h = mixed(h + mixed(doc[:n].astype(np.uint64)))
    whole = doc[:n] == doc[GRAM - 1 :]
    s = np.sort(h[whole])
    known = np.zeros(1 << BITS, bool)
    known[(s[1:][s[1:] == s[:-1]] >> np.uint64(64 - BITS)).astype(np.int64)] = True
    hit = whole & known[(h >> np.uint64(64 - BITS)).astype(np.int64)]
    for j in range(GRAM):
        cover[j : n + j] |= hit
    return cover


def suffix_order(ids: np.ndarray, of: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes of all stretches, stretch by stretch (of: each word's, rising; end: where it ends), sorted; a prefix comes first."""
    n = len(ids)
    key = of * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)  # the first place of each suffix's class
    at, key, width = np.arange(n), key[order], 1
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(new & np.r_[new[1:], True])]
        if not len(at):
            return order
        pos = order[at]
        then = pos + width
        key = rank[pos] * (n + 1) + np.where(then < end[pos], rank[np.minimum(then, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[at], key, width = pos[by], key[by], 2 * width


def depths(ids: np.ndarray, order: np.ndarray, end: np.ndarray, of: np.ndarray) -> list[int]:
    """Words that each suffix shares with the one before it in order (0 across stretches), by Kasai's walk in text order."""
    before = np.full(len(order), -1, np.int64)
    same = of[order[1:]] == of[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    s, end, out, h = ids.tolist(), end.tolist(), [0] * len(order), 0
    for i, (j, at) in enumerate(zip(before.tolist(), place.tolist(), strict=True)):
        if j < 0:
            h = 0
            continue
        most = end[i] - i if i > j else end[j] - j
        while h < most and s[i + h] == s[j + h]:
            h += 1
        out[at] = h
        if h:
            h -= 1
    return out


def nodes(depth: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary inner nodes of depth 1 and more: leaves [first, split) and [split, last) in suffix order meet there."""
    first, last, open_ = [0] * len(depth), [len(depth)] * len(depth), []
    for k, d in enumerate(depth):
        while open_ and depth[open_[-1]] >= d:
            last[open_.pop()] = k
        first[k] = open_[-1] if open_ else 0
        open_.append(k)
    split = np.flatnonzero(np.array(depth))
    return np.array(first)[split], split, np.array(last)[split]


def branching(ids: np.ndarray, of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every tandem repeat whose next word breaks it."""
    order = suffix_order(ids, of, end)
    depth = depths(ids, order, end, of)
    first, split, last = nodes(depth)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    left = split - first <= last - split
    a, size = np.where(left, first, split), np.minimum(split - first, last - split)
    low, high = np.where(left, split, first), np.where(left, last, split)  # the other half
    deep = np.array(depth)[split]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    total, x = np.cumsum(size), 0
    while x < len(size):
        y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + PIECE, "right")))
        node = np.repeat(np.arange(x, y), size[x:y])
        i, d = order[ragged(a[x:y], size[x:y])], deep[node]
        for start, other, inside in ((i, i + d, i + d < end[i]), (i - d, i - d, i - d >= begin[i])):
            p = place[np.where(inside, other, 0)]
            hit = inside & (p >= low[node]) & (p < high[node])
            found.append((start[hit], d[hit]))
        x = y
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def rotated(ids: np.ndarray, begin: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far to the left of each start the words one period apart agree."""
    out, on, width = np.zeros(len(start), np.int64), np.arange(len(start)), 16
    while len(on):
        at = (start[on] - 1 - out[on])[:, None] - np.arange(width)[None, :]
        inside = at >= begin[start[on]][:, None]
        at = np.where(inside, at, 0)
        same = inside & (ids[at] == ids[at + np.where(inside, period[on][:, None], 0)])
        n = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        out[on] += n
        on = on[n == width]
        width = max(1, min(2 * width, PIECE // max(len(on), 1)))
    return out


def maximal(ids: np.ndarray, begin: np.ndarray, start: np.ndarray, period: np.ndarray) -> Runs:
    """Runs of MIN words or more that branching repeats rotate and merge into."""
    end = start + 2 * period
    by = np.lexsort((period, end))
    start, period, end = start[by], period[by], end[by]
    out = []
    while len(end):
        head = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        own = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(end)]))
        s, q = start[head], period[head]
        s = s - rotated(ids, begin, s, q)
        long = end[head] - s >= MIN
        out.append((s[long], end[head][long], q[long]))
        stay = (period % q[own] != 0) | (2 * period > (end[head] - s)[own])
        stay[head] = False
        start, period, end = start[stay], period[stay], end[stay]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def runs(ids: np.ndarray, doc: np.ndarray) -> Runs:
    """All runs of many documents (doc: each word's, rising) by place in ids, ordered by start and period."""
    none = (np.zeros(0, np.int64),) * 3
    cover = repeated_words(ids, doc)
    if not cover.any():
        return none
    edge = np.r_[True, (cover[1:] != cover[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(edge)
    size = np.diff(np.r_[first, len(ids)])
    take = cover[first] & (size >= MIN)
    first, size = first[take], size[take]
    if not len(first):
        return none
    place = ragged(first, size)  # of each word of the stretches in ids
    of = np.repeat(np.arange(len(first)), size)
    own, base = np.unique(ids[place], return_inverse=True)[1].astype(np.int64), np.cumsum(size) - size
    begin, end = base[of], (base + size)[of]
    s, e, q = maximal(own, begin, *branching(own, of, begin, end))
    by = np.lexsort((q, s))
    s, e, q = s[by], e[by], q[by]
    return place[s], place[s] + (e - s), q


def rewriting(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place, where the document's id asks for a periodic tail."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + g % 8)))


OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
OUT_SQL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def described(doc_id: int | None, words: list[bytes], start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple:
    """A document's row: its number of runs, its longest, digests of all and of the words that stay."""
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True))
    best: tuple = (None,) * 4
    if len(start):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        words = [w for w, gone in zip(words, np.cumsum(change)[:-1].tolist(), strict=True) if not gone]
        k = np.lexsort((period, start, start - end))[0]
        s, n, q = int(start[k]), int(end[k] - start[k]), int(period[k])
        best = (s, n, q, 1000 * n // q)
    return doc_id, len(start), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def periodic_runs(docs: DataFrame, rewrite=rewriting) -> DataFrame:
    """Per row: runs of words, the longest one, and the words without what runs repeat. rewrite may rearrange the words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            index, texts, ids = Words(), [], []
            keys = b.column("doc_id").to_pylist()
            for key, raw in zip(keys, b.column("text").to_pylist(), strict=True):
                words = (raw or b"").split()  # bytes are split at exactly 0x20 and 0x09-0x0D
                own = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                at = rewrite(key, len(words)) if rewrite else None
                if at is not None:
                    own, words = own[at], [words[i] for i in at.tolist()]
                texts.append(words)
                ids.append(own)
            size = np.array([len(x) for x in ids])
            base = np.cumsum(size) - size
            s, e, q = runs(np.concatenate(ids), np.repeat(np.arange(len(ids)), size))
            bounds = np.searchsorted(s, np.r_[base, size.sum()])
            rows = [described(key, words, s[x:y] - z, e[x:y] - z, q[x:y]) for key, words, z, x, y in zip(keys, texts, base.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield rows_out(OUT, zip(*rows, strict=True))

    return id_text(docs).mapInArrow(run, OUT_SQL)


def op13_periodic(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
