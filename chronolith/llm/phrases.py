"""Removal of word passages that documents share, by automata of repeated phrases.

A word goes if a WINDOW-word window that covers it also starts in a document with a smaller doc_id.

1. Anchors. Of every window the GRAM-word piece with the least hash is its anchor, so equal windows have equal anchors;
   about one word in five starts one. An anchor's context is the stretch of the windows that have it. Anchors meet by
   hash, one entry per batch of texts, and those of several documents recur; only their contexts can hold a repeat.
2. Passages are the recurring contexts of a document, joined where they touch. They meet by their least anchor, so
   copies and near copies do, in bounded units. Of a unit, windows that a later document has too are confirmed by their
   words, compiled into an Aho-Corasick automaton (a letter a word) with the first document of each, and all passages
   of the unit are streamed through it: every occurrence in a later document is found. Equal passages of one batch of
   texts are settled the same way before the shuffle, so of many copies a row a batch goes on.
3. Shards. What a unit leaves open meets by anchor, context by context, sorted by document; each bounded run of anchors
   is a unit again, with an automaton of its own. Contexts of an anchor that over HOT places have meet by the hash of
   each window instead, so that no unit needs all of them.

So each automaton is bounded, each document is streamed through those shards only that can hold a phrase of its own, and
hashes choose where words are compared, but never decide.

Defined cases: a null text has no words; texts of fewer than WINDOW words stay; a null doc_id counts as greater than
every other, and documents with equal or null ids don't take words from one another; repeated rows lose the same words;
a passage of any length is cut into pieces that share WINDOW - 1 words; an empty table gives none; columns of any name
go through as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, rows_out, salted_join, shuffle_partitions, slices, small_join, tidy
from .lyndon import ragged
from .repeats import merged, mixed, placed

WINDOW, GRAM = 13, 5
BATCH = 8 << 20  # bytes of text whose anchors are combined before the shuffle
UNIT = 200_000  # words whose windows one automaton is made of
HOT = 4096  # places of an anchor beyond which windows meet by their own hash
SALTS = 64  # parts over which passages with a crowded least anchor are dealt
SPREAD = 4  # hash ranges a task takes in turn
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Split:
    """The words of some texts: where they start and end in raw, the text each is of, and a hash of each."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        self.raw = b"\n".join([*texts, b""]) + b"\n" + bytes(8)
        b = np.frombuffer(self.raw, np.uint8)[: len(self.raw) - 8]
        space = SPACE[b]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = edge if space[0] else np.r_[0, edge]
        self.start, self.end = edge[0::2], edge[1::2]
        base = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.text = np.searchsorted(base, self.start, "right") - 1
        self.first = np.searchsorted(self.start, base)  # word of each text
        self.hash = self.hashed()

    def hashed(self) -> np.ndarray:
        """64 bits a word, of eight bytes at a time."""
        eights = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
        size = self.end - self.start
        out = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        on, done = np.arange(len(size)), 0
        while len(on):
            left = np.minimum(size[on] - done, 8)
            part = eights[self.start[on] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left.astype(np.uint64)))
            out[on] = mixed(out[on] * np.uint64(0xD6E8FEB86659FD93) + part)
            done += 8
            on = on[size[on] > done]
        return out

    def words(self, a: int, b: int) -> list[bytes]:
        return self.raw[self.start[a] : self.end[b - 1]].split()

    def grams(self, n: int) -> np.ndarray:
        """A hash of the n words from each word on."""
        m = max(len(self.hash) - n + 1, 0)
        out = np.zeros(m, np.uint64)
        for j in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : m + j]
        return mixed(out)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every anchor: hash (even), first word and end of its context."""
        m = len(self.hash) - WINDOW + 1
        none = np.zeros(0, np.int64)
        if m < 1:
            return none.astype(np.uint64), none, none
        g = self.grams(GRAM)
        reach = WINDOW - GRAM + 1
        least = g[:m].copy()
        for j in range(1, reach):
            np.minimum(least, g[j : m + j], out=least)
        at = np.zeros(m, np.int64)
        for j in range(reach - 1, -1, -1):  # the first of equals
            at[g[j : m + j] == least] = j
        window = np.flatnonzero(self.text[:m] == self.text[WINDOW - 1 :])
        if not len(window):
            return none.astype(np.uint64), none, none
        at = window + at[window]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[new[1:] - 1, len(at) - 1]
        return g[at[new]] & ~np.uint64(1), window[new], window[last] + WINDOW


PLACES = "spot int, hash binary, doc binary, part binary, n binary"
FOUND = pa.schema([("kind", pa.int32()), ("hash", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32())])
FOUND_SQL = "kind int, hash long, doc_id long, part int"
#: Kinds: a place of a recurring anchor; an anchor of over HOT places.
RECURS, CROWDED = 0, 1


def anchor_places(texts: DataFrame, spots: int) -> DataFrame:
    """Per batch and hash range: anchors with their first document and number of places; of an anchor that several
    documents of a batch have, the others too, spread by document (n 0), as it is known to recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BATCH):
            split = Split(b.column("text").to_pylist())
            ids, parts = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "part"))
            h, first, _ = split.anchors()
            if not len(h):
                continue
            d, p = ids[split.text[first]], parts[split.text[first]]
            by = np.lexsort((p, d, h))
            h, d, p = h[by], d[by], p[by]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n = np.diff(np.r_[head, len(h)])
            rest = np.flatnonzero(np.r_[False, (h[1:] == h[:-1]) & ((d[1:] != d[:-1]) | (p[1:] != p[:-1]))])
            several = np.zeros(len(h), bool)
            several[rest] = True
            several = np.maximum.reduceat(several, head)
            # A negative count tells that the batch has the anchor in several documents.
            h, d, p, n = np.r_[h[head], h[rest]], np.r_[d[head], d[rest]], np.r_[p[head], p[rest]], np.r_[np.where(several, -n, n), np.zeros(len(rest), np.int64)]
            spot = (np.where(n == 0, mixed(d.astype(np.uint64) + p.astype(np.uint64)), h) >> np.uint64(40)).astype(np.int64) % spots
            by = np.argsort(spot, kind="stable")
            h, d, p, n, spot = h[by], d[by], p[by].astype(np.int32), n[by].astype(np.int32), spot[by]
            at = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]])
            rows = [(int(spot[x]), h[x:y].tobytes(), d[x:y].tobytes(), p[x:y].tobytes(), n[x:y].tobytes()) for x, y in zip(at.tolist(), [*at[1:].tolist(), len(h)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["spot", "hash", "doc", "part", "n"])

    return texts.mapInArrow(run, PLACES)


def recurring(places: DataFrame, hot: int, spots: int) -> DataFrame:
    """(kind, hash, doc_id, part): places of anchors that several documents have, and anchors of over `hot` places."""

    def resolved(rows: list[tuple]) -> pa.RecordBatch:
        h, d, p, n = (np.frombuffer(b"".join(c), t) for c, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int32, np.int32), strict=True))
        known = n == 0
        out = [(np.zeros(int(known.sum()), np.int32) + RECURS, h[known], d[known], p[known])]
        h, d, p, n = h[~known], d[~known], p[~known], n[~known]
        if len(h):
            by = np.argsort(h, kind="stable")
            h, d, p, n = h[by], d[by], p[by], n[by]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[head, len(h)])
            many = (np.maximum.reduceat(d, head) > np.minimum.reduceat(d, head)) | (np.minimum.reduceat(n, head) < 0)
            crowd = head[many & (np.add.reduceat(np.abs(n).astype(np.int64), head) > hot)]
            take = np.repeat(many, size)
            out.append((np.zeros(int(take.sum()), np.int32) + RECURS, h[take], d[take], p[take]))
            out.append((np.zeros(len(crowd), np.int32) + CROWDED, h[crowd], d[crowd], p[crowd]))
        kind, h, d, p = (np.concatenate(c) for c in zip(*out, strict=True))
        return rows_out(FOUND, (kind, h.view(np.int64), d, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, held = None, []
        for b in batches:
            for s, *row in zip(*(b.column(c).to_pylist() for c in ("spot", "hash", "doc", "part", "n")), strict=True):
                if s != spot and held:
                    yield resolved(held)
                    held = []
                spot = s
                held.append(row)
        if held:
            yield resolved(held)
        tidy()

    return places.repartition(spots // SPREAD, "spot").sortWithinPartitions("spot").mapInArrow(run, FOUND_SQL)


class Letters(dict):
    """A letter for each word as it comes, surrogates left out."""

    def __missing__(self, word: bytes) -> str:
        n = len(self) + 1
        self[word] = letter = chr(n if n < 0xD800 else n + 0x800)
        return letter


Passage = tuple[int, list[bytes]]  # doc_id, words


def located(passages: list[Passage]) -> list[list[int]]:
    """Of each passage (sorted by doc_id) the starts of its windows that a passage of a smaller doc_id has too."""
    letters = Letters()
    lines = ["".join(map(letters.__getitem__, words)) for _, words in passages]
    first: dict[str, int] = {}
    confirmed: dict[str, int] = {}
    for (doc, _), line in zip(passages, lines, strict=True):
        for i in range(len(line) - WINDOW + 1):
            if (own := first.setdefault(w := line[i : i + WINDOW], doc)) != doc:
                confirmed[w] = own
    if not confirmed:
        return [[] for _ in passages]
    automaton = ahocorasick.Automaton()
    for w, doc in confirmed.items():
        automaton.add_word(w, doc)
    automaton.make_automaton()
    return [[end - WINDOW + 1 for end, own in automaton.iter(line) if own < doc] for (doc, _), line in zip(passages, lines, strict=True)]


def joined(starts: list[int]) -> Iterator[tuple[int, int]]:
    """Rising starts of windows as spans of words."""
    at = end = None
    for s in starts:
        if end is None or s > end:
            if end is not None:
                yield at, end
            at = s
        end = s + WINDOW
    if end is not None:
        yield at, end


ROWS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("last", pa.int64()), ("words", pa.binary()), ("odd", pa.binary())])
ROWS_SQL = "key long, doc_id long, part int, start long, last long, words binary, odd binary"


def known_rows(spans: list[tuple]) -> pa.RecordBatch:
    """Covered spans (doc_id, part, start, last) as rows without words, spread by document."""
    c = list(zip(*spans, strict=True)) if spans else [[]] * 4
    key = mixed(np.array(c[0], np.int64).view(np.uint64)).view(np.int64)
    return rows_out(ROWS, (key, *c, pa.nulls(len(key), pa.binary()), pa.nulls(len(key), pa.binary())))


def own_contexts(split: Split, asked: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (odd: of a crowded anchor), first word and end of the contexts whose anchors were asked for."""
    h, first, last = split.anchors()
    size = np.array([len(a) for a in asked], np.int64)
    if not len(h) or not size.sum():
        return h[:0], first[:0], last[:0]
    want = np.array([x for a in asked for x in a], np.int64).view(np.uint64)
    text = np.repeat(np.arange(len(asked)), size)
    # Hashes of each text as one sorted list: where text and hash agree, the low bit is the answer's.
    salt = mixed(np.arange(len(asked), dtype=np.uint64) + np.uint64(1))
    key, own = (want & ~np.uint64(1)) ^ salt[text], h ^ salt[split.text[first]]
    by = np.argsort(key, kind="stable")
    key, odd = key[by], want[by] & np.uint64(1)
    at = np.minimum(np.searchsorted(key, own), len(key) - 1)
    hit = key[at] == own
    return h[hit] | odd[at[hit]], first[hit], last[hit]


def passages(texts: DataFrame, unit: int = UNIT) -> DataFrame:
    """texts(doc_id, part, text, asked) -> passages of at most `unit` words, keyed by their least anchor so that like ones
    meet (dealt out, where that is crowded), with their crowded anchors in odd. Of passages that a batch has again those
    of the first document go on, and spans of the others (words null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in slices(batches, BATCH):
            docs, fresh = [], []
            for k, (doc, part) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), strict=True)):
                if (doc, part) != before:  # equal rows follow one another
                    fresh.append(k)
                    docs.append((doc, part))
                before = (doc, part)
            texts, asked = (b.column(c).take(pa.array(fresh)).to_pylist() for c in ("text", "asked"))
            split = Split(texts)
            h, first, last = own_contexts(split, asked)
            if not len(h):
                continue
            _, start, end = merged(split.text[first], first, last)
            found = []  # document, first word, end, words
            for a, z in zip(start.tolist(), end.tolist(), strict=True):
                for x in range(a, max(z - WINDOW + 1, a + 1), unit - WINDOW + 1):
                    y = min(x + unit, z)
                    found.append((docs[split.text[a]], x, y, b" ".join(split.words(x, y))))
            found.sort(key=lambda r: r[0])
            groups: dict[bytes, list[int]] = {}
            for i, r in enumerate(found):
                groups.setdefault(r[3], []).append(i)
            spans, rows = [], []
            for words, group in groups.items():
                if found[group[0]][0][0] != found[group[-1]][0][0]:  # a few words at a time: one automaton a repeated passage
                    for i, starts in zip(group, located([(found[i][0][0], words.split()) for i in group]), strict=True):
                        (doc, part), x, _, _ = found[i]
                        base = split.first[split.text[x]]
                        spans += [(doc, part, x - base + s, x - base + e) for s, e in joined(starts)]
                for i in group:
                    (doc, part), x, y, _ = found[i]
                    if doc != found[group[0]][0][0]:
                        break
                    own = h[np.searchsorted(last, x + WINDOW) : np.searchsorted(first, y - WINDOW, "right")]  # of its windows
                    key, base = int(own.min()), split.first[split.text[x]]
                    if key & 1:
                        key = int(mixed(np.array([key + (doc % SALTS)], np.uint64))[0])
                    crowded = own[(own & np.uint64(1)).astype(bool)]
                    rows.append((key - (1 << 64) if key >> 63 else key, doc, part, x - base, y - base, words, crowded.tobytes()))
            yield known_rows(spans)
            yield rows_out(ROWS, zip(*rows, strict=True))

    return texts.mapInArrow(run, ROWS_SQL)


def in_units(rows: DataFrame, unit: int = UNIT) -> DataFrame:
    """Passages sorted by key, in units: spans that a smaller document of the same unit has too (words null), and the
    contexts that are still open, keyed by their anchor, or windows by their own hash where the anchor is crowded (odd: all
    their places in the document)."""

    def resolved(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda r: r[1:4])
        found = located([(r[1], r[4].split()) for r in held])
        yield known_rows([(doc, part, at + s, at + e) for (_, doc, part, at, _, _), starts in zip(held, found, strict=True) for s, e in joined(starts)])
        split = Split([r[4] for r in held])
        key, first, last = split.anchors()
        if not len(key):
            return
        windows = split.grams(WINDOW)
        gone = np.zeros(len(windows), bool)
        for x, starts in zip(split.first.tolist(), found, strict=False):
            gone[x + np.array(starts, np.int64)] = True
        crowded = np.unique(np.frombuffer(b"".join(r[5] for r in held), np.uint64)) & ~np.uint64(1)
        odd = np.isin(key, crowded)
        single = ragged(first[odd], last[odd] - first[odd] - WINDOW + 1)
        single = single[~gone[single]]
        total = np.r_[0, np.cumsum(~gone)]
        open_ = ~odd & (total[last - WINDOW + 1] > total[first])
        doc, part, at = (np.array(c, np.int64) for c in list(zip(*held, strict=True))[1:4])
        base = at - split.first[:-1]  # from a word's place in the unit to that in its document
        words = lambda x, y: split.raw[split.start[x] : split.end[y - 1]]
        key, first, last = key[open_], first[open_], last[open_]
        t = split.text[first]
        texts = [words(x, y) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
        yield rows_out(ROWS, (key.view(np.int64), doc[t], part[t].astype(np.int32), first + base[t], last + base[t], pa.array(texts, pa.binary()), pa.nulls(len(t), pa.binary())))
        # A window that a document has many times is one row, with all its places.
        places: dict[tuple[int, int, bytes], list[int]] = {}
        for x, k in zip(single.tolist(), split.text[single].tolist(), strict=True):
            places.setdefault((held[k][1], held[k][2], words(x, x + WINDOW)), []).append(x)
        rows = [(int(windows[x[0]] | np.uint64(1)), d, p, int(x[0] + base[split.text[x[0]]]), w, (np.array(x) + base[split.text[x]]).astype(np.int64).tobytes()) for (d, p, w), x in places.items()]
        if rows:
            key, d, p, at, w, x = zip(*rows, strict=True)
            yield rows_out(ROWS, (np.array(key, np.uint64).view(np.int64), d, p, at, np.array(at) + WINDOW, w, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            known = np.flatnonzero(b.column("words").is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(known)) for c in ROWS.names], schema=ROWS)
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "part", "start", "words", "odd", "last")), strict=True):
                if row[4] is not None:
                    held.append(row[:6])
                    size += row[6] - row[3]
                    if size >= unit:
                        yield from resolved(held)
                        held, size = [], 0
        if held:
            yield from resolved(held)
        tidy()

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "doc_id", "part", "start").mapInArrow(run, ROWS_SQL)


SPANS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("last", pa.int64())])


def in_shards(rows: DataFrame, unit: int = UNIT) -> DataFrame:
    """Covered spans (doc_id, part, start, last) of words, known ones and those found where contexts of all documents meet.

    Rows come sorted by key and document; keys of one document alone need no look. A unit ends between keys, or inside a
    key that is itself a unit; of such a one the first row of every distinct context stays for the next unit, so no
    occurrence misses it.
    """

    def spans(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: r[1:4])
        out = []
        for (_, doc, part, at, _, places), starts in zip(held, located([(r[1], r[4].split()) for r in held]), strict=True):
            if starts and places is not None:  # one window, wherever the document has it
                out += [(doc, part, s, e) for s, e in joined(np.frombuffer(places, np.int64).tolist())]
            elif starts:
                out += [(doc, part, at + s, at + e) for s, e in joined(starts)]
        return rows_out(SPANS, zip(*out, strict=True) if out else [[]] * 4)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Rows with words, without keys that surely have one document: whole in a batch, all rows of one document."""
        for b in batches:
            if not b.num_rows:
                continue
            key, doc = (b.column(c).to_numpy() for c in ("key", "doc_id"))
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lone = np.maximum.reduceat(doc, head) == np.minimum.reduceat(doc, head)
            lone[0] = lone[-1] = False  # these may go on in another batch
            take = np.repeat(~lone, np.diff(np.r_[head, len(key)])) & ~b.column("words").is_null().to_numpy(zero_copy_only=False)
            at = pa.array(np.flatnonzero(take))
            yield list(zip(*(b.column(c).take(at).to_pylist() for c in ("key", "doc_id", "part", "start", "words", "odd")), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, start = [], 0, 0  # rows of the unit, their words (about), the first of the last key
        for found in shared(batches):
            for row in found:
                if held and row[0] != held[-1][0]:
                    if size >= unit:
                        yield spans(held)
                        held, size = [], 0
                    start = len(held)
                if size >= 2 * unit and start == 0:  # one key alone
                    firsts = {}
                    for r in held:
                        firsts.setdefault(r[4], r)
                    yield spans(held)
                    held = list(firsts.values())
                    size = 0
                held.append(row)
                size += 2 * WINDOW
        if held:
            yield spans(held)
        tidy()

    n = shuffle_partitions(rows.sparkSession)
    known, open_ = rows.where("words is null").select(*SPANS.names), rows.where("words is not null").select("key", "doc_id", "part", "start", "words", "odd")
    met = open_.repartition(n, "key").sortWithinPartitions("key", "doc_id", "part", "start").mapInArrow(run, "doc_id long, part int, start long, last long")
    return known.unionByName(met)


def covered_spans(texts: DataFrame, hot: int = HOT, unit: int = UNIT) -> DataFrame:
    """texts(doc_id, part, text) -> (doc_id, part, start, last) in words, whose union is what every document loses."""
    spark = texts.sparkSession
    spots = SPREAD * shuffle_partitions(spark)
    found = cut(recurring(anchor_places(texts, spots), hot, spots))
    release(spark)
    crowded = cut(found.where(F.col("kind") == CROWDED).select("hash", F.lit(1).cast("long").alias("odd")))
    asked = small_join(found.where(F.col("kind") == RECURS).select("hash", "doc_id", "part"), crowded, ["hash"], "left")
    asked = asked.groupBy("doc_id", "part").agg(F.collect_list(F.col("hash") + F.coalesce("odd", F.lit(0).cast("long"))).alias("asked"))  # at most one word in five of a text
    found = cut(passages(salted_join(texts, asked, ["doc_id", "part"], by_place=True).select("doc_id", "part", "text", "asked"), unit))
    release(spark)
    found = cut(in_units(found, unit))
    release(spark)
    spans = cut(in_shards(found, unit))
    release(spark)
    return spans


def without_shared(docs: DataFrame, shape: Callable[[list[bytes]], bytes] = b" ".join, hot: int = HOT, unit: int = UNIT) -> DataFrame:
    """Every row of docs: its columns but the text in a struct row, n_words, n_removed and kept (shape of the words that stay)."""
    rest = [c for c in docs.columns if c.lower() != "text"]
    d = placed(docs)
    d = d.withColumn("part", F.col("part").cast("int"))
    spans = covered_spans(d.select("doc_id", "part", "text"), hot, unit)
    spans = spans.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "last")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()  # bytes are split at exactly 0x20 and 0x09-0x0D
                kept = words
                if spans:
                    s = np.array([(x["start"], x["last"]) for x in spans], np.int64)
                    _, start, last = merged(np.zeros(len(s), np.int64), s[:, 0], s[:, 1])
                    kept = [w for a, z in zip([0, *last.tolist()], [*start.tolist(), len(words)], strict=True) for w in words[a:z]]
                rows.append((len(words), len(words) - len(kept), shape(kept)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *columns], names=["row", "n_words", "n_removed", "kept"])

    found = salted_join(d, spans, ["doc_id", "part"], "left", by_place=True).select("row", "text", "spans")
    kind = d.schema["row"].dataType.simpleString()
    out = found.mapInArrow(run, f"row {kind}, n_words long, n_removed long, kept binary")
    return out.withColumn("row", F.struct(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)]))


def hex_digest(kept: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(kept)).hexdigest().encode()


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = without_shared(docs.select("doc_id", "text"), hex_digest)
    return found.select("row.doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW}),
g AS (SELECT r, doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM p),
c AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS own FROM g) WHERE own < coalesce(doc_id, 9223372036854775807)),
x AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS j FROM c),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM d),
k AS (SELECT w.r, count(*) AS n, string_agg(w.w, ' ' ORDER BY w.j) AS kept FROM w ANTI JOIN x ON w.r = x.r AND w.j = x.j GROUP BY w.r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
