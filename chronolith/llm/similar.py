"""Near-duplicates by exact Jaccard similarity of word shingles: pivot distance tables discard pairs, exact sets decide.

A text is the set of its five-word shingles' hashes; texts of equal words are one class. In one order of all shingles
(common ones last, then by hash), two sets of similarity 0.8 or more share a shingle among the first n - ceil(0.8 n) + 1
of each: these are the keys under which every link meets, whatever the order. The order only keeps common phrases out
of the keys, so it may come from a sample, and the list of common shingles may end at COMMON.

First each class meets the least class of each of its keys, which joins large groups by few pairs; then, in keys that
still hold more than one component, each class meets the nearest one (by fingerprints) of other components, until that
links few, so that links grow with the classes of a key and not with their square; at last all pairs of components
that are still different meet. A majority fingerprint (SimHash) gives no
sure bound at 0.8, so fingerprints here are linear: every shingle toggles one of as many bits as the set's size asks for, and
the Hamming distance of two texts (the longer fingerprint folded to the shorter) is never more than the number of
shingles that only one of both has. The distances of their folds to reference fingerprints (the empty one among them: a
text's size) are tabled; a pair of which any coordinate differs by more than 0.8 allows is discarded, then one whose
own distance does, of folds and of whole fingerprints. No link is lost. What is left is decided by the exact sets.

Defined cases: null and empty texts are equal; fewer words than a shingle has are one shingle; of a component the row
with the least doc_id stays, nulls last, then by the text's hash; of equal rows one stays; a text of any length is
one set, of as many hashes as it has different shingles; an empty table gives none; columns of any name go through as
they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, release, rows_out, salted_join, ship, shuffle_partitions, slices, small_join
from .components import connected_components
from .simhash import pivots, shingles

WORDS = 5
#: Similarity as a fraction of whole numbers, so that no rounding decides.
SIMILAR = (4, 5)
#: One of SAMPLE texts is read for common shingles; at most COMMON of them go last in the order.
SAMPLE, OFTEN, COMMON = 8, 8, 1 << 16
#: Least and most bits of a fingerprint, bits of its fold, and reference fingerprints of the fold.
LEAST, MOST, FOLD, REFERENCES = 2048, 8192, 256, 8
BITS = [f"b{k}" for k in range(FOLD // 64)]
#: Classes of which a task remembers that it has sent their keys.
SEEN = 1 << 20
#: Classes of one key that are compared at once; a key with more is dealt in pairs of parts of about this size.
BLOCK = 2048
#: Links to nearest classes up to which no further round asks for nearest ones.
RARE = 1 << 13


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    return np.unique(np.array(shingles(text, words), np.uint64))


def parity(found: np.ndarray) -> np.ndarray:
    """A fingerprint of LEAST to MOST bits, a power of two; where it is not fewer than there are shingles, unlike texts
    differ in enough of them."""
    bits = LEAST
    while bits < min(len(found), MOST):
        bits *= 2
    odd = (np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def texts(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled texts have and their places in the order, by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingle_set(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["s"])

    sample = texts(docs).where(F.pmod("th", F.lit(SAMPLE)) == 0).dropDuplicates(["th"])
    counts = sample.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "s").limit(COMMON).collect()  # COMMON rows
    s = np.array([r.s for r in top], np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], (len(s) - np.arange(len(s)))[order]


def class_of(text: bytes | None) -> int:
    """A signed hash of a text's words; texts of equal words have equal sets."""
    h = xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()), 42)
    return h - (1 << 64) if h >> 63 else h


EACH = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), *[(b, pa.int64()) for b in BITS], ("wide", pa.binary())])


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, th, c, n, b0..b3, wide) of every row: hash of the text, class, size and fingerprints of its set; of rows
    of one class in a task only some have a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            c = [class_of(t) for t in texts]
            n, wide, bits = np.zeros(len(c), np.int64), [None] * len(c), np.zeros((len(c), len(BITS)), np.int64)
            for i, (k, t) in enumerate(zip(c, texts, strict=True)):
                if k not in seen:
                    seen.add(k)
                    found = shingle_set(t)
                    w = parity(found)
                    n[i], wide[i], bits[i] = len(found), w.tobytes(), np.bitwise_xor.reduce(w.reshape(-1, len(BITS)))
            if len(seen) > SEEN:
                seen.clear()
            yield rows_out(EACH, (b.column("doc_id"), b.column("th"), c, n, *[bits[:, k].copy() for k in range(len(BITS))], wide))

    return texts(docs).mapInArrow(run, f"doc_id long, th long, c long, n long, {', '.join(f'{b} long' for b in BITS)}, wide binary")


KEYS = pa.schema([("c", pa.int64()), ("key", pa.int64())])


def prefix_keys(docs: DataFrame) -> DataFrame:
    """(c, key) of every class, about once per task."""
    last, places = common(docs)

    def keys(found: np.ndarray) -> np.ndarray:
        n = len(found)
        if not n:
            return found.view(np.int64)
        place = np.zeros(n, np.int64)
        if len(last):
            at = np.minimum(np.searchsorted(last, found), len(last) - 1)
            place = np.where(last[at] == found, places[at], 0)
        least = -(-SIMILAR[0] * n // SIMILAR[1])
        return found[np.lexsort((found, place))[: n - least + 1]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            new = []
            for t in b.column("text").to_pylist():
                if (k := class_of(t)) not in seen:
                    seen.add(k)
                    new.append((k, keys(shingle_set(t))))
            if len(seen) > SEEN:
                seen.clear()
            if new:
                yield rows_out(KEYS, (np.repeat(np.array([k for k, _ in new], np.int64), [len(x) for _, x in new]), np.concatenate([x for _, x in new])))

    return texts(docs).mapInArrow(run, "c long, key long")


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def within(i: np.ndarray, j: np.ndarray, n: np.ndarray, table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) can be similar: by sizes, then the table of distances, then the fingerprints' distance."""
    p, q = SIMILAR
    left = np.flatnonzero(np.minimum(n[i], n[j]) * q >= np.maximum(n[i], n[j]) * p)
    far = lambda left: (n[i[left]] + n[j[left]]) * (q - p)
    left = left[np.abs(table[i[left]] - table[j[left]]).max(axis=1, initial=0) * (p + q) <= far(left)]
    return left[np.bitwise_count(bits[i[left]] ^ bits[j[left]]).sum(axis=1, dtype=np.int64) * (p + q) <= far(left)]


class Whole:
    """Whole fingerprints by length, each also folded to half of it, so that those of like texts can be compared."""

    def __init__(self, wide: list[bytes]):
        self.size, self.at = np.array([len(w) for w in wide], np.int64), {}
        for k in np.unique(self.size).tolist():
            rows, more = np.flatnonzero(self.size == k), np.flatnonzero(self.size == 2 * k)
            own, longer = (np.frombuffer(b"".join([wide[r] for r in found.tolist()]), np.uint64).reshape(len(found), size // 8) for found, size in ((rows, k), (more, 2 * k)))
            place = np.zeros(len(wide), np.int64)
            place[rows], place[more] = np.arange(len(rows)), len(rows) + np.arange(len(more))
            half = k // 8
            self.at[k] = place, np.concatenate([own, longer[:, :half] ^ longer[:, half:]]) if len(more) else own

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs whose lengths are equal or one twice the other; 0 for others, whose sizes aren't alike."""
        least, most = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        found = np.zeros(len(i), np.int64)
        for k, (place, bits) in self.at.items():
            on = np.flatnonzero((least == k) & (most <= 2 * k))
            found[on] = np.bitwise_count(bits[place[i[on]]] ^ bits[place[j[on]]]).sum(axis=1, dtype=np.int64)
        return found


def table_of(bits: np.ndarray) -> np.ndarray:
    """Hamming distances of folded fingerprints to the reference fingerprints."""
    refs = pivots(REFERENCES * len(BITS)).reshape(REFERENCES, len(BITS))
    return np.stack([np.bitwise_count(bits ^ r).sum(axis=1, dtype=np.int64) for r in refs], axis=1)


def nearest_of(i: np.ndarray, j: np.ndarray, far: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Places of the pairs that are the nearest of i or of j, ties to the least class; far: the pairs' distances."""
    at, of, other = np.tile(np.arange(len(i)), 2), np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((c[other], far[at], of))
    return np.unique(at[order][np.diff(of[order], prepend=-1) != 0])


def across(met: DataFrame) -> DataFrame:
    """All pairs of meeting()."""
    return meeting(met, nearest=False)


def meeting(met: DataFrame, nearest: bool) -> DataFrame:
    """met(key, c, comp, n, b0..b3, classes) -> (a, b): pairs of a key from different components that within() lets through
    and, where met has wide, whose whole fingerprints are near enough: folds say nothing about texts of over some 600
    shingles, of which all pairs of a key would go out. Where met has before (the class's last smaller key, or c), a pair
    with the same one goes out there instead: alike texts share long runs of keys. With nearest, only pairs of which one
    is the nearest to the other in this key go out, two a class at most where the key isn't parted.

    Classes of a key are taken by size, so that a class meets only those whose size allows the similarity. A key with
    over BLOCK classes is parted by hash and every two of its parts meet by themselves, in any task; no task holds more
    than two parts of a key.
    """
    p, q = SIMILAR
    names = ["key", "meeting", "n", "c", "comp", "side", *BITS]
    whole, before = ([x for x in met.columns if x == k] for k in ("wide", "before"))
    names += before

    def pairs(rows: np.ndarray, wide: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        wholes = Whole(wide) if whole else None
        n, c, comp, side = rows[:, 2], rows[:, 3], rows[:, 4], rows[:, 5]
        bits = np.ascontiguousarray(rows[:, 6 : 6 + len(BITS)]).view(np.uint64)
        last = rows[:, -1] if before else c
        table = table_of(bits)
        bounds = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1), True])
        sizes = np.diff(bounds)
        lefts, rights, fars = [], [], []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            on = (comp[i] != comp[j]) & (side[i] != side[j]) & (last[i] != last[j])
            i, j = i[on], j[on]
            on = within(i, j, n, table, bits)
            i, j = i[on], j[on]
            apart = wholes.distance(i, j) if wholes else np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            on = apart * (p + q) <= (n[i] + n[j]) * (q - p)
            i, j, far = i[on], j[on], apart[on] / np.maximum(n[i[on]] + n[j[on]], 1)
            if nearest:
                on = nearest_of(i, j, far, c)
                i, j, far = i[on], j[on], far[on]
                fars.append(far)
            lefts.append(i)
            rights.append(j)

        end = np.repeat(bounds[1:], sizes)
        at = np.flatnonzero(np.repeat(sizes <= 64, sizes))
        for lag in range(1, 64):
            at = at[at + lag < end[at]]
            if not len(at):
                break
            keep(at, at + lag)
        for a, b in zip(bounds[:-1][sizes > 64], bounds[1:][sizes > 64], strict=True):
            upto = a + np.searchsorted(n[a:b] * p, n[a:b] * q, side="right")  # sizes rise within a key
            for x in range(a, b - 1):
                if upto[x - a] > x + 1:
                    keep(np.full(upto[x - a] - x - 1, x), np.arange(x + 1, upto[x - a]))
        i, j = np.concatenate(lefts or [np.zeros(0, np.int64)]), np.concatenate(rights or [np.zeros(0, np.int64)])
        if nearest and len(i):
            on = nearest_of(i, j, np.concatenate(fars), c)
            i, j = i[on], j[on]
        i, j = c[i], c[j]
        found = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0)
        return found[:, 0].copy(), found[:, 1].copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wide = np.zeros((0, len(names)), np.int64), []
        for b in batches:
            held = np.concatenate([held, np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in names], axis=1)])
            wide += b.column("wide").to_pylist() if whole else []
            if len(held) > 1 << 16:
                cutoff = int(np.argmax((held[:, :2] == held[-1, :2]).all(axis=1)))  # the last meeting may go on
                if cutoff:
                    yield rows_out(PAIRS, pairs(held[:cutoff], wide[:cutoff]))
                    held, wide = held[cutoff:], wide[cutoff:]
        if len(held):
            yield rows_out(PAIRS, pairs(held, wide))

    parts = F.ceil(F.col("classes") / F.lit(BLOCK)).cast("long")
    placed = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # A part that meets itself compares all of its classes, two parts only those of different sides.
    placed = placed.withColumn("meeting", F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).withColumn("side", F.when(F.col("part") == F.col("other"), F.col("c")).otherwise(F.col("part")))
    dealt = placed.select(*names, *whole).repartition(shuffle_partitions(met.sparkSession), "key", "meeting").sortWithinPartitions("key", "meeting", "n", "c")
    return dealt.mapInArrow(run, "a long, b long").distinct()


TEXTS = pa.schema([("c", pa.int64()), ("z", pa.binary())])


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(c, th) -> (c, z): one compressed text of each class, a fraction of what its set would take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            new = [(c, t) for c, t in zip(b.column("c").to_pylist(), b.column("text").to_pylist(), strict=True) if not (c in seen or seen.add(c))]
            if new:
                yield rows_out(TEXTS, ([c for c, _ in new], [zlib.compress(t or b"") for _, t in new]))

    return cut(small_join(texts(docs).select("th", "text"), nodes, ["th"]).select("c", "text").mapInArrow(run, "c long, z binary").dropDuplicates(["c"]))


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough."""
    p, q = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda z: shingle_set(zlib.decompress(z))
        last, x = None, np.zeros(0, np.uint64)
        for b in batches:
            ok = []
            for a, za, zb in zip(b.column("a").to_pylist(), b.column("za").to_pylist(), b.column("zb").to_pylist(), strict=True):
                if a != last:  # pairs of one text often follow one another
                    last, x = a, of(za)
                y = of(zb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * (p + q) >= (len(x) + len(y)) * p)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a, b = found.select(F.col("c").alias("a"), F.col("z").alias("za")), found.select(F.col("c").alias("b"), F.col("z").alias("zb"))
    return cut(salted_join(pairs.join(b, "b"), a, "a").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long"))


def distance(a: list[str], b: list[str]) -> Column:
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0)).cast("long")


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()


def allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that sizes and fingerprints allow: p/q of the union shared leaves (q - p) / (q + p) of both sizes unshared."""
    p, q = SIMILAR

    def side(s: str, columns: list[str]) -> DataFrame:
        return classes.select(F.col("c").alias(s), *[F.col(x).alias(f"{s}{x}") for x in columns])

    met = pairs.join(side("b", ["n", *BITS]), "b")
    met = salted_join(met, side("a", ["n", *BITS]), "a")
    near = (F.least("an", "bn") * q >= F.greatest("an", "bn") * p) & (distance([f"a{x}" for x in BITS], [f"b{x}" for x in BITS]) * (p + q) <= (F.col("an") + F.col("bn")) * (q - p))
    met = cut(met.where(near).select("a", "b", (F.col("an") + F.col("bn")).alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.arange(b.num_rows)
                far = Whole(b.column("awide").to_pylist() + b.column("bwide").to_pylist()).distance(at, at + b.num_rows) * (p + q)
                yield b.select(["a", "b"]).filter(pa.array(far <= b.column("n").to_numpy(zero_copy_only=False) * (q - p)))

    nodes = cut(nodes_of(met))
    classes = cut(small_join(classes.select("c", "wide"), nodes, ["c"], "left_semi"))
    wide = salted_join(met.join(side("b", ["wide"]), "b"), side("a", ["wide"]), "a")
    return wide.select("a", "b", "n", "awide", "bwide").mapInArrow(run, "a long, b long")


def merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """comps(c, root) with more links: the components are joined, not their members again, so links within one or between
    the same two weigh nothing."""
    if comps is None:
        return cut(connected_components(links).withColumnRenamed("node", "c"))
    for end in ("a", "b"):
        links = small_join(links, comps.withColumnRenamed("c", end), [end], "left").withColumn(end, F.coalesce("root", end)).drop("root")
    moved = cut(connected_components(links.select("a", "b")))
    old = small_join(comps.withColumnRenamed("root", "node"), moved, ["node"], "left").select("c", F.coalesce("root", "node").alias("root"))
    return cut(old.unionByName(moved.withColumnRenamed("node", "c").join(comps, "c", "left_anti")))


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, th, root) of every row: rows linked over similar texts have one root."""
    spark = docs.sparkSession
    each = cut(described(docs))
    classes = cut(each.where("wide is not null").select("c", "th", "n", *BITS, "wide").dropDuplicates(["c"]))
    here = Window.partitionBy("key")
    ends = prefix_keys(docs).select("c", "key", F.min("c").over(here).alias("a"), F.max("c").over(here).alias("z"))
    met = cut(ends.where("a <> z").select("c", "key", "a").distinct())  # lies by key already
    release(spark)

    def judged(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        nodes = small_join(classes.select("c", "th"), cut(nodes_of(pairs)), ["c"], "left_semi")
        found = verified(pairs, texts_of(docs, cut(nodes)))
        release(spark)
        return found

    def labelled(comps: DataFrame) -> DataFrame:
        """Classes in keys that hold more than one component. All pairs with a key's least class have been judged."""
        rows = small_join(met.where("a <> c").select("c", "key"), comps, ["c"], "left").select("c", "key", F.coalesce("root", "c").alias("comp"))
        mixed = rows.select("*", F.min("comp").over(here).alias("lo"), F.max("comp").over(here).alias("hi"), F.count("*").over(here).alias("classes")).where("lo <> hi").select("c", "key", "comp", "classes")
        mixed = mixed.withColumn("before", F.coalesce(F.lag("key").over(Window.partitionBy("c").orderBy("key")), "c"))
        return salted_join(cut(mixed), classes.select("c", "n", *BITS, "wide"), "c")

    first = judged(allowed(cut(met.where("a <> c").select("a", F.col("c").alias("b")).distinct()), classes))
    roots, nearest = merged(None, first), True
    while True:
        met_again = labelled(roots)
        links = judged(meeting(met_again, nearest=True) if nearest else across(met_again))  # has judged all that allowed() does
        roots = merged(roots, links)
        if not nearest:
            break
        nearest = links.count() > RARE
    out = cut(salted_join(each.select("doc_id", "th", "c"), roots, "c", "left").select("doc_id", "th", F.coalesce("root", "c").alias("root")))
    del each, classes, ends, met, first, links, roots, met_again, labelled, judged
    release(spark)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component of similar texts one row of docs: that of the least doc_id, nulls last, then of the least text hash.

    Rows are told by (doc_id, text hash). Those that go are the fewer, so the texts move only if these are many.
    """
    each = components(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = each.groupBy("root").agg(F.min(key).alias("k"))
    flagged = cut(salted_join(each, first, "root").groupBy("doc_id", "th").agg(F.max(F.when(key == F.col("k"), 1).otherwise(0)).alias("stays"), F.count("*").alias("n")))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, names, strict=True)]).alias("row"), F.col("doc_id").cast("long").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64("text").alias("_th"))
    plain = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), F.col("th").alias("_th")]
    on = ["_none", "_id", "_th"]
    rows = small_join(rows, cut(flagged.where("stays = 0").select(*plain)), on, "left_anti")
    twice = cut(flagged.where("stays = 1 and n > 1").select(*plain))
    if not twice.isEmpty():  # equal rows: one of them
        rows = small_join(rows, twice, on, "left_anti").unionByName(small_join(rows, twice, on, "left_semi").select(*rows.columns).dropDuplicates(on).select(*rows.columns))
    return rows.select(*[F.col(f"row.{x}").alias(c) for c, x in zip(docs.columns, names, strict=True)])
