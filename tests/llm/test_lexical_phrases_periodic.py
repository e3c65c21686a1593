"""Lexical search, shared phrases and periodic runs against brute force, with every odd row."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronolith.llm import lexical, periodic, phrases

from .fixtures import SCHEMA, documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_ranking(docs, items, k):
    counts = [(d, Counter(slow_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m, s = 50 + (50 * sum(c.values()) * n) // total, 0
            for t in set(slow_terms(text)) & set(c):
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                found.append((-s, d is None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "abc a B é"), (1, "abc a B é"), (2, None), (3, "!!"), (None, "one two words"), (4, "nothingshares"), (5, "a b c d e f g é ab ba"), (6, "Two")]


@pytest.mark.parametrize("segment,block,k", [(16 << 20, 128, 50), (900, 2, 3)])
def test_ranking_equals_brute_force(spark, monkeypatch, segment, block, k):
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs = documents(spark, 150, 3)
    items = spark.createDataFrame([(i, t, 0, 1) for i, t in ITEMS], "item_id long, text string, number long, term int")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in docs.collect()} >= {None}
    lexical_segments = lexical.segments
    monkeypatch.setattr(lexical, "segments", lambda d, n, t: lexical_segments(d, n, t, segment))
    got = sorted((tuple(r) for r in lexical.ranked(docs, items, k).collect()), key=repr)
    assert got == slow_ranking(rows, ITEMS, k)


def test_ranking_of_empty_tables(spark):
    docs, items = documents(spark, 12), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).collect() == []
    assert lexical.ranked(docs, items.limit(0)).collect() == []
    assert lexical.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def random_segment(rnd, docs, vocabulary):
    texts = [" ".join(f"t{int(vocabulary * rnd.random() ** 2)}" for _ in range(rnd.randint(0, 120))).encode() for _ in range(docs)]
    texts += [b"t1 t2 t0 t5 t3 t4 " * 12] * 12  # far above the rest
    counts = [Counter(lexical.terms(t)) for t in texts]
    n, total = sum(map(bool, counts)), sum(sum(c.values()) for c in counts)
    return counts, lexical.Segment(list(range(len(texts))), texts, n, total), n, total


def test_blocks_below_the_threshold_are_not_read():
    rnd = random.Random(4)
    skipped = blocks_in_all = 0
    for _ in range(8):
        counts, segment, n, total = random_segment(rnd, 3000, 4000)
        names = [t for t in (f"t{i}".encode() for i in sorted({rnd.randrange(6) for _ in range(2)})) if any(t in c for c in counts)]
        at = np.array(segment.find(names))
        weight = np.array([rnd.randint(5000, 9000) for _ in names])
        found = lexical.Found(10)
        read, blocks = lexical.wand(segment, at, weight, found, {})
        skipped += blocks - read
        want = []
        for d, c in enumerate(counts):
            m = 50 + (50 * sum(c.values()) * n) // total
            want.append((-sum(int(w) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in zip(names, weight, strict=True) if t in c), d))
        assert sorted((-s, -d) for s, _, d in found.heap) == [x for x in sorted(want)[:10] if x[0] < 0]
        blocks_in_all += blocks
    assert skipped > blocks_in_all // 3


def test_postings_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 1 << 30])
    raw, ends = lexical.packed(x)
    assert lexical.unpacked(raw).tolist() == x.tolist() and ends[-1] == len(raw)


def passages(spark, seed, n=80):
    """Documents that share passages, with repeated and null ids, repeated rows and names that the operator uses too."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "é", "ab", "of", "the", "Of"]) + str(rnd.randrange(9))
    common = [[word() for _ in range(rnd.randint(8, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += rnd.choice(common) if rnd.random() < 0.6 else [word() for _ in range(rnd.randint(0, 20))]
        text = "".join(w + rnd.choice([" ", "\n", " \t ", "\r\n"]) for w in words)
        rows.append((rnd.choice([i, i, 3, None]), rnd.choice([text, text, text, None, ""]), "en", "s", i, 1, 2, True, "r", 3))
    same = (50, " ".join(common[0] + common[1]), "en", "s", 1, 1, 2, True, "r", 3)
    rows += [same] * 30 + [(1 << 40, " ".join([*common[2] * 3]), "en", "s", 1, 1, 2, True, "r", 3)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def slow_removal(rows, window=13):
    first = defaultdict(lambda: 1 << 63)
    split = [(1 << 62 if d is None else d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            first[tuple(w[i : i + window])] = min(d, first[tuple(w[i : i + window])])
    out = []
    for (d, _), (rank, w) in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < rank for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,hot,unit", [(1, 4096, 200_000), (2, 1, 200_000), (3, 4096, 30), (4, 5, 60)])
def test_shared_passages_equal_brute_force(spark, seed, hot, unit):
    docs = passages(spark, seed)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = phrases.without_shared(docs, phrases.hex_digest, hot, unit)
    got = sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept.decode()) for r in found.collect()), key=repr)
    want = slow_removal(rows)
    assert got == want and any(r[2] for r in want)
    assert found.columns == ["row", "n_words", "n_removed", "kept"]
    assert set(found.schema["row"].dataType.fieldNames()) == set(docs.columns) - {"text"}


def test_shared_passages_of_odd_documents_and_none(spark):
    docs = documents(spark, 60, 9)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept.decode()) for r in phrases.without_shared(docs, phrases.hex_digest).collect()), key=repr)
    assert got == slow_removal(rows)
    assert phrases.without_shared(docs.limit(0)).collect() == []


def test_a_very_long_text_is_handled_whole(spark):
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[20_000:50_000] + ["x"] + long[:12])), (3, "y" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: (r.n_words, r.n_removed) for r in phrases.without_shared(docs, unit=700).collect()}
    assert got == {1: (60_000, 0), 2: (30_013, 30_000), 3: (1, 0)}


def test_words_are_hashed_by_their_bytes_alone():
    words = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghé" * 40, "", "b" * 17]
    one, two = phrases.Split([" ".join(words).encode()]), phrases.Split([None, b"x", "\n\t".join(reversed(words)).encode(), b" "])
    assert one.words(0, 6) == [w.encode() for w in words if w]
    assert set(one.hash.tolist()) == set(two.hash.tolist()) - {int(phrases.Split([b"x"]).hash[0])} and len(set(one.hash.tolist())) == 6
    assert two.text.tolist() == [1] + [2] * 6 and two.first.tolist()[:4] == [0, 0, 1, 7]


def slow_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if j - i >= max(12 - q, q) and not any(all(part[x] == part[x + p] for x in range(len(part) - p)) for p in range(1, q)):
                out.append((i, j + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text, rewrite=True):
    import zlib

    w = WORD.findall(text or "")
    if rewrite and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    gone = {j for s, e, q in found for j in range(s + q, e)}
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = " ".join(x for j, x in enumerate(w) if j not in gone)
    return doc_id, len(found), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def periodic_documents(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(260):
        words = [rnd.choice("abcdé") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            unit = [rnd.choice("abé") for _ in range(rnd.randint(1, 8))]
            words += unit * rnd.randint(2, 9) + unit[: rnd.randint(0, 5)]
        rows.append((i * 3, rnd.choice([" ", "\n", "\t "]).join(words)))
    return documents(spark, 50, 6).select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_periodic_runs_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(periodic, "PIECE", piece)
    docs = periodic_documents(spark)
    want = sorted((slow_row(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in periodic.periodic_runs(docs.repartition(3)).collect()), key=repr) == want
    assert sum(r[1] for r in want) > 100 and max(r[1] for r in want) > 1
    plain = sorted((slow_row(r.doc_id, r.text, False) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in periodic.periodic_runs(docs, None).collect()), key=repr) == plain


def test_periodic_runs_of_odd_and_very_long_texts(spark):
    docs = documents(spark, 20)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
    none = hashlib.sha256(b"").hexdigest()
    got = [tuple(r) for r in periodic.periodic_runs(spark.createDataFrame([(None, None, 1), (None, "", 1), (0, " \n", 2), (0, " \n", 2)], "doc_id long, text string, n_runs int")).collect()]
    assert sorted(got, key=repr) == sorted([(None, 0, None, None, None, None, none, none)] * 2 + [(0, 0, None, None, None, None, none, none)] * 2, key=repr)
    a, b = ["a"], ["a", "b"]
    while len(b) < 20_000:
        a, b = b, b + a
    rows = [(None, "x " * 100_000), (None, "x y z " * 30_000 + "w " + "x y z " * 9), (None, " ".join(b))]
    got = [tuple(r) for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert (1, 0, 100_000, 1, 100_000_000) in {r[1:6] for r in got} and (2, 0, 90_000, 3, 30_000_000) in {r[1:6] for r in got}
    assert max(r[1] for r in got) > 1000  # a Fibonacci text has about as many runs as words over five


def test_every_inner_node_of_a_suffix_tree_is_found_once():
    rnd = random.Random(2)
    for _ in range(40):
        w = [rnd.randrange(3) for _ in range(rnd.randint(2, 40))]
        ids, n = np.array(w, np.int64), len(w)
        order = periodic.suffix_order(ids, np.zeros(n, np.int64), np.full(n, n))
        assert order.tolist() == sorted(range(n), key=lambda i: w[i:])
        depth = periodic.depths(ids, order, np.full(n, n), np.zeros(n, np.int64))
        pairs = Counter()
        for a, s, b in zip(*(x.tolist() for x in periodic.nodes(depth)), strict=True):
            assert min(depth[a + 1 : b]) == depth[s]
            pairs.update((i, j) for i in range(a, s) for j in range(s, b))
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if min(depth[i + 1 : j + 1]) > 0}
        assert set(pairs) == want and set(pairs.values()) <= {1}
