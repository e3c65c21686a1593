import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import repeats
from chronolith.llm.lyndon import suffix_arrays


def brute(docs):
    """docs: (doc_id, bytes) with distinct ids -> removed flags by id."""
    seen, out = {}, {}
    for doc, text in sorted(docs):
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - 99):
            w = text[at : at + 100]
            if w in seen:
                gone[at : at + 100] = True
            else:
                seen[w] = True
        out[doc] = gone
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(30) for _ in range(4)]
    docs = []
    for i in range(n):
        kind = rnd.randint(0, 6)
        if kind == 0 and docs:
            t = rnd.choice(docs)[1]
        elif kind == 1 and docs:
            t = list(rnd.choice(docs)[1])
            for _ in range(3):
                if t:
                    t[rnd.randrange(len(t))] = "x"
            t = "".join(t)
        elif kind == 2:
            t = rnd.choice("ab") * rnd.randint(0, 400) + prose(5) + "ab" * rnd.randint(0, 150)
        else:
            t = prose(rnd.randint(0, 40)) + rnd.choice(shared) + prose(rnd.randint(0, 40)) + rnd.choice(["", rnd.choice(shared)])
        docs.append((i * 3 + 1, t))
    return docs


def check(spark, docs, found):
    want = brute([(d, t.encode()) for d, t in docs])
    rows = {r.row.doc_id: r for r in found.collect()}
    assert len(rows) == len(docs)
    for d, t in docs:
        raw, gone = t.encode(), want[d]
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (rows[d].n_removed, rows[d].n_spans) == (int(gone.sum()), spans), d
        assert bytes(rows[d].kept) == kept


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    docs = corpus(seed)
    check(spark, docs, repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))


def spans_of(docs, df, hot):
    spans = repeats.covered_spans(repeats.placed(df), hot).groupBy("doc_id").agg(F.collect_list(F.struct("start", "last")).alias("s")).collect()
    got = {d: np.zeros(len(t.encode()), bool) for d, t in docs}
    for r in spans:
        for x in r.s:
            got[r.doc_id][x.start : x.last] = True
    return got


@pytest.mark.parametrize("batch", [5, 10_000])
def test_hot_grams_and_small_batches(spark, monkeypatch, batch):
    """Whichever way windows meet, and wherever batches end, the same bytes are covered."""
    docs = corpus(5, 80)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    want = brute([(d, t.encode()) for d, t in docs])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for hot in (1, 4, 1024):
            got = spans_of(docs, df, hot)
            assert all((got[d] == want[d]).all() for d in want), hot
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_suffix_order_decides_what_hashes_bring_together():
    """Contexts of one gram that differ share windows, which only the suffix order finds."""
    rnd = random.Random(3)
    text = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    mid = text(120)
    lane = [(1, 0, text(20) + mid, 40), (2, 0, mid + text(30), 20)]
    d, s, e = repeats.lanes_covered([lane])
    assert (d.tolist(), s.tolist(), e.tolist()) == ([2], [0], [120])


def test_repeated_and_null_ids_all_take_part(spark):
    rnd = random.Random(7)
    t, u, v = ("".join(rnd.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    top = (1 << 63) - 1
    rows = [(1, t), (2, t + "AAAA"), (2, u), (2, t), (2, t), (5, u + v), (None, v), (None, t), (None, None), (top, v + "x"), (7, u[:150] + u[:150])]
    got = {}
    for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault((r.row.doc_id, r.n_bytes, bool(r.n_removed)), []).append(r.n_removed)
    assert got[1, 300, False] == [0] and got[2, 304, True] == [300]
    assert got.get((2, 300, True), []) == [300, 300] and got[2, 300, False] == [0]  # the two copies of t; u is the first of its kind
    assert got[5, 600, True] == [300] and got[7, 300, True] == [300] and got[top, 301, True] == [300]
    assert got[None, 300, True] == [300, 300] and got[None, 0, False] == [0]


def test_parting_keeps_every_common_window():
    rnd = random.Random(8)
    mid = bytes(rnd.randrange(97, 100) for _ in range(36))
    group = []
    for i in range(120):
        left = rnd.choice([64, 64, 10, 0])
        right = rnd.choice([64, 64, 20, 5])
        a, b = b"p" * 70 + b"q" * rnd.randint(0, 70), b"r" * rnd.randint(0, 70) + b"s" * 70
        group.append((i, 1000, a[len(a) - left :] + mid + b[:right] if left else mid + b[:right], left))
    want = brute([(d, t) for d, _, t, _ in group])
    got = {d: np.zeros(len(t), bool) for d, _, t, _ in group}
    for equal, part in repeats.parted(group, 8):
        for d, s, e in zip(*(repeats.equal_covered(part) if equal else repeats.lanes_covered([part])), strict=True):
            got[d][s - 1000 : e - 1000] = True
    assert all((got[d] == want[d]).all() for d in want)


def test_long_text_in_pieces(spark, monkeypatch):
    rnd = random.Random(4)
    t = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    b = np.frombuffer((t + t[1000:1300] + t).encode(), np.uint8)
    whole = repeats.contexts(b)[:4]
    monkeypatch.setattr(repeats, "PIECE", 1024)
    cut = repeats.contexts(b)[:4]
    order = np.lexsort((cut[1], cut[0], cut[2]))
    keys = np.unique(np.stack([x.view(np.int64) for x in cut], 1)[order], axis=0)
    assert (keys == np.unique(np.stack([x.view(np.int64) for x in whole], 1), axis=0)).all()


def test_defined_cases(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(300))
    rows = [(1, t, "x"), (1, t, "x"), (2, None, "x"), (3, "", "x"), (None, t, "x"), (4, t, "x"), (5, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.row.doc_id if r.row.doc_id else -1, r.n_removed) for r in repeats.without_repeats(df).collect())
    assert got[0] == (-1, 300)
    assert got[-2] == (4, 300) and got[-1] == (5, 0)
    assert [g for g in got if g[0] == 1] == [got[1], got[2]] and got[1][1] == got[2][1]
    assert repeats.without_repeats(df.limit(0)).collect() == []


def test_suffix_arrays_of_many_lanes():
    rnd = random.Random(2)
    for _ in range(200):
        lanes = [[rnd.randint(0, rnd.choice([1, 3, 20])) for _ in range(rnd.randint(1, 40))] for _ in range(rnd.randint(1, 6))]
        want, base = [], 0
        for x in lanes:
            want += [base + i for i in sorted(range(len(x)), key=lambda i: x[i:])]
            base += len(x)
        assert suffix_arrays(np.array(sum(lanes, [])), np.array([len(x) for x in lanes])).tolist() == want


def test_digest(spark, small):
    got = repeats.op2_repeats(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = brute([(r.doc_id, (r.text or "").encode()) for r in docs])
    text = {r.doc_id: (r.text or "").encode() for r in docs}
    for r in got.collect():
        kept = bytes(np.frombuffer(text[r.doc_id], np.uint8)[~want[r.doc_id]])
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and r.n_bytes == len(text[r.doc_id])
