import random

import xxhash
from pyspark.sql import functions as F

from chronolith.llm import simhash
from chronolith.llm.components import connected_components

from .fixtures import documents


def slow_fingerprint(text):
    words, now = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if now:
                words.append(now)
            now = ""
        else:
            now += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(rows):
    """rows: (doc_id, fp) -> the least id of each row's component, by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return {(d, f): least.get(top(f)) for d, f in rows}


def test_as_brute_force(spark):
    docs = documents(spark, 150)
    want = classes([(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert all(want[r.doc_id, r.fp % (1 << 64)] == r.component_id for r in got)


def test_links_of_close_fingerprints_and_hot_keys(spark):
    rnd = random.Random(3)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(25)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = classes([(f, f % (1 << 64)) for f in signed])
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for hot in (2048, 3):
        roots = {r.node: r.root for r in connected_components(simhash.links(df, 2, hot)).collect()}
        groups: dict = {}
        for f in signed:
            groups.setdefault(roots.get(f, f), set()).add(f)
        mine = {f: min(g) for g in groups.values() for f in g}
        assert all(mine[f] == want[f, f % (1 << 64)] for f in signed)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3)], "a long, b long")
    assert {(r.node, r.root) for r in connected_components(edges).collect()} == {(i, 0) for i in range(201)}


def test_one_fingerprint_of_a_third_of_all_rows_and_empty(spark):
    texts = [""] * 900 + [f"word{i} and{i} more{i} of{i} it{i}" for i in range(600)] + ["the same text of all"] * 400
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp long")
    want = classes([(i, slow_fingerprint(t)) for i, t in enumerate(texts)])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) and all(want[r.doc_id, r.fp % (1 << 64)] == r.component_id for r in got)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_query(spark, small):
    got = simhash.op5_simhash(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = classes([(r.doc_id, slow_fingerprint(r.text)) for r in docs])
    for r in got.collect():
        assert len(r.fingerprint) == 16 and want[r.doc_id, int(r.fingerprint, 16)] == r.component_id
    assert got.select(F.count_distinct("doc_id")).first()[0] == len(docs)
