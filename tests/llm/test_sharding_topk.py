import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import sharding, topk

from .fixtures import documents


def test_shards(spark, tmp_path):
    docs = documents(spark, 300)
    got = sharding.shard(docs, f"{tmp_path}/map").collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    for s in range(8):
        places = sorted(r.slot for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    sizes = [sum(r.size for r in got if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= max(w[1] for w in want)
    stored = sharding.SlotMap.load(spark, f"{tmp_path}/map")
    assert stored.version == 2 and all(stored.shard_of[r.vslot] == r["shard"] for r in got)
    assert sharding.shard(docs.limit(0), f"{tmp_path}/none").collect() == []


def test_a_second_run_edits_the_stored_map(spark, tmp_path):
    docs, at = documents(spark, 300), f"{tmp_path}/map"
    first = {r.vslot: r["shard"] for r in sharding.shard(docs, at).collect()}
    assert {r.vslot: r["shard"] for r in sharding.shard(docs, at).collect()} == first  # nothing to move, no new version
    assert sharding.SlotMap.load(spark, at).version == 2
    more = docs.unionByName(docs.withColumns({"doc_id": F.col("doc_id") + 100_000, "text": F.repeat("text", 3)}))
    second = sharding.shard(more, at, shards=9).collect()
    newest = sharding.SlotMap.load(spark, at)
    assert newest.version == 3 and newest.shards == 9 and all(newest.shard_of[r.vslot] == r["shard"] for r in second)
    sizes = [sum(r.size for r in second if r["shard"] == s) for s in range(9)]
    assert max(sizes) - min(sizes) <= max(r.size for r in second)
    with pytest.raises(Exception, match="(?i)exists"):
        newest.save(spark, at)


@pytest.mark.parametrize("kind", ["one id", "null rows", "one row"])
def test_bytes_are_near_equal_where_rows_repeat(spark, tmp_path, kind):
    rnd = random.Random(6)
    odd = {"one id": lambda i: (7, f"text {i} " + "x" * rnd.randrange(9)), "null rows": lambda i: (None, None), "one row": lambda i: (7, "the same text")}[kind]
    rows = [odd(i) for i in range(3000)] + [(100 + i, "y" * rnd.randrange(12)) for i in range(1000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), f"{tmp_path}/map").collect()
    sizes = [sum(r.size for r in found if r["shard"] == s) for s in range(8)]
    assert len(found) == 4000 and max(sizes) - min(sizes) <= max(r.size for r in found)
    per_slot = Counter(r.vslot for r in found)
    assert max(per_slot.values()) <= 12  # no slot, which is a task's, holds the repeated rows
    for s in range(8):
        assert sorted(r.slot for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))


def test_rebalancing_moves_little_and_makes_a_version(spark, tmp_path):
    rnd = random.Random(1)
    size = {k: rnd.randint(1, 100) for k in range(512)}
    first = sharding.plan(size, 8, 512)
    grown = {k: n * (3 if first.shard_of[k] == 2 else 1) for k, n in size.items()}
    second = sharding.rebalance(first, grown)
    load = second.loads(grown)
    assert second.version == 2 and max(load) <= 1.05 * sum(load) / 8
    assert {k for k in range(512) if first.shard_of[k] != second.shard_of[k]} == set(second.moved) and len(second.moved) < 200
    third = sharding.rebalance(second, grown, 9)
    assert sum(third.shard_of[k] == 8 for k in third.moved) > 0.8 * len(third.moved) and max(third.loads(grown)) <= 1.05 * sum(load) / 9
    fourth = sharding.rebalance(third, grown, 6)
    assert max(fourth.shard_of) == 5
    for m in (first, second):
        m.save(spark, f"{tmp_path}/map")
    assert sharding.SlotMap.load(spark, f"{tmp_path}/map").shard_of == second.shard_of
    assert sharding.SlotMap.load(spark, f"{tmp_path}/map", 1).shard_of == first.shard_of


def brute(rows, every, k):
    fine = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) and abs(64 * float(x)) < 2.0**63 for x in v)]
    fine.sort()
    out = []
    for n, (i, q) in enumerate(fine):
        if i % every == 0:
            score = lambda v: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=True))))  # noqa: B023, E731
            found = sorted((-score(v), j, m) for m, (j, v) in enumerate(fine) if m != n and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(found)]
    return sorted(out)


def found(spark, rows, k=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("floor", "copy", "q", "rank")}).repartition(4)
    v = topk.quantised(df)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.where(F.col("vec_id") % 20 == 0), k).collect())


def test_top_k_as_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, [float(np.float32(rnd.gauss(0, 0.3))) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(60)] + [(500, None), (520, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (540, [float("nan")] * 6), (560, [float("inf")] * 6), (580, []), (None, [1.0] * 6), (600, [1.0, 2.0])]
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "SEED", 50)
    monkeypatch.setattr(topk, "BLOCK", 16)
    assert found(spark, rows) == brute(rows, 20, 20)
    assert found(spark, rows[:10]) == brute(rows[:10], 20, 20)
    assert found(spark, []) == []


def test_top_k_of_repeated_ids_and_large_components(spark):
    rnd = random.Random(4)
    rows = [(i % 30, [float(np.float32(rnd.gauss(0, 1) * 10.0 ** rnd.choice([0, 6, 12, 15, 18, 30]))) for _ in range(4)]) for i in range(120)]
    rows += rows[20:24] + [(40, [4e7, 1.0, 1.0, 1.0]), (40, [4e7, 1.0, 1.0, 1.0])]
    assert found(spark, rows, 5) == brute(rows, 20, 5)


def test_a_deal_has_a_bounded_number_of_shards(spark, monkeypatch):
    assert [topk.deals_of(n) for n in (1, 7, 256, 1024, 1025, 100_000)] == [1, 7, 256, 256, 257, 25_000]
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "DEALS", 2)
    rows = spark.range(640).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("copy"), F.array(F.col("id"), F.col("id") * 7 % 64).alias("q"))
    found = topk.dealt(rows, 40)
    assert found.select("deal").distinct().count() == 10
    parts = [r.n for r in found.groupBy("deal").agg(F.count("*").alias("n")).collect()]
    assert max(parts) <= 2 * topk.BUILD  # a full shard and the rest of its partition


def test_the_tree_prunes_and_stays_exact():
    """On clustered vectors most pairs of a query and a node are never opened, and shards hand their k-th score on."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(0, 60, (40, 8))
    x = np.floor(centres[rnd.integers(0, 40, 4000)] + rnd.normal(0, 3, (4000, 8))).astype(np.int64)
    ids, none = np.arange(4000), np.zeros(4000, np.int64)
    best = topk.Best(ids[:50], none[:50], x[:50], np.full(50, -np.inf), 10)
    opened, nodes = [], []
    for at in (slice(0, 2000), slice(2000, 4000)):
        tree = topk.Ball(ids[at], none[at], x[at], 32)
        opened.append(tree.search(best))
        nodes.append(50 * len(tree.slices))
    scores = x[:50] @ x.T
    for i in range(50):
        want = sorted((-int(s), j, 0) for j, s in enumerate(scores[i]) if j != i)[:10]
        assert [tuple(map(int, f)) for f in best.found[i]] == want
    assert sum(opened) < 0.5 * sum(nodes) and opened[1] <= opened[0]
