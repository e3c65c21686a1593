import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolith.llm import catalog, packing, quality_rules, quality_votes, repeats, similar

from .fixtures import documents
from .test_repeats import brute
from .test_similar import five, groups


def test_stages_one_by_one(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], small).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    start, good, passed, single, cut, packed = seen
    for x in (good, passed, single, cut):
        assert x.dtypes == docs.dtypes
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(good) == ids(quality_votes.scores(start, labels).where("predicted = 1")) and 0 < good.count() < start.count()
    assert ids(passed) == ids(quality_rules.judged(good, labels).where("kept")) and 0 < passed.count() < good.count()
    rows, least = sorted(passed.select("doc_id", "text").collect()), {}
    for r, root in zip(rows, groups([r.text for r in rows]), strict=True):  # the stage's own rule: Jaccard of five-word shingles, by all pairs
        least.setdefault(root, r.doc_id)
    assert ids(single) == sorted(least.values()) and any(five(r.text) for r in rows)
    gone = brute([(r.doc_id, r.text.encode()) for r in single.collect()])
    left = {r.doc_id: r for r in cut.collect()}
    for r in single.collect():
        raw = r.text.encode()
        kept = bytes(b for b, g in zip(raw, gone[r.doc_id], strict=True) if not g).decode("utf-8", "ignore")
        if kept or not raw:
            assert left[r.doc_id].text == kept and left[r.doc_id].n_chars == (r.n_chars if kept == r.text else len(kept))
        else:
            assert r.doc_id not in left
    assert packed.select("doc_id").distinct().count() == cut.count()


def test_whole_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_stages_on_odd_rows(spark, small):
    """Nulls, repeats, one very long text, extra columns that operators use too; and no rows at all."""
    docs = documents(spark).withColumns({c: F.lit("x") for c in ("th", "score", "_th", "part", "llr")})
    long = docs.where("doc_id = 35").withColumns({"text": F.repeat(F.concat("text", F.lit(" Zz9 ")), 2000), "doc_id": F.lit(100_001).cast("long")})
    docs = docs.unionByName(long)
    size = long.select(F.length("text")).first()[0]
    assert size > 100_000
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"), F.lit(0).alias("toxic"))
    keep = (lambda d: quality_votes.keep_good(d, labels), lambda d: quality_rules.keep_passing(d, labels), similar.keep_one, repeats.cut_repeats)
    rows = lambda df: sorted(map(repr, df.select(*plain.columns).collect()))
    there = set(rows(docs))
    for stage in keep:
        got = stage(docs)
        assert got.dtypes == docs.dtypes and stage(docs.limit(0)).count() == 0
        assert rows(got) == rows(stage(plain))  # columns of clashing names change nothing
        if stage is not repeats.cut_repeats:
            assert set(rows(got)) <= there
    of_long = lambda df: [len(r.text) for r in df.where("doc_id = 100001").select("text").collect()]
    assert of_long(similar.keep_one(docs)) == [size]
    cut = of_long(repeats.cut_repeats(docs))
    assert len(cut) == 1 and cut[0] < size / 100  # it repeats itself
    n = lambda df: df.groupBy("doc_id").agg(F.sum("length").alias("n"))
    packed = packing.packed_documents(docs)
    assert packed.where("doc_id = 100001").count() > 1 and packing.packed_documents(docs.limit(0)).count() == 0
    assert sorted(map(tuple, n(packed).collect()), key=repr) == sorted(map(tuple, n(packing.packed_documents(plain)).collect()), key=repr)
    none = labels.limit(0)
    assert quality_rules.keep_passing(docs, none).count() > 0 and quality_votes.keep_good(docs, none).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in catalog.queries()[name](spark, small).select(*names).collect())
