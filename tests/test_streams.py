"""Stores over several runs: activity whose windows later files change, and rows added by key."""

from pyspark.sql import functions as F

from chronolith.streaming import sync


def test_activity_of_two_runs_adds_up(spark, tmp_path):
    schema = "ts timestamp, kind string"
    first = [("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-02 09:00:00", "b")]
    later = [("2024-01-01 12:00:00", "a"), ("2024-01-02 10:00:00", "c"), ("2024-01-03 10:00:00", "a")]
    for rows in (first, later):
        spark.createDataFrame(rows, "ts string, kind string").select(F.col("ts").cast("timestamp").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = sync.landed(spark, f"{tmp_path}/in", schema)
        sync.store_activity(sync.activity(stream, "ts", "kind", lateness="10 days"), f"{tmp_path}/store", f"{tmp_path}/marks").awaitTermination()
    got = {(str(r.start)[:10], r.kind): r.n for r in sync.newest(spark, f"{tmp_path}/store").collect()}
    assert got == {("2024-01-01", "a"): 3, ("2024-01-02", "b"): 1, ("2024-01-02", "c"): 1, ("2024-01-03", "a"): 1}
    stored = spark.read.parquet(f"{tmp_path}/store")
    assert stored.where("kind = 'b'").count() == 1  # the second run did not write it again


def land(spark, at, rows):
    spark.createDataFrame(rows, "sha string, n long").coalesce(1).write.mode("append").parquet(at)


def test_upserts_of_three_runs_keep_the_first_row_of_a_key(spark, tmp_path):
    schema = "sha string, n long"
    at, store = f"{tmp_path}/in", f"{tmp_path}/store"

    def run():
        sync.upsert_stream(sync.landed(spark, at, schema), store, f"{tmp_path}/marks", parts=4).awaitTermination()
        return sorted((r.sha, r.n) for r in sync.stored(spark, store, spark.createDataFrame([], schema).schema).collect())

    land(spark, at, [(f"k{i}", i) for i in range(20)] + [("k3", -1), ("k3", -1)])
    first = [(f"k{i}", -1 if i == 3 else i) for i in range(20)]
    assert run() == sorted(first)
    land(spark, at, [("k3", -9), ("k7", 70), ("new", 1), ("new", 2)])
    assert run() == sorted([*first, ("new", 1)])
    land(spark, at, [("k0", 5)])  # nothing is new
    assert run() == sorted([*first, ("new", 1)])


def test_a_store_without_rows_is_empty(spark, tmp_path):
    schema = "sha string, n long"
    land(spark, f"{tmp_path}/in", [])
    sync.upsert_stream(sync.landed(spark, f"{tmp_path}/in", schema), f"{tmp_path}/store", f"{tmp_path}/marks").awaitTermination()
    assert sync.stored(spark, f"{tmp_path}/store", spark.createDataFrame([], schema).schema).isEmpty()


def test_a_batch_reads_only_the_parts_of_its_keys(spark, tmp_path):
    schema = "sha string, n long"
    land(spark, f"{tmp_path}/in", [(f"k{i}", i) for i in range(50)])
    sync.upsert_stream(sync.landed(spark, f"{tmp_path}/in", schema), f"{tmp_path}/store", f"{tmp_path}/marks").awaitTermination()
    whole = spark.read.parquet(f"{tmp_path}/store")
    where = {r.part for r in whole.select("part").distinct().collect()}
    one = min(where)
    plan = whole.where(F.col("part").isin([one]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(where) > 1
    assert whole.where(F.pmod(F.xxhash64("sha"), F.lit(sync.PARTS)) != F.col("part")).isEmpty()
