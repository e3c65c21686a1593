import pytest
from pyspark.sql import functions as F

from chronolith.operators import features as X
from chronolith.operators import labels as L

AS_OF = "2025-02-01"
SCHEMA = "ord long, path string, date string, line_change long, size long, commit_interval_days double"


def frame(spark, rows):
    return spark.createDataFrame([(i, "f", *r) for i, r in enumerate(rows)], SCHEMA).withColumn("date", F.col("date").cast("timestamp"))


def outcome(spark, rows, config=None):
    return L.label(frame(spark, rows), AS_OF, config).select("completion_reason", F.col("completion_date").cast("date").cast("string")).distinct().collect()


def test_target(spark):
    df = spark.createDataFrame([("f1", "2024-12-01", "2024-12-30"), ("f1", "2024-12-10", "2024-12-15"), ("f2", "2025-01-20", "2025-01-20"), ("f3", "2025-01-20", None), ("f4", "2025-01-20", "2025-01-01")], "path string, date string, completion_date string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("date", "completion_date")})
    assert [r.days_until_completion for r in L.add_target(df).collect()] == [29, 5, 0, None, 0]


def test_stable_run(spark):
    rows = [("2024-11-01", 100, 100, 0.0), ("2024-11-02", 100, 100, 1.0), ("2024-12-15", 3, 100, 43.0), ("2024-12-20", 2, 100, 5.0), ("2025-01-01", 1, 100, 12.0)]
    assert outcome(spark, rows) == [("stable_line_change", "2025-01-01")]


def test_deleted(spark):
    assert outcome(spark, [("2024-10-01", 50, 50, 0.0), ("2024-10-15", -50, 0, 14.0)]) == [("deleted", "2024-10-15")]


def test_idle(spark):
    assert outcome(spark, [("2024-10-01", 100, 100, 0.0), ("2024-11-10", 100, 100, 9.0), ("2024-12-01", 100, 100, 22.0)]) == [("idle_timeout", "2024-12-01")]


def test_missing_interval_column(spark):
    with pytest.raises(ValueError):
        L.label(frame(spark, [("2024-12-20", 5, 100, 0.0)]).drop("commit_interval_days"), AS_OF)


def test_no_interval_gives_least_cutoff(spark):
    df = frame(spark, [("2024-12-20", 5, 100, 0.0), ("2024-12-20", 5, 100, 0.0)])
    assert L.inactivity_cutoff(df).first().cutoff == 30
    df = frame(spark, [("2024-12-20", 5, 100, float(d)) for d in (100, 110)])
    assert L.inactivity_cutoff(df).first().cutoff == 109


def test_empty(spark):
    df = frame(spark, [("2024-12-20", 5, 100, 0.0)]).limit(0)
    assert L.add_target(L.label(df, AS_OF)).collect() == []
    assert L.completion_summary(L.label(df, AS_OF)).collect() == []


def test_one_exchange_on_path(spark):
    rows = [(i, f"p{i % 3}", f"2024-01-{i % 28 + 1:02d}", 1, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "ord long, path string, date string, size long, line_change long").withColumn("date", F.col("date").cast("timestamp"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = X.add_history(X.at_least(df))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(path") == 1


def test_tail_that_begins_without_dates(spark):
    rows = [(None, 100, 9, 0.0), (None, 1, 9, 0.0), ("2024-10-01", 1, 9, 0.0), ("2024-11-01", 1, 9, 31.0), ("2024-12-01", 1, 9, 30.0)]
    assert outcome(spark, rows) == [("stable_line_change", "2024-12-01")]  # from the tail's first date
    assert outcome(spark, rows[:3] + [("2024-11-01", 100, 9, 31.0)]) == [("idle_timeout", "2024-11-01")]  # no tail at all


def test_label_takes_two_passes_over_windows(spark):
    plan = L.label(frame(spark, [("2024-12-20", 5, 100, 0.0)]), AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2
