import datetime as dt

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from chronolith.operators import errors as E
from chronolith.operators import features as X
from chronolith.operators import graph as G
from chronolith.operators import registry
from chronolith.operators import splits as P
from chronolith.operators.windows import trailing
from chronolith.plans import catalog
from chronolith.sources import history as H
from chronolith.sources import upserts as U


def facts(spark, rows):
    return spark.createDataFrame(rows, "ord long, path string, date timestamp, size long, committer string, lines_added long, lines_deleted long, line_change long")


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_history_ties_and_windows(spark):
    rows = [(i, "a", at(d), 1, "c", 1, 0, 1) for i, d in enumerate([0, 0, 10, 30, 30, 31])]
    got = X.add_history(facts(spark, rows)).orderBy("ord").collect()
    assert [r.commit_num for r in got] == [1, 2, 3, 4, 5, 6]
    assert [r.commits_last_30d for r in got] == [1, 2, 3, 2, 3, 4]  # the window is open at its start
    assert [r.commit_interval_days for r in got] == [0, 0, 10, 20, 0, 1]
    assert [r.is_first_commit for r in got] == [1, 1, 0, 0, 1, 0]
    assert got[0].std_commit_interval == 0.0


def test_whole_days_are_elapsed_not_calendar(spark):
    rows = [(0, "a", at(0, 23), 1, "c", 1, 0, 1), (1, "a", at(1, 1), 1, "c", 1, 0, 1)]
    assert [r.commit_interval_days for r in X.add_history(facts(spark, rows)).orderBy("ord").collect()] == [0, 0]


def test_sizes_from_zero_and_lost(spark):
    rows = [(i, "a", at(i), s, "c", 1, 0, 1) for i, s in enumerate([0, 10, 0, 0, None])]
    got = X.add_size(facts(spark, rows)).orderBy("ord").collect()
    assert len(got) == 4
    assert [r.percentage_change_size for r in got] == [0.0, 0.0, -1.0, 0.0]
    assert [r.size_diff for r in got] == [0.0, 10.0, -10.0, 0.0]


def test_ema_of_a_long_file(spark):
    xs = [float((i * 37) % 101) for i in range(600)]
    got = X.add_ema(facts(spark, [(i, "a", at(i), int(x), "c", 1, 0, 1) for i, x in enumerate(xs)])).orderBy("ord").collect()
    y = xs[0]
    for x, r in zip(xs, got, strict=True):
        y = y if r.ord == 0 else 0.25 * x + 0.75 * y
        assert abs(r.ema_7_size - y) < 1e-9


def test_vocabulary_of_many_extensions(spark):
    rows = [(i, f"d/f.{chr(97 + i % 18)}", at(0), 1, "c", 1, 0, 1) for i in range(40)]
    df = facts(spark, rows)
    words = X.extension_vocabulary(df)
    assert len(words) == 16 and words[-1] == "other"
    flags = X.add_extension_flags(df, words)
    assert all(sum(r[f"ext_{w}"] for w in words) == 1 for r in flags.collect())


def test_registry(spark):
    assert registry.names() == ["CommitHistory", "FilePath", "FileSize", "LineChange", "Committer"]
    with pytest.raises(ValueError):
        registry.register("FilePath")(lambda df: (df, []))
    df = facts(spark, [(0, "a.py", at(0), 1, "c", 1, 0, 1)])
    assert registry.apply(df, ["nothing"])[0].columns == df.columns
    full, flags = registry.apply(df)
    assert "committer_c" in full.columns and "committer" not in full.columns and "ext_py" in flags


def test_split_by_file_is_exact_and_disjoint(spark):
    df = spark.createDataFrame([(i, f"p{i % 23}", 1) for i in range(230)], "ord long, path string, days_until_completion long")
    got = P.split_by_file(df)
    train, test = ({r.path for r in got.where(F.col("split") == s).collect()} for s in ("train", "test"))
    assert len(train) == 18 and len(test) == 5 and not train & test
    assert got.count() == 230


def test_scaler_with_no_range(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = P.scale(df, P.fit_scaler(df, ["a", "b"]), ["a", "b"]).collect()
    assert [r.b for r in got] == [0.0, 0.0, 0.0] and [r.a for r in got] == [-1.0, 0.0, 1.0]


def test_median_baseline(spark):
    df = spark.createDataFrame([("train", d, "a", 0) for d in (1, 4, 7)] + [("test", 9, "a", 40)], "split string, days_until_completion long, path string, age_in_days long")
    r = E.error_frame(E.median_baseline(df)).first()
    assert abs(r.pred - 4) < 1e-9 and r.error_type == "underestimated" and r.true_bin == "<30" and r.age_bin == "31-90"


def test_history_scan(spark):
    rows = [("a", None, [("s1", "2024-01-01T00:00:00Z", "x", 1, None, None, None)]), ("b", None, []), ("c", None, None)]
    from chronolith.schema import FILE_TRACKING

    got = H.explode_history(spark.createDataFrame(rows, FILE_TRACKING)).collect()
    assert len(got) == 1 and got[0].lines_added == 0 and got[0].line_change == 0


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "sha int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "c"), (3, "d")], "sha int, v string")
    assert sorted(map(tuple, U.insert_absent(t, b).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, U.overwrite(t, b.where("v <> 'd'"), "sha").collect())) == [(1, "a"), (2, "z"), (3, "c")]
    left, gone = U.delete_keys(t, b, "sha")
    assert left.count() == 1 and gone.first().deleted == 1


def test_rename_chain_and_circle(spark):
    e = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a")], "path string, previous string")
    assert {(r.path, r.origin, r.depth) for r in G.lineage(e).collect()} == {("d", "a", 3), ("c", "a", 2), ("b", "a", 1)}
    with pytest.raises(ValueError):
        G.lineage(spark.createDataFrame([("a", "b"), ("b", "a")], "path string, previous string"))
    with pytest.raises(ValueError):
        G.lineage(spark.createDataFrame([("x", "a"), ("a", "b"), ("b", "c"), ("c", "a")], "path string, previous string"))


def test_a_long_chain_and_its_whole_history(spark):
    from chronolith.operators import graph as G

    chain = spark.createDataFrame([(i + 1, i) for i in range(37)] + [(37, 36), (101, 100)], "path long, previous long")
    found = {r.path: (r.origin, r.depth) for r in G.lineage(chain).collect()}
    assert found == {i: (0, i) for i in range(1, 38)} | {101: (100, 1)}
    entries = spark.createDataFrame([(i, i * 10) for i in range(38)] + [(100, 1), (55, 5)], "path long, x long")
    got = sorted((r.path, r.x) for r in G.full_history(entries, chain).collect())
    assert got == sorted([(37, i * 10) for i in range(38)] + [(101, 1)])


def test_content_status(spark):
    rows = [(1, 404, False, "file", None, False), (2, 404, False, "file", None, True), (3, 200, True, "file", None, False), (4, 200, False, "symlink", 3, False), (5, 200, False, "file", 7, False), (6, 200, False, "file", None, False)]
    got = H.content_status(spark.createDataFrame(rows, "id int, http_status int, is_list boolean, kind string, size long, renamed boolean"))
    assert sorted((r.id, r["size"]) for r in got.collect()) == [(1, 0), (5, 7)]


@pytest.mark.parametrize("name", ["stream_upsert", "stream_activity", "completion_summary", "error_all_slices"])
def test_catalog_queries_run(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_windows_of_the_frame_carry_no_projected_columns(spark, small):
    """Labels come before the wide windows, path columns after all; columns keep the order of the generators."""
    from chronolith.operators import labels as L
    from chronolith.plans import sql as Q

    full, _ = X.feature_frame(H.commit_facts(spark, small), label=L.targeted(Q.AS_OF))
    tree = full._jdf.queryExecution().optimizedPlan()
    windows, todo = [], [tree]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "Window":
            windows.append(node.output().mkString(","))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert windows and not any("ext_" in w or "in_test_dir" in w for w in windows)
    at = full.columns.index
    assert at("age_in_days") < at("path_depth") < at("ext_py") < at("size_diff") < at("add_ratio") < at("committer_grouped") < at("completion_date") < at("days_until_completion")


def test_rolling_median_fills_no_map_for_each_row(spark, small):
    df = X.add_size(H.commit_facts(spark, small))
    assert "percentile" not in df._jdf.queryExecution().optimizedPlan().toString()
    again = df.withColumn("again", F.percentile("size", F.lit(0.5)).over(trailing(7)))
    assert again.count() > 0 and again.where("NOT again <=> rolling_7_median_size").count() == 0
    assert df.columns.index("rolling_7_median_size") == df.columns.index("rolling_7_min_size") + 1


def test_a_linear_fit_reads_its_rows_once(spark):
    from chronolith.ml import models as M

    rows = spark.createDataFrame([(float(i % 7), float(i % 3), i) for i in range(60)], "a double, b double, days_until_completion int")
    plain = LinearRegression(solver="normal", labelCol="label", predictionCol="pred_log").fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(M.prepared(rows, ["a", "b"])))
    seen = spark.sparkContext.accumulator(0)
    read = F.udf(lambda x: (seen.add(1), x)[1], "double")
    model = M.fit(rows.withColumn("a", read("a")), ["a", "b"])
    assert seen.value < 2 * 60  # a row or so may be read for the number of columns; before, all were read for a summary too
    assert all(abs(x - y) < 1e-9 for x, y in zip(model.stages[-1].coefficients, plain.coefficients, strict=True))
    assert abs(model.stages[-1].intercept - plain.intercept) < 1e-9
