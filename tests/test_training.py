"""A training run from facts to files: configuration, ledger, reports, stored models, a second run with the same stamp."""

import os

import pytest
from pyspark.sql import functions as F

from chronolith import training as T
from chronolith.ml import boosting
from chronolith.ml import models as M
from chronolith.operators import errors as E
from chronolith.operators import splits as P
from chronolith.plans import sql as Q
from chronolith.sources import history as H
from chronolith.sources import sinks

CONFIG = {
    "labelling": {"min_commits": 4},
    "projects": [
        {
            "name": "one/project", "directory": "src/", "ablation": True, "generators": ["CommitHistory", "FilePath"],
            "groups": {"extensions": ["ext_"], "age": ["age_in_days"]},
            "models": [{"model": "median", "split": "by_history"}, {"model": "linear_regression", "split": "by_history"}],
        },
        {"name": "two", "models": [{"model": "xgboost", "params": {"n_estimators": 2}}]},
    ],
}


def test_configuration():
    one, two = T.projects_of(CONFIG)
    assert one.labelling.min_commits == two.labelling.min_commits == 4 and one.labelling.min_days == 14
    assert one.jobs == (T.Job("median", "by_history"), T.Job("linear_regression", "by_history")) and two.jobs[0].split == "by_file"
    assert T.projects_of({}) == []


@pytest.mark.parametrize("job", [{"model": "oracle"}, {"model": "median", "split": "by_moon"}, {"model": "median", "trials": 3}])
def test_unknown_names_raise(job):
    with pytest.raises(ValueError):
        T.projects_of({"projects": [{"name": "p", "models": [job]}]})
    with pytest.raises(TypeError):
        T.projects_of({"projects": [{"name": "p", "colour": "red"}]})


def test_chosen_by_name_and_prefix():
    columns = ["ext_py", "ext", "size", "size_diff", "lag_1_size"]
    assert M.chosen(columns, ["ext_", "size"]) == ["ext_py", "size"]
    assert M.chosen(columns, []) == []


@pytest.fixture(scope="module")
def done(spark, small, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("run"))
    project = T.projects_of(CONFIG)[0]
    ledger = T.run(spark, H.commit_facts(spark, small), project, at, "s1", Q.AS_OF)
    return at, project, {(r.model, r.configuration): r for r in ledger.collect()}


def test_ledger_has_a_row_for_each_job_and_configuration(done):
    assert set(done[2]) == {("median", "ALL"), ("linear_regression", "ALL"), ("linear_regression", "all_except_extensions"), ("linear_regression", "all_except_age")}
    assert all(r.project == "one/project" and r.timestamp == "s1" and r.mae >= 0 for r in done[2].values())


def test_reports_are_files_and_agree_with_the_errors(spark, done):
    at, _, ledger = done
    base = f"{at}/one%2Fproject/s1"
    for name in ("median-by_history-ALL", "linear_regression-by_history-ALL"):
        errors = spark.read.parquet(f"{base}/errors/{name}")
        assert errors.where(~F.col("path").startswith("src/")).isEmpty()
        row = ledger[(name.split("-")[0], "ALL")]
        assert E.metrics(errors).first().mae == pytest.approx(row.mae)
        for column in ("true_bin", "extension", "top_dir", "completion_reason"):
            got = sinks.read_csv(spark, f"{base}/reports/{name}/{T.SLICE_REPORTS[column]}", f"{column} string, mean_error double, std_error double")
            want = E.by_slice(errors, column)
            assert [(r[0], round(r[1], 6)) for r in got.collect()] == [(r[0], round(r[1], 6)) for r in want.collect()]
        worst = sinks.read_csv(spark, f"{base}/reports/{name}/worst_predictions").collect()
        assert worst[0].abs_error == pytest.approx(errors.agg(F.max("abs_error")).first()[0])
        stored = spark.read.parquet(f"{base}/features").select("ord", F.col("age_in_days").alias("days"))
        assert errors.join(stored, "ord").where("age_in_days <> days").isEmpty()  # of days, not of scaled values
    importance = sinks.read_csv(spark, f"{base}/reports/linear_regression-by_history-ALL/feature_importance")
    assert importance.count() > 3 and set(importance.columns) == {"feature", "importance"}
    stats = sinks.read_csv(spark, f"{base}/reports/dataset_statistics_by_history").first()
    assert stats.test_commits == spark.read.parquet(f"{base}/errors/median-by_history-ALL").count()
    assert os.path.exists(f"{base}/reports/completion_summary/_SUCCESS")


def test_a_run_that_is_started_again_replaces_what_it_wrote(spark, small, done):
    at, project, ledger = done
    again = T.Project(project.name, (T.Job("median", "by_history"),), project.directory, project.generators, labelling=project.labelling)
    facts = H.commit_facts(spark, small)
    now = {(r.model, r.configuration): r for r in T.run(spark, facts, again, at, "s1", Q.AS_OF).collect()}
    assert now == ledger
    T.run(spark, facts, again, at, "s2", Q.AS_OF)
    assert sinks.read_results(spark, f"{at}/results").count() == len(ledger) + 1


def test_a_stored_model_serves_files_without_a_label(spark, small, done):
    at, project, _ = done
    p = T.prepare(spark, H.commit_facts(spark, small), project, at, "s3", Q.AS_OF)
    rows = T.split_and_scaled(spark, p, "by_history")
    job = T.Job("linear_regression", "by_history")
    _, model = T.scored(rows, job, p.columns, f"{p.at}/models/linear_regression-by_history-ALL")
    open_files = p.rows.where("days_until_completion IS NULL").select("path").distinct().count()
    served = T.serve(spark, p, job)
    assert served.count() == open_files and served.where("predicted_days_until_completion < 0").isEmpty()
    loaded = sinks.load_model(spark, f"{p.at}/models/linear_regression-by_history-ALL")
    assert loaded.stages[-1].coefficients == model.stages[-1].coefficients


def test_boosted_trees_are_stored_whole(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("ord"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("days_until_completion", F.col("a") * 10 + F.col("b"))
    model = M.fit(rows, ["a", "b"], "xgboost", n_estimators=3)
    sinks.save_model(spark, model, f"{tmp_path}/m")
    loaded = sinks.load_model(spark, f"{tmp_path}/m", boosted=True)
    assert loaded.columns == ["a", "b"] and loaded.featureImportances == model.featureImportances
    score = lambda m: [r.pred_log for r in M.predict(m, rows, ["a", "b"]).orderBy("ord").collect()]
    assert score(loaded) == score(model)


def test_features_of_other_projects_stay(spark, tmp_path):
    at = f"{tmp_path}/f"
    for project, n in (("a", 3), ("b", 2), ("a", 4)):
        sinks.write_features(spark.range(n), at, project)
    assert sinks.read_features(spark, at, "a").count() == 4 and sinks.read_features(spark, at, "b").count() == 2


def test_configurations_of_a_boosted_model_share_the_binned_rows(spark, small, tmp_path, monkeypatch):
    times, binned = [], boosting.binned
    monkeypatch.setattr(boosting, "binned", lambda *a: times.append(1) or binned(*a))
    job = T.Job("xgboost", "by_history", {"n_estimators": 2, "max_depth": 3, "colsample_bytree": 0.5})
    project = T.Project("p", (job,), generators=("CommitHistory", "FilePath"), ablation=True, groups={"extensions": ["ext_"], "age": ["age_in_days"]})
    facts = H.commit_facts(spark, small)
    T.run(spark, facts, project, str(tmp_path), "s", Q.AS_OF)
    assert len(times) == 1
    p = T.prepare(spark, facts, project, str(tmp_path), "t", Q.AS_OF)
    train = T.split_and_scaled(spark, p, "by_history").where("split = 'train'")
    for name, columns in T.configurations(p).items():
        got, alone = sinks.load_model(spark, f"{tmp_path}/p/s/models/xgboost-by_history-{name}", boosted=True), M.fit(train, columns, "xgboost", **job.params)
        assert got.columns == alone.columns == columns and got.base == pytest.approx(alone.base)
        for a, b in zip(got.trees, alone.trees, strict=True):
            assert a.feature.tolist() == b.feature.tolist() and a.value.tolist() == pytest.approx(b.value.tolist())


def test_rows_are_split_where_they_lie(spark, small, done):
    at, project, _ = done
    p = T.prepare(spark, H.commit_facts(spark, small), project, at, "s4", Q.AS_OF)
    for split in T.SPLITS:
        rows = T.split_and_scaled(spark, p, split)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Window" not in plan
        assert not os.path.exists(f"{p.at}/rows")  # nor are they written once more
        assert {r.split for r in rows.select("split").distinct().collect()} == {"train", "test"}
    want = P.split_by_history(p.rows).select("ord", "split")
    got = T.split_and_scaled(spark, p, "by_history").select("ord", "split")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
