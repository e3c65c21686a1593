import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from chronolith.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(catalog.oracle_sql()) >= 60


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.count() == 3 and "completion_reason" in got.columns


def test_imports_without_the_corpus_side(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/chronolith", tmp_path / "chronolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'labels' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(x, 5) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", ["history_features_subday", "feature_frame", "path_onehot", "size_features", "size_ema", "line_features", "committer_features", "labels", "completion_summary", "split_history", "split_file", "error_frame", "upsert_insert_absent", "upsert_overwrite_repeated", "rename_lineage", "stream_activity", "feature_correlation", "full_history", "cooccurrence_topk", "file_tracking", "time_folds", "group_folds", "curve_folds", "plot_violin", "plot_quantiles", "plot_shares", "plot_residuals", "plot_error_curve", "feature_correlation_all", "training_run", "shap_given", "stream_upsert"])
def test_same_rows_as_sql(spark, small, con, name):
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())
