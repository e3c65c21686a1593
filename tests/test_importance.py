import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from chronolith.ml import models as M
from chronolith.operators import splits as P
from chronolith.plans import catalog


def test_permutation_importance_asks_for_all_columns(spark, small, monkeypatch):
    asked = []
    monkeypatch.setattr(catalog.M, "permutation_importance", lambda model, df, columns: [(c, 0.0) for c in asked.extend(columns) or columns])
    monkeypatch.setattr(catalog.M, "fit", lambda *a, **k: None)
    got = {r.feature for r in catalog.queries()["permutation_importance"](spark, small).collect()}
    _, columns, groups = catalog.modelled(spark, small)
    assert any(c.startswith("ext_") for c in columns) and any(c.startswith("committer_") for c in columns)
    assert asked == columns and got == set(columns)
    assert all(got & set(cs) for cs in groups.values()) and len(groups) == 5


class Sum:
    """A model whose prediction on the log scale is a / 10 - b / 20."""

    def transform(self, df):
        return df.withColumn("pred_log", F.col("a") / 10 - F.col("b") / 20)


def spark_hash(n: int, seed: int) -> int:
    """xxhash64 of Spark over (n, seed): each value is hashed with the last hash as its seed, the second as an int."""
    h = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), 42)
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def test_permutation_importance_against_plain_reckoning(spark):
    import math

    rows = [(i, f"p{i % 5}", float(i * 7 % 23), float(i * 5 % 11), float(i % 3), i * 13 % 40) for i in range(80)]
    df = spark.createDataFrame(rows, "ord long, path string, a double, b double, c double, days_until_completion int").repartition(3)
    got = dict(M.permutation_importance(Sum(), df, ["a", "b", "c"]))
    order = sorted(rows, key=lambda r: (spark_hash(r[0], 42), r[0]))
    error = lambda r: abs(r[5] - max(math.expm1(min(r[2] / 10 - r[3] / 20, 15)), 0))
    base = sum(map(error, rows)) / len(rows)
    for name, at in (("a", 2), ("b", 3), ("c", 4)):
        mixed = [(*r[:at], order[k - 1][at], *r[at + 1 :]) for k, r in enumerate(order)]
        assert got[name] == pytest.approx(sum(map(error, mixed)) / len(rows) - base)
    assert got["c"] == pytest.approx(0) and got["a"] > 0
    assert M.permutation_importance(Sum(), df.limit(0), ["a"]) == []


def test_frame_of_models_in_plain_columns_without_joins(spark, small):
    df, columns, groups = catalog.modelled(spark, small)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # the scaler is in the expressions
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    at = next(f for f in df.inputFiles() if f.endswith(".parquet")).removeprefix("file://").removeprefix("file:")
    group = pq.ParquetFile(at).metadata.row_group(0)
    coded = {c.path_in_schema: any("DICTIONARY" in e for e in c.encodings) for c in map(group.column, range(group.num_columns))}
    assert kinds["ema_7_size"] == "double" and not any(coded[c] for c, kind in kinds.items() if kind == "double")
    assert coded["path"]


def test_scaling_by_the_row_itself(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 0.5), (4.0, 0.5), (7.5, 0.5)], "a double, b double")
    fitted = P.fit_scaler(df, ["a", "b"])
    assert P.scaled(df, fitted.first(), ["a", "b"]).collect() == P.scale(df, fitted, ["a", "b"]).collect()
    nothing = P.fit_scaler(df.limit(0), ["a", "b"]).first()
    assert {tuple(r) for r in P.scaled(df, nothing, ["a", "b"]).collect()} == {(None, None)}
