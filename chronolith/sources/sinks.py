"""Sinks: named reports as CSV, the flat feature table, the results ledger, model files."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml.boosting import Boosted
from ..ml.trees import Tree

_NODES = "tree int, node int, feature long, threshold double, left long, right long, value double, cover double"


def write_csv(df: DataFrame, path: str) -> None:
    """A report, replaced if it is there."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def write_features(df: DataFrame, path: str, project: str) -> None:
    """The flat feature table, one folder per project; a project's rows are replaced, the others stay."""
    df.withColumn("project", F.lit(project)).write.mode("overwrite").options(**plain_doubles(df)).option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def plain_doubles(df: DataFrame) -> dict[str, str]:
    """Options of a writer that stores doubles, of many values, as they are: looking each up in a dictionary took longer
    than the rest of the file, in writing and reading."""
    return {f"parquet.enable.dictionary#{f.name}": "false" for f in df.schema.fields if f.dataType.typeName() == "double"}


def read_features(spark: SparkSession, path: str, project: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("project") == project).drop("project")


def record_result(metrics: DataFrame, path: str, project: str, model: str, split: str, configuration: str, stamp: str) -> None:
    """One row of the results ledger, of a one-row frame of metrics. The row has a folder of its own, named by its key, so
    that jobs may write side by side and one that is run again replaces its row."""
    key = {"project": project, "model": model, "split_strategy": split, "configuration": configuration, "timestamp": stamp}
    entry = hashlib.md5("\0".join(key.values()).encode()).hexdigest()
    metrics.select(*[F.lit(v).alias(k) for k, v in key.items()], "*").coalesce(1).write.mode("overwrite").parquet(f"{path}/entry={entry}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("entry")


def save_model(spark: SparkSession, model: PipelineModel | Boosted, path: str) -> None:
    """Spark's models by their own writer, boosted trees as a table of nodes and one of columns, as large as the model."""
    if not isinstance(model, Boosted):
        model.write().overwrite().save(path)
        return
    nodes = [(k, n, int(t.feature[n]), float(t.threshold[n]), int(t.left[n]), int(t.right[n]), float(t.value[n]), float(t.cover[n])) for k, t in enumerate(model.trees) for n in range(len(t.feature))]
    spark.createDataFrame(nodes, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    rows = [(k, c, float(g), float(model.base)) for k, (c, g) in enumerate(zip(model.columns, model.gains, strict=True))]
    spark.createDataFrame(rows, "place int, column string, gain double, base double").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def load_model(spark: SparkSession, path: str, boosted: bool = False) -> PipelineModel | Boosted:
    """A model that save_model wrote; boosted says that it is one of boosted trees."""
    if not boosted:
        return PipelineModel.load(path)
    columns = spark.read.parquet(f"{path}/columns").orderBy("place").collect()  # as large as the model
    trees: dict[int, list[tuple]] = {}
    for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
        trees.setdefault(r.tree, []).append((r.feature, r.threshold, r.left, r.right, r.value, r.cover))
    return Boosted([r.column for r in columns], columns[0].base, [Tree.of(trees[k]) for k in sorted(trees)], np.array([r.gain for r in columns]))
