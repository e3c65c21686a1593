"""Writes as set operations: each takes the stored table and a batch and returns the table after the write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_absent(target: DataFrame, batch: DataFrame, key: str = "sha", order: list[str] | None = None) -> DataFrame:
    """Adds the batch's rows whose key isn't stored; the first of equal keys in a batch wins."""
    order = order or [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
    return target.unionByName(first.join(target.select(key), key, "left_anti"))


def overwrite(target: DataFrame, batch: DataFrame, key: str = "path", seq: str | None = None) -> DataFrame:
    """Sets the batch's non-null fields on equal keys and adds the others; the last of equal keys in a batch wins.

    Last is by seq, which isn't stored; without it by the rows' own fields, so that a key never has two rows. Fields that
    the target lacks are added to it.
    """
    rest = [c for c in batch.columns if c not in (key, seq)]
    last = F.struct(F.coalesce(F.col(seq).isNotNull(), F.lit(False)), seq, *rest) if seq else F.struct(*rest)
    batch = batch.groupBy(key).agg(F.max_by(F.struct(*rest), last).alias("r")).select(key, "r.*")
    t, b = target.alias("t"), batch.alias("b")
    kept = [F.coalesce(F.col(f"b.{c}"), F.col(f"t.{c}")).alias(c) if c in batch.columns else F.col(f"t.{c}") for c in target.columns]
    kept += [F.col(f"b.{c}") for c in rest if c not in target.columns]
    return t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer").select(*kept)


def append_entries(target: DataFrame, batch: DataFrame, key: str = "path", items: str = "commit_history", upsert: bool = False) -> DataFrame:
    """Adds the batch's array to the stored one; unknown keys are added only with upsert."""
    b = batch.select(key, F.col(items).alias("_more"))
    joined = target.join(b, key, "full_outer" if upsert else "left")
    empty = F.expr("array()").cast(target.schema[items].dataType)
    return joined.withColumn(items, F.concat(F.coalesce(items, empty), F.coalesce(F.col("_more"), empty))).drop("_more")


def replace_entries(target: DataFrame, batch: DataFrame, key: str = "path", items: str = "commit_history") -> DataFrame:
    return overwrite(target, batch.select(key, items), key)


def rename(target: DataFrame, renames: DataFrame) -> DataFrame:
    """Renames documents by renames(path, new_path); the old path joins previous_paths."""
    found = target.join(renames, "path", "left")
    old = F.concat(F.coalesce("previous_paths", F.expr("cast(array() as array<string>)")), F.array("path"))
    return found.withColumn("previous_paths", F.when(F.col("new_path").isNotNull(), old).otherwise(F.col("previous_paths"))).withColumn("path", F.coalesce("new_path", "path")).drop("new_path")


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is left, and a one-row count of what went."""
    return target.join(keys.select(key).distinct(), key, "left_anti"), target.join(keys.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("deleted"))


def missing(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted and not stored."""
    return wanted.select(key).distinct().join(stored.select(key), key, "left_anti")


def existing(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(stored.select(key), key, "left_semi")


def feature_records(features: DataFrame, key: str = "path", order: tuple = ("date", "ord")) -> DataFrame:
    """A file's feature rows as one array of records in time order."""
    rest = [c for c in features.columns if c != key and c not in order]
    return features.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("features"))


def latest(df: DataFrame, key: str = "path", order: tuple = ("date", "ord")) -> DataFrame:
    """The last row of each key: one aggregate, no sort."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
