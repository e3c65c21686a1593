"""What the corpus operators share: input projection, cut lineage, small tables as literals."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship  # noqa: F401  for the operators


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffles that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared checkpoint folder, so that a lost executor costs a reread only."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few longs that may be broadcast (some megabytes), keys that a join may salt, and their copies.
BROADCAST_ROWS, HEAVY_KEYS, HEAVY_LEAST, COPIES = 200_000, 4096, 256, 64


def small_join(df: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """df joined with a narrow checkpointed table: broadcast if its rows, counted first, are few enough, else by a shuffle."""
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, how)


def salted_join(many: DataFrame, one: DataFrame, key: str | list[str], how: str = "inner", by_place: bool = False) -> DataFrame:
    """many joined with one (a row per key): rows of the commonest keys of many are dealt over COPIES copies of one's row.

    The HEAVY_KEYS commonest keys, a bounded table, are known to both sides; no other key can have over a HEAVY_KEYS-th
    of the rows. Rows are dealt by what else they hold, or by their place, which parts equal rows too.
    """
    key = [key] if isinstance(key, str) else key
    counts = many.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= HEAVY_LEAST)
    heavy = cut(counts.orderBy(F.desc("_n"), *key).limit(HEAVY_KEYS).select(*key, F.lit(True).alias("_heavy")))
    if heavy.isEmpty():
        return many.join(one, key, how)
    rest = [c for c in many.columns if c not in key]
    salt = F.when(F.col("_heavy"), F.pmod(F.monotonically_increasing_id() if by_place else F.xxhash64(*rest), F.lit(COPIES)).cast("int")).otherwise(F.lit(0))
    left = many.join(F.broadcast(heavy), key, "left").withColumn("_salt", salt).drop("_heavy")
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(copies)).drop("_heavy")
    return left.join(right, [*key, "_salt"], how).drop("_salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few driver-side rows that the JVM reads from one JSON literal, without Python workers."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds number: gapless from 0 in the given order, over range partitions, so no task sees all rows."""
    spark, n = df.sparkSession, shuffle_partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(placed.select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_at")))
    first, rows = 0, []
    for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row per partition
        rows.append({"_part": r["_part"], "_first": first})
        first += r["n"]
    firsts = literal_table(spark, rows, "_part: int, _first: bigint")
    return placed.join(F.broadcast(firsts), "_part").withColumn("number", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and the text's UTF-8 bytes; whatever else the table has is dropped, so other columns can't clash."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], size: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the named column has about size bytes in each (a longer single row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    tidy()


def tidy() -> None:
    """Gives a Python worker's free memory back, which it would else hold while it waits for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def rows_out(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pinned(df: DataFrame, **columns) -> DataFrame:
    """Adds columns that are computed once per row: the optimizer neither merges them into later expressions, where a
    fold over an array would make the array anew for each element, nor moves filters on them below."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
