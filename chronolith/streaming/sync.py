"""Incremental sync as a stream: landed commits are deduplicated and added to the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from ..sources.upserts import insert_absent


def landed(spark: SparkSession, folder: str, schema, kind: str = "parquet", files: str | None = None, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(kind)
    if files:
        r = r.option("pathGlobFilter", files)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.load(folder)


#: Parts of a store, by hash of the key. Fixed once a store is written.
PARTS = 64


def upsert_stream(stream: DataFrame, store: str, checkpoint: str, key: str = "sha", event_time: str | None = None, lateness: str = "10 minutes", parts: int = PARTS):
    """Starts a run over what has landed: insert-if-absent by key, exactly once per batch number.

    Each batch writes its own folder of new rows, so a batch that is run again after a failure replaces what it wrote. Rows
    lie in parts by hash of their key, and a batch reads the keys of the parts that it has rows for. A null key is a key
    that nothing equals: its rows are added by each batch that has some, one row a batch.
    """
    if event_time:
        stream = stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    kept = T.StructType([f for f in stream.schema.fields if f.name == key] + [T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType())])
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(store)  # a store without rows can be read

    def add(batch: DataFrame, number: int) -> None:
        batch = checkpointed(batch.withColumn("part", part))
        touched = [r.part for r in batch.select("part").distinct().collect()]  # at most `parts`
        known = batch.sparkSession.read.schema(kept).parquet(store).where(F.col("part").isin(touched) & (F.col("batch") != number))
        fresh = batch.join(known.select(key), key, "left_anti")
        first = insert_absent(fresh.limit(0), fresh, key, [c for c in fresh.columns if c not in (key, "part")])
        first.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str, schema) -> DataFrame:
    """The rows of a store, of any number of batches."""
    wide = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType())])
    return spark.read.schema(wide).parquet(store).drop("batch", "part")


def store_activity(counts: DataFrame, store: str, checkpoint: str):
    """Starts a run that stores the counts that each batch changes, in a folder of its own: a batch that is run again after
    a failure replaces what it wrote, and the watermark lets the stream forget windows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, store: str, value: str = "n") -> DataFrame:
    """The last stored value of every window and key."""
    found = spark.read.option("basePath", store).parquet(store)
    return found.groupBy(*[c for c in found.columns if c not in (value, "batch")]).agg(F.max_by(value, "batch").alias(value))


def activity(stream: DataFrame, time: str, key: str, window: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Commits per key and tumbling window, for late data up to the watermark."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
