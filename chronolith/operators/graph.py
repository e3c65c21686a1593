"""Rename lineage and co-occurrence of files in commits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship


def lineage(renames: DataFrame) -> DataFrame:
    """renames(path, previous) -> (path, origin, depth) for every renamed path, by pointer doubling: a chain of n
    renames takes log2(n) joins, each cut to the checkpoint folder. A chain that runs in a circle raises, as no chain can
    be longer than there are renames."""
    renames = checkpointed(renames.select("path", "previous").distinct())
    now = renames.select("path", F.col("previous").alias("origin"), F.lit(1).cast("long").alias("depth"))
    for _ in range(renames.count().bit_length() + 1):
        now, open_ends = _doubled(now), renames.select(F.col("path").alias("origin"))
        if now.join(open_ends, "origin", "left_semi").isEmpty():
            return now
        if not now.where(F.col("path").eqNullSafe(F.col("origin"))).isEmpty():
            break
    raise ValueError("renames run in a circle")


def _doubled(now: DataFrame) -> DataFrame:
    """(path, origin, depth) -> the same with each origin's own origin, where it has one."""
    ahead = now.select(F.col("path").alias("origin"), F.col("origin").alias("o"), F.col("depth").alias("d"))
    n = now.join(ahead, "origin", "left")
    return checkpointed(n.select("path", F.coalesce("o", "origin").alias("origin"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")))


def full_history(entries: DataFrame, renames: DataFrame) -> DataFrame:
    """History entries of the latest paths, with those of every ancestor: reach and jumps double in step, so the longest
    chain takes log2 of its length in joins."""
    renames = checkpointed(renames.select("path", "previous").distinct())
    chain = lineage(renames)
    latest = chain.join(renames.select(F.col("previous").alias("path")), "path", "left_anti")
    deepest = latest.agg(F.max("depth")).first()[0] or 0
    reach, jump = latest.select(F.col("path").alias("head"), F.col("path").alias("at")), renames.select(F.col("path").alias("at"), F.col("previous").alias("to"))
    for k in range(deepest.bit_length()):
        if k:
            jump = checkpointed(jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("next")), "to").select("at", F.col("next").alias("to")))
        reach = checkpointed(reach.unionByName(reach.join(jump, "at").select("head", F.col("to").alias("at"))))
    return entries.join(reach, entries["path"] == reach["at"]).drop("at").withColumn("path", F.col("head")).drop("head")


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """commits(sha, path) -> (file1, file2, n): commits that hold both, file1 < file2."""
    d = pairs.select("sha", "path").distinct()
    a, b = d.select("sha", F.col("path").alias("file1")), d.select("sha", F.col("path").alias("file2"))
    return a.join(b, "sha").where(F.col("file1") < F.col("file2")).groupBy("file1", "file2").agg(F.count("*").alias("n"))


def top_pairs(pairs: DataFrame, n: int = 20) -> DataFrame:
    return cooccurrence(pairs).orderBy(F.desc("n"), "file1", "file2").limit(n)


def row_sums(cooc: DataFrame) -> DataFrame:
    both = cooc.select(F.col("file1").alias("path"), "n").unionByName(cooc.select(F.col("file2").alias("path"), "n"))
    return both.groupBy("path").agg(F.sum("n").alias("total"))


def distances(cooc: DataFrame) -> DataFrame:
    """1 - n / max(n) per pair, in long form."""
    top = cooc.agg(F.max("n").alias("top"))
    return cooc.crossJoin(F.broadcast(top)).withColumn("distance", 1 - F.col("n") / F.col("top")).drop("top")  # one row


#: Files that ward_linkage takes: a number or two for each are sent to all tasks and kept by the driver.
WARD_FILES = 200_000


def ward_linkage(distance: DataFrame) -> DataFrame:
    """distance(file1, file2, distance) of the pairs that are nearer than 1 -> merges (step, a, b, height, size), by height.

    Files that share no pair are 1 apart. a and b are the least file names of the clusters that merge. Ward's distance of two
    clusters needs the sum of 1 - distance^2 over the pairs between them and within each, so sums over the sparse
    frame are all there is to keep, and they add up when clusters merge. Each round every cluster finds its nearest
    (all clusters' sizes and inner sums are sent out, pairs without an entry need no more), and all that are each
    other's nearest merge; as Ward's distance never makes a merged cluster nearer, the order by height is the
    sequential one. Ties go to the lesser name.
    """
    spark = distance.sparkSession
    ship(spark)
    pairs = distance.where("file1 <> file2").select(F.least("file1", "file2").alias("a"), F.greatest("file1", "file2").alias("b"), (1 - F.col("distance") * F.col("distance")).alias("s"))
    pairs = checkpointed(pairs.groupBy("a", "b").agg(F.max("s").alias("s")))
    found = pairs.select("a").union(pairs.select("b")).distinct().orderBy("a").limit(WARD_FILES + 1)
    names = [r[0] for r in found.collect()]  # bounded by WARD_FILES
    kind = pairs.schema["a"].dataType.simpleString()
    if len(names) > WARD_FILES:
        raise ValueError(f"over {WARD_FILES} files")
    if len(names) < 2:
        return spark.createDataFrame([], f"step int, a {kind}, b {kind}, height double, size long")
    number = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"i long, name {kind}"))  # as many as names
    pairs = checkpointed(pairs.join(number.toDF("i", "a"), "a").join(number.toDF("j", "b"), "b").select("i", "j", "s"))
    size, inner, alive, done = np.ones(len(names)), np.ones(len(names)), np.arange(len(names)), []
    while len(alive) > 1:
        to = np.arange(len(names))
        for i, j, height, s in _mutual(spark, pairs, alive, size, inner):
            to[j] = i
            size[i] += size[j]
            inner[i] += inner[j] + 2 * s
            done.append((height, names[i], names[j], int(size[i])))
        alive = alive[to[alive] == alive]
        sent = F.broadcast(spark.createDataFrame([(int(j), int(to[j])) for j in np.flatnonzero(to != np.arange(len(names)))], "x long, y long"))  # merges of the round
        for c in ("i", "j"):
            pairs = pairs.join(sent.withColumnRenamed("x", c), c, "left").withColumn(c, F.coalesce("y", c)).drop("y")
        pairs = checkpointed(pairs.where("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("s").alias("s")))
    rows = [(k, a, b, h, n) for k, (h, a, b, n) in enumerate(sorted(done), 1)]
    return spark.createDataFrame(rows, f"step int, a {kind}, b {kind}, height double, size long")


def _mutual(spark, pairs: DataFrame, alive: np.ndarray, size: np.ndarray, inner: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Clusters that are each other's nearest: numbers i < j, their distance and the sum over the pairs between them."""
    place = np.zeros(len(size), np.int64)
    place[alive] = np.arange(len(alive))
    sent = spark.sparkContext.broadcast((alive, place, size[alive], inner[alive] / size[alive] ** 2))
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    every = F.broadcast(spark.createDataFrame([(int(i),) for i in alive], "i long"))  # bounded by WARD_FILES
    near = both.groupBy("i").agg(F.collect_list(F.struct("j", "s")).alias("near"))
    near = near.unionByName(every.join(both, "i", "left_anti").withColumn("near", F.lit(None).cast(near.schema["near"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alive, place, size, mean = sent.value
        for batch in batches:
            out = []
            for i, near in zip(batch.column("i").to_pylist(), batch.column("near").to_pylist(), strict=True):
                k = place[i]
                d, s = size[k] * size / (size[k] + size) * (mean[k] + mean), np.zeros(len(size))
                if near:
                    s[place[[n["j"] for n in near]]] = [n["s"] for n in near]
                    d -= 2 * s / (size[k] + size)
                d[k] = np.inf
                at = int(np.argmin(np.round(d, 12)))
                out.append((i, int(alive[at]), math.sqrt(max(float(d[at]), 0.0)), float(s[at])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=["i", "j", "height", "s"])

    nearest = {r.i: r for r in near.mapInArrow(run, "i long, j long, height double, s double").collect()}  # a row a cluster
    sent.unpersist()
    return [(i, r.j, r.height, r.s) for i, r in sorted(nearest.items()) if i < r.j and nearest[r.j].j == i]
