"""Train and test splits, scaling and dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed
from .windows import rows, running, whole


def file_cut(df: DataFrame, test_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """One row: the hash and path of the last path in hash order that trains, null if none does.

    The rank over all paths comes from counts of 4096 hash ranges and the rank within one, so no task sees all paths.
    """
    paths = df.where(F.col("days_until_completion").isNotNull() & F.col("path").isNotNull()).select("path").distinct().withColumn("h", file_hash(seed))
    paths = paths.withColumn("range", F.substring("h", 1, 3))
    counts = paths.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "n", F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = paths.withColumn("rn", F.row_number().over(Window.partitionBy("range").orderBy("h", "path")))
    placed = ranked.join(F.broadcast(before), "range")  # at most 4096 rows
    rank = F.col("upto") - F.col("n") + F.col("rn")
    return placed.where(rank <= F.floor(F.col("total") * F.lit(1 - test_ratio))).agg(F.max(F.struct("h", "path")).alias("_last"))


def file_hash(seed: int = 42) -> Column:
    return F.md5(F.concat(F.col("path"), F.lit(str(seed))).cast("binary"))


def split_by_file(df: DataFrame, test_ratio: float = 0.2, seed: int = 42, cut: DataFrame | None = None) -> DataFrame:
    """Adds split: the first floor(n * (1 - ratio)) labelled paths in hash order train, all rows of a path together.

    Each row is compared with the cut (see file_cut(); given, if it is stored), so rows don't move.
    """
    labelled = df.where(F.col("days_until_completion").isNotNull() & F.col("path").isNotNull())
    placed = labelled.crossJoin(F.broadcast(file_cut(df, test_ratio, seed) if cut is None else cut))  # one row
    return placed.withColumn("split", F.when(F.struct(file_hash(seed).alias("h"), "path") <= F.col("_last"), "train").otherwise("test")).drop("_last")


def split_by_history(df: DataFrame, test_ratio: float = 0.2, least: int = 5) -> DataFrame:
    """Adds split: of every labelled path with `least` rows or more, the first rows train and the rest test."""
    return placed_by_history(df.where(F.col("days_until_completion").isNotNull()), test_ratio, least).where(F.col("split").isNotNull())


def placed_by_history(df: DataFrame, test_ratio: float = 0.2, least: int = 5) -> DataFrame:
    """Adds split as split_by_history() does; rows that it leaves out stay, with null."""
    # A path's rows are labelled together or, with no date, not at all: these come first in its order and don't count.
    has = F.col("days_until_completion").isNotNull().cast("int")
    placed = df.withColumns({"_rn": F.sum(has).over(running()), "_n": F.sum(has).over(whole())})
    cut = F.least(F.floor(F.col("_n") * F.lit(1 - test_ratio)), F.col("_n") - 1)
    fits = F.col("days_until_completion").isNotNull() & (F.col("_n") >= least)
    return placed.withColumn("split", F.when(fits, F.when(F.col("_rn") <= cut, "train").otherwise("test"))).drop("_rn", "_n")


def dataset_stats(split: DataFrame) -> DataFrame:
    """Files and commits, in training, in test and together."""
    of = lambda s, c: F.when(F.col("split") == s, F.col(c))
    return split.agg(
        F.count_distinct(of("train", "path")).alias("train_files"), F.count_distinct(of("test", "path")).alias("test_files"), F.count_distinct("path").alias("total_files"),
        F.count(of("train", "path")).alias("train_commits"), F.count(of("test", "path")).alias("test_commits"), F.count("*").alias("total_commits"),
    )


def fit_scaler(train: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """One row: median and interquartile range of each column; a range of 0 counts as 1. exact=False bounds the memory."""
    quarter = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) if exact else F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000)
    q = train.agg(*[quarter(F.col(c)).alias(c) for c in columns])
    iqr = lambda c: F.col(c)[2] - F.col(c)[0]
    return q.select(*[x for c in columns for x in (F.col(c)[1].cast("double").alias(f"{c}__mid"), F.when(iqr(c) == 0, 1.0).otherwise(iqr(c)).cast("double").alias(f"{c}__iqr"))])


def scale(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    joined = df.crossJoin(F.broadcast(fitted))  # one row
    return joined.withColumns({c: (F.col(c) - F.col(f"{c}__mid")) / F.col(f"{c}__iqr") for c in columns}).drop(*fitted.columns)


def scaled(df: DataFrame, fitted: Row, columns: list[str]) -> DataFrame:
    """scale() by the scaler's row itself: no join, and no columns of the scaler in the rows."""
    number = lambda c: F.lit(fitted[c]).cast("double")
    return df.withColumns({c: (F.col(c) - number(f"{c}__mid")) / number(f"{c}__iqr") for c in columns})


def first_last(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last non-null value of each column per path, and their difference, in one aggregate."""
    at = F.struct("date", "ord")
    seen = lambda c: F.when(F.col(c).isNotNull(), at)
    found = df.groupBy("path").agg(*[x for c in columns for x in (F.min_by(c, seen(c)).alias(f"{c}_first"), F.max_by(c, seen(c)).alias(f"{c}_last"))])
    return found.withColumns({f"{c}_diff_total": F.col(f"{c}_last") - F.col(f"{c}_first") for c in columns})


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Adds place (gapless from 0) and rows (of df): range partitions are sorted side by side, and a row per partition says
    how many come before."""
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("rows"))
    return placed.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")  # a row per partition


def time_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """Adds fold: the rows by time in a first stretch (0) and k test stretches of n // (k + 1) rows (1 to k). Fold f is
    predicted from all rows with a smaller fold."""
    size = F.greatest(F.floor(F.col("rows") / (k + 1)), F.lit(1))
    first = F.col("rows") - k * size
    return in_order(df, "date", "ord").withColumn("fold", F.when(F.col("place") < first, 0).otherwise(F.floor((F.col("place") - first) / size) + 1).cast("int")).drop("place", "rows")


def group_places(df: DataFrame) -> DataFrame:
    """(path, place, rows): the paths by their first commit."""
    return in_order(df.groupBy("path").agg(F.min("date").alias("first")), "first", "path").drop("first")


def group_windows(groups: int, k: int = 5, test_ratio: float = 0.2, shift: int = 1) -> list[tuple[int, int, int]]:
    """k windows over places of groups: training from the first number up to the second, testing up to the third; each
    window is `shift` groups after the one before and the last ends with the last group."""
    test = max(1, int(groups * test_ratio))
    train = groups - test - (k - 1) * shift
    if train < 1:
        raise ValueError(f"{groups} groups are too few for {k} folds")
    return [(s * shift, s * shift + train, s * shift + train + test) for s in range(k)]


def curve_folds(df: DataFrame, shares: tuple[float, ...] = (0.1, 0.325, 0.55, 0.775, 1.0), k: int = 5) -> DataFrame:
    """Adds fold (k stretches of like size in order of time) and level, the first of the shares whose sample holds the row;
    samples are nested, drawn by hash of ord."""
    level, h = F.lit(len(shares) - 1), F.substring(F.md5(F.concat(F.col("ord").cast("string"), F.lit("42")).cast("binary")), 1, 6)
    for i in range(len(shares) - 2, -1, -1):
        level = F.when(h < F.lit(f"{int(shares[i] * (1 << 24)):06x}"), i).otherwise(level)
    return in_order(df, "date", "ord").withColumns({"fold": F.floor(F.col("place") * k / F.col("rows")).cast("int"), "level": level.cast("int")}).drop("place", "rows")
