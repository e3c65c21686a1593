"""Evaluation of predictions: metrics, error slices, correlation, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S


def median_baseline(split: DataFrame, target: str = "days_until_completion") -> DataFrame:
    """Test rows with the training median of log1p(target) as their prediction on the log scale."""
    mid = split.where(F.col("split") == "train").agg(F.median(S.log_target(F.col(target))).alias("pred_log"))
    return split.where(F.col("split") == "test").crossJoin(F.broadcast(mid))  # one row


def error_frame(predicted: DataFrame, target: str = "days_until_completion", threshold: float = 0.2) -> DataFrame:
    """Adds actual, pred, residual, abs_error, relative_error, error_type, true_bin, age_bin, extension and top_dir; features ride along, no join."""
    df = predicted.withColumns({"actual": F.col(target).cast("double"), "pred": S.from_log(F.col("pred_log"))})
    df = df.withColumn("residual", F.col("actual") - F.col("pred"))
    df = df.withColumns({"abs_error": F.abs("residual"), "relative_error": F.col("residual") / (F.col("actual") + 1e-6)})
    more = {"error_type": S.error_type(F.col("relative_error"), threshold), "true_bin": S.true_bin(F.col("actual")), "extension": S.extension(F.col("path")), "top_dir": S.top_dir(F.col("path"))}
    if "age_in_days" in df.columns:
        more["age_bin"] = S.age_bin(F.col("age_in_days"))
    return df.withColumns(more)


def metrics(errors: DataFrame) -> DataFrame:
    r = F.col("residual")
    return errors.agg(F.avg(r * r).alias("mse"), F.avg("abs_error").alias("mae"), F.stddev_samp("abs_error").alias("mae_std"), F.sqrt(F.avg(r * r)).alias("rmse"), F.median("abs_error").alias("mdae"))


def by_slice(errors: DataFrame, column: str, n: int = 15) -> DataFrame:
    """Mean and sample deviation of abs_error per value, worst first, at most n; rows without a value are left out."""
    found = errors.where(F.col(column).isNotNull()).groupBy(column).agg(F.avg("abs_error").alias("mean_error"), F.stddev_samp("abs_error").alias("std_error"))
    return found.orderBy(F.desc("mean_error"), column).limit(n)


SLICES = ("extension", "top_dir", "completion_reason", "committer_grouped", "true_bin")


def all_slices(errors: DataFrame, columns: tuple[str, ...] = SLICES) -> DataFrame:
    """Every slice in one pass by grouping sets, long form."""
    columns = tuple(c for c in columns if c in errors.columns)
    sets = errors.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.avg("abs_error").alias("mean_error"), F.stddev_samp("abs_error").alias("std_error"), F.grouping_id(*columns).alias("gid"))
    which = F.lit(None).cast("string")
    for k, c in enumerate(columns):
        gid = ((1 << len(columns)) - 1) ^ (1 << (len(columns) - 1 - k))
        which = F.when(F.col("gid") == gid, c).otherwise(which)
    return sets.select(which.alias("slice"), F.coalesce(*columns).alias("value"), "mean_error", "std_error").where(F.col("value").isNotNull())


def one_slice(slices: DataFrame, column: str, n: int = 15) -> DataFrame:
    """One column's part of all_slices, as by_slice gives it."""
    found = slices.where(F.col("slice") == column).select(F.col("value").alias(column), "mean_error", "std_error")
    return found.orderBy(F.desc("mean_error"), column).limit(n)


def by_age(errors: DataFrame) -> DataFrame:
    """Error per age bin, with empty bins."""
    bins = errors.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b[2]) for b in S.AGE_BINS])).alias("age_bin"))
    found = errors.where(F.col("age_bin").isNotNull()).groupBy("age_bin").agg(F.avg("abs_error").alias("mae"), F.stddev_samp("abs_error").alias("mae_std"))
    return bins.join(found, "age_bin", "left")


def extremes(errors: DataFrame, n: int = 3, worst: bool = True) -> DataFrame:
    return errors.orderBy(F.desc("abs_error") if worst else F.asc("abs_error"), "path", "date", "ord").limit(n)


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    found = df.groupBy(column).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), column).limit(n) if n else found


def correlations(df: DataFrame, features: list[str], target: str = "days_until_completion", n: int = 20) -> DataFrame:
    """Pearson correlation with the target, pairs with a null left out: one aggregate, the n strongest. A column without
    spread has none."""

    def pearson(c: str):
        x, y = F.col(c).cast("double"), F.col(target).cast("double")
        both = x.isNotNull() & y.isNotNull()
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))).alias(c)

    one = df.agg(*[pearson(c) for c in features])
    long = one.unpivot([], features, "feature", "correlation").where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
    return long.orderBy(F.desc(F.abs("correlation")), "feature").limit(n)


def sampled(df: DataFrame, key: list[str], n: int = 500, seed: int = 42) -> DataFrame:
    """A repeatable random sample of at most n rows, by hash of the key."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary")), *key).limit(n)


def pivot_mean(df: DataFrame, row: str, column: str, values: list, of: str) -> DataFrame:
    """Mean of `of` per row value in a column per listed value (the list spares the pass that would find them)."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(of))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    return df.select(F.width_bucket(value.cast("double"), F.lit(low), F.lit(high), F.lit(bins)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


# Frames for plots


def density(df: DataFrame, group: str, value: str, low: float, high: float, width: float, points: int = 64) -> DataFrame:
    """(group, at, density): a normal kernel of the given width on a grid, for violins. Rows are counted in `points` bins
    first, so the kernels meet counts, not rows; values outside the range are left out."""
    step = (high - low) / points
    kept = df.where(F.col(group).isNotNull() & F.col(value).between(low, high))
    bins = kept.groupBy(group, F.least(F.floor((F.col(value) - low) / step), F.lit(points - 1)).alias("bin")).agg(F.count("*").alias("n"))
    at = lambda c: low + (F.col(c) + 0.5) * step
    grid = bins.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    gap = (at("to") - at("bin")) / width
    total = grid.groupBy(group, "to").agg(F.sum(F.col("n") * F.exp(-0.5 * gap * gap)).alias("k"), F.sum("n").alias("n"))
    return total.select(group, at("to").alias("at"), (F.col("k") / (F.col("n") * width * (2 * math.pi) ** 0.5)).alias("density"))


def quantile_pairs(df: DataFrame, a: str, b: str, n: int = 20) -> DataFrame:
    """(share, a, b): the same n + 1 quantiles of two columns side by side."""
    at = [k / n for k in range(n + 1)]
    one = df.agg(F.percentile(a, F.array(*[F.lit(x) for x in at])).alias("x"), F.percentile(b, F.array(*[F.lit(x) for x in at])).alias("y"))
    return one.select(F.posexplode(F.arrays_zip("x", "y")).alias("k", "p")).select((F.col("k") / n).alias("share"), F.col("p.x").alias(a), F.col("p.y").alias(b))


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of the values of a column, for pies."""
    found = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return found.select(F.col(column).alias("value"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # a row a value


def cells(df: DataFrame, x: str, y: str, x_step: float, y_step: float) -> DataFrame:
    """(x, y, n): rows per cell of a grid, the data of a scatter plot of any number of rows."""
    return df.select(F.floor(F.col(x) / x_step).alias(x), F.floor(F.col(y) / y_step).alias(y)).groupBy(x, y).agg(F.count("*").alias("n"))


def error_curve(errors: DataFrame, step: float = 30.0) -> DataFrame:
    """(actual_from, n, mean_error, mean_residual, worst): errors against the actual value, in steps."""
    at = (F.floor(F.col("actual") / step) * step).alias("actual_from")
    return errors.groupBy(at).agg(F.count("*").alias("n"), F.avg("abs_error").alias("mean_error"), F.avg("residual").alias("mean_residual"), F.max("abs_error").alias("worst"))
