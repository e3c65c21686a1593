"""When and why a file is complete: a stable tail, a deletion, or a long idle time, in that order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .windows import rows, whole


@dataclass(frozen=True)
class LabelConfig:
    min_commits: int = 3
    min_days: int = 14
    idle_days: int = 30
    percentage_change: float = 0.15
    cutoff_quantile: float = 0.95
    least_cutoff: int = 30
    most_cutoff: int = 365


def inactivity_cutoff(df: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """One row: the exact quantile of non-zero intervals, clipped and cut to whole days; no interval gives the least."""
    q = F.percentile(F.nullif(F.col("commit_interval_days"), F.lit(0)), F.lit(config.cutoff_quantile))
    clipped = F.least(F.lit(float(config.most_cutoff)), F.greatest(F.lit(float(config.least_cutoff)), F.coalesce(q, F.lit(float(config.least_cutoff)))))
    return df.agg(F.floor(clipped).cast("long").alias("cutoff"))


def label(df: DataFrame, as_of: str, config: LabelConfig | None = None) -> DataFrame:
    """Adds completion_date and completion_reason to rows that carry commit_interval_days; as_of stands for now."""
    if "commit_interval_days" not in df.columns:
        raise ValueError("commit_interval_days must be there before labelling")
    c = config or LabelConfig()
    now = F.lit(as_of).cast("timestamp")
    cols = df.columns
    df = df.withColumns({
        "_rn": F.row_number().over(rows()), "_next": F.lead("date").over(rows()),
        "_thr": F.greatest(F.lit(3.0), F.percentile("line_change", F.lit(0.5)).over(whole()) * c.percentage_change),
        "_n": F.count(F.lit(1)).over(whole()), "_first": F.min("date").over(whole()), "_last": F.max("date").over(whole()),
        "_last_size": F.last("size").over(whole()),
    })
    # The stable tail: what follows the last row over the threshold. Rows without a date come first, so where that row's
    # next has none, the first date of the tail is the file's.
    bad = F.when(~(F.col("line_change") <= F.col("_thr")), F.col("_rn"))
    df = df.withColumns({"_bad": F.coalesce(F.max(bad).over(whole()), F.lit(0)), "_next": F.max_by("_next", bad).over(whole())})
    df = df.withColumn("_from", F.when(F.col("_bad") < F.col("_n"), F.coalesce("_next", "_first")))
    idle = S.floor_days(F.col("_last"), now)
    stable = (F.col("_n") - F.col("_bad") >= c.min_commits) & (S.floor_days(F.col("_from"), F.col("_last")) >= c.min_days) & (idle >= c.idle_days) & (F.col("_last_size") != 0)
    df = df.crossJoin(F.broadcast(inactivity_cutoff(df, c)))  # one row
    reason = F.when(stable, "stable_line_change").when(F.col("_last_size") == 0, "deleted").when(idle > F.col("cutoff"), "idle_timeout")
    df = df.withColumn("completion_reason", reason)
    return df.withColumn("completion_date", F.when(F.col("completion_reason").isNotNull(), F.col("_last"))).select(*cols, "completion_date", "completion_reason")


def add_target(df: DataFrame) -> DataFrame:
    """days_until_completion: whole days to completion, never negative, null without a label."""
    days = F.when(F.col("completion_date").isNotNull(), F.greatest(F.lit(0).cast("long"), S.floor_days(F.col("date"), F.col("completion_date"))))
    return df.withColumn("days_until_completion", days)


def targeted(as_of: str, config: LabelConfig | None = None):
    """label() and add_target() as a step of a frame."""
    return lambda df: add_target(label(df, as_of, config))


def per_file(df: DataFrame) -> DataFrame:
    return df.groupBy("path").agg(F.max("completion_date").alias("completion_date"), F.max("completion_reason").alias("completion_reason"))


def completion_summary(df: DataFrame) -> DataFrame:
    """Files per reason, with the totals and the completed share in per cent."""
    files = per_file(df)
    totals = files.agg(F.count("*").alias("total_files"), F.count("completion_reason").alias("completed_files"))
    totals = totals.withColumn("completion_ratio", F.try_divide(F.col("completed_files") * 100.0, F.col("total_files")))
    by = files.where(F.col("completion_reason").isNotNull()).groupBy("completion_reason").agg(F.count("*").alias("files"))
    return by.crossJoin(F.broadcast(totals))
