"""The five feature generators over commit facts; all are window expressions and projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import checkpointed
from .registry import apply_each, register
from .windows import part, rows, running, trailing, whole

MIN_COMMITS = 5


def at_least(df: DataFrame, n: int = MIN_COMMITS) -> DataFrame:
    """Rows of paths with n commits or more."""
    return df.withColumn("_n", F.count(F.lit(1)).over(part())).where(F.col("_n") >= n).drop("_n")


def add_history(df: DataFrame, windows: tuple[int, ...] = (30, 90)) -> DataFrame:
    df = df.withColumns({"commit_num": F.row_number().over(rows()).cast("long"), "_prev": F.lag("date").over(rows()), "_first": F.min("date").over(whole())})
    df = df.withColumn("commit_interval_days", F.coalesce(S.floor_days(F.col("_prev"), F.col("date")), F.lit(0)).cast("long")).drop("_prev")
    df = df.withColumns({
        "max_commit_interval_to_date": F.max("commit_interval_days").over(running()),
        "is_first_commit": F.when(F.col("commit_interval_days") == 0, 1).otherwise(0),
        "std_commit_interval": F.coalesce(F.stddev_samp("commit_interval_days").over(running()), F.lit(0.0)),
        "avg_commit_interval": F.avg("commit_interval_days").over(running()),
    })
    # Range frames need a single order key; they come after the row frames, whose finer order serves them.
    for w in windows:
        before = F.expr(f"count(1) OVER (PARTITION BY path ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {int(w)} DAYS PRECEDING)")
        df = df.withColumn(f"commits_last_{w}d", F.col("commit_num") - before)
    df = df.withColumns({f"commits_ratio_{w}d": F.coalesce(F.col(f"commits_last_{w}d") / F.col("commit_num"), F.lit(0.0)) for w in windows} | {"age_in_days": S.floor_days(F.col("_first"), F.col("date")), "weekday": F.weekday("date"), "month": F.month("date")})
    surge = {"recent_commit_activity_surge": F.col("commits_ratio_30d") - F.col("commits_ratio_90d")} if {30, 90} <= set(windows) else {}
    return df.withColumns({"commits_per_day_so_far": F.col("commit_num") / (F.col("age_in_days") + 1)} | surge).drop("_first")


def top_extensions(df: DataFrame, n: int = 15) -> DataFrame:
    """The n commonest extensions by rows; ties by name."""
    return df.groupBy(S.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(n)


PATH_FLAGS = ("in_test_dir", "in_docs_dir", "is_config_file", "is_markdown", "is_github_workflow", "is_readme")


def add_path(df: DataFrame) -> DataFrame:
    low = F.lower("path")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return df.withColumns({
        "path_depth": F.regexp_count("path", F.lit("/")).cast("long"),
        "in_test_dir": flag(low.rlike("[/_]tests?[/_]")),
        "in_docs_dir": flag(low.rlike("/(?:docs|documentation)/")),
        "is_config_file": flag(low.rlike(r"\.(json|yaml|yml|ini|toml|cfg|conf)$")),
        "is_markdown": flag(low.endswith(".md") | low.endswith(".markdown")),
        "is_github_workflow": flag(low.contains(".github/workflows/")),
        "is_readme": flag(low.contains("readme")),
    })


def one_hot(df: DataFrame, column: str, prefix: str, values: list[str]) -> DataFrame:
    """A Boolean column per value; the vocabulary is given, so training and serving agree."""
    return df.withColumns({f"{prefix}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)) for v in sorted(values)})


def add_extension_flags(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """ext_* columns for a fitted vocabulary (at most 15 names); other extensions go to ext_other, if there are any."""
    ext = S.extension(F.col("path"))
    df = df.withColumn("_ext", F.when(ext.isin([v for v in vocabulary if v != "other"]), ext).otherwise("other"))
    return one_hot(df, "_ext", "ext", vocabulary).drop("_ext")


def extension_vocabulary(df: DataFrame, n: int = 15) -> list[str]:
    found = [r.ext for r in top_extensions(df, n + 1).collect()]  # n + 1 rows
    return found[:n] + (["other"] if len(found) > n else [])


def significant_committers(df: DataFrame, share: float = 0.01) -> DataFrame:
    """Committers of at least `share` of all rows: at most 1 / share of them."""
    total = df.agg(F.count("*").alias("total"))
    counts = df.where(F.col("committer").isNotNull()).groupBy("committer").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).where(F.col("n") / F.col("total") >= share).select("committer", S.sanitized(F.col("committer")).alias("name"))


def add_committer(df: DataFrame, significant: DataFrame) -> DataFrame:
    """committer_grouped by a broadcast of at most 1 / share names."""
    names = F.broadcast(significant.select("committer", F.col("name").alias("_name")))
    return df.join(names, "committer", "left").withColumn("committer_grouped", F.coalesce("_name", F.lit("other"))).drop("_name")


def with_sizes(df: DataFrame) -> DataFrame:
    """Numeric sizes; rows whose size isn't a number go."""
    return df.withColumn("size", F.col("size").try_cast("double")).where(F.col("size").isNotNull())


def add_size(df: DataFrame, window: int = 7, lags: int = 5, recent: int = 5, also: dict[str, Column] | None = None) -> DataFrame:
    """also: further columns over windows, which share the sizes' pass."""
    df, x = with_sizes(df), F.col("size")
    last, median = trailing(window), f"rolling_{window}_median_size"
    df = df.withColumns({
        "size_diff": F.coalesce(x - F.lag(x).over(rows()), F.lit(0.0)),
        "cumulative_size": F.sum(x).over(running()),
        "cumulative_mean_size": F.avg(x).over(running()),
        "cumulative_std_size": F.coalesce(F.stddev_samp(x).over(running()), F.lit(0.0)),
        f"rolling_{window}_mean_size": F.avg(x).over(last),
        f"rolling_{window}_std_size": F.coalesce(F.stddev_samp(x).over(last), F.lit(0.0)),
        f"rolling_{window}_max_size": F.max(x).over(last),
        f"rolling_{window}_min_size": F.min(x).over(last),
        median: F.sort_array(F.array_compact(F.array(x, *[F.lag(x, k).over(rows()) for k in range(1, window)]))),
        **{f"lag_{k}_size": F.coalesce(F.lag(x, k).over(rows()), F.lit(0.0)) for k in range(1, lags + 1)},
        "percentage_change_size": F.coalesce(F.try_divide(x, F.lag(x).over(rows())) - 1, F.lit(0.0)),
        **(also or {}),
    })
    # A median over a sliding frame would fill a map for each row; so far the column holds the sorted sizes.
    middle = lambda up: F.element_at(median, F.floor((F.size(median) + up) / 2).cast("int"))
    df = df.withColumn(median, F.when(F.size(median) % 2 == 1, middle(1)).otherwise(middle(0) * 0.5 + middle(2) * 0.5))
    df = df.withColumns({"_recent": F.sum("size_diff").over(trailing(recent)), "_total": F.sum("size_diff").over(running())})
    return df.withColumn("recent_growth_ratio", F.col("_recent") / F.when(F.col("_total") == 0, 1e-9).otherwise(F.col("_total"))).drop("_recent", "_total")


def add_ema(df: DataFrame, window: int = 7, column: str = "size") -> DataFrame:
    """Exponential average y0 = x0, y = a x + (1 - a) y, a = 2 / (window + 1).

    Folded over a bounded trailing frame: what lies before it weighs less than a double's precision, so a file of any
    length costs a constant per row.
    """
    return folded(df.withColumn("_xs", remembered(window, column)), window)


def remembered(window: int, column: str = "size") -> Column:
    """The values that still count in an exponential average."""
    a = 2.0 / (window + 1)
    frame = trailing(2 + int(-37 / math.log(1 - a)) if a < 1 else 1)  # (1 - a)^n < e^-37
    return F.collect_list(F.col(column).cast("double")).over(frame)


def folded(df: DataFrame, window: int) -> DataFrame:
    """The exponential average of the values in _xs, which goes."""
    a = 2.0 / (window + 1)
    ema = F.aggregate(F.slice(F.col("_xs"), 2, 1 << 30), F.col("_xs")[0], lambda y, x: x * a + y * (1 - a))
    return df.withColumn(f"ema_{window}_size", ema).drop("_xs")


def add_lines(df: DataFrame) -> DataFrame:
    added, deleted = F.col("lines_added"), F.col("lines_deleted")
    total = added + deleted
    df = df.withColumns({
        "add_ratio": added / F.when(total == 0, 1e-9).otherwise(total.cast("double")),
        "pure_addition": F.when((added > 0) & (deleted == 0), 1).otherwise(0),
        "pure_deletion": F.when((deleted > 0) & (added == 0), 1).otherwise(0),
    })
    return df.withColumns({f"cum_{c}": F.sum(c).over(running()) for c in ("lines_added", "lines_deleted", "line_change", "pure_addition", "pure_deletion")})


@register("CommitHistory")
def _history(df: DataFrame) -> tuple[DataFrame, list[str]]:
    return add_history(df), ["is_first_commit"]


@register("FilePath")
def _path(df: DataFrame) -> tuple[DataFrame, list[str]]:
    return _path_of(df)(df)


def _path_of(df: DataFrame):
    """The generator with the vocabulary of df: it needs no window, so it can come last."""
    words = extension_vocabulary(df)
    return lambda rows: (add_extension_flags(add_path(rows), words), [*PATH_FLAGS, *[f"ext_{w}" for w in sorted(words)]])


_path.late = _path_of


@register("FileSize")
def _size(df: DataFrame) -> tuple[DataFrame, list[str]]:
    return folded(add_size(df, also={"_xs": remembered(7)}), 7), []


@register("LineChange")
def _lines(df: DataFrame) -> tuple[DataFrame, list[str]]:
    return add_lines(df), ["pure_addition", "pure_deletion"]


@register("Committer")
def _committer(df: DataFrame) -> tuple[DataFrame, list[str]]:
    known = significant_committers(df)
    names = sorted({r.name for r in known.collect()} | {"other"})  # at most 101
    if names == ["other"]:
        return df, []
    return one_hot(add_committer(df, known), "committer_grouped", "committer", names).drop("committer"), [f"committer_{n}" for n in names]


def feature_frame(facts: DataFrame, generators: list[str] | None = None, label=None) -> tuple[DataFrame, list[str]]:
    """Facts of files with enough commits, with the columns of the wanted generators and of label (see apply_each). The
    facts are stored once, as vocabularies, labels and windows read them one after another."""
    df, found = apply_each(checkpointed(at_least(facts)), generators, label)
    return df, [c for _, flags in found.values() for c in flags]


def filled(df: DataFrame, but: tuple[str, ...] = ("days_until_completion",)) -> DataFrame:
    """Nulls of numeric columns as 0, but for the target."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short") and f.name not in but]
    return df.fillna(0.0, subset=numeric)
