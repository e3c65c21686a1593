"""Scalar expressions of the feature library; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def floor_days(start: Column, end: Column) -> Column:
    """Whole elapsed days, rounded down: not calendar days."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(DAY_US))).cast("long")


def extension(path: Column) -> Column:
    """The path's extension as written, or no_ext."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"\.([a-zA-Z0-9]+)$", 1), F.lit("")), F.lit("no_ext"))


def top_dir(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def has_dot(path: Column) -> Column:
    return base_name(path).contains(".")


def sanitized(name: Column) -> Column:
    r"""Letters, digits and _ of any script stay; what else there is becomes _."""
    return F.regexp_replace(name, r"(?U)\W", "_")


def table_name(repo: Column) -> Column:
    return F.replace(repo, F.lit("/"), F.lit("_"))


def author_or_committer(login: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(login, F.lit("")), name)


def log_target(days: Column) -> Column:
    return F.log1p(days.cast("double"))


def from_log(pred: Column, cap: float = 15.0) -> Column:
    """Days from a prediction on the log scale, capped first and never negative."""
    return F.greatest(F.expm1(F.least(pred, F.lit(cap))), F.lit(0.0))


def true_bin(actual: Column) -> Column:
    """Right-closed bins of the actual days; zero and over 1000 have none."""
    bounds = [(0, 30, "<30"), (30, 90, "30–90"), (90, 180, "90–180"), (180, 365, "180–365"), (365, 1000, "365+")]
    found = F.lit(None).cast("string")
    for low, high, name in reversed(bounds):
        found = F.when((actual > low) & (actual <= high), name).otherwise(found)
    return found


AGE_BINS = [(0, 30, "0-30"), (30, 90, "31-90"), (90, 180, "91-180"), (180, 365, "181-365"), (365, None, "365+")]


def age_bin(age: Column) -> Column:
    """Left-closed bins of a file's age in days."""
    found = F.lit(None).cast("string")
    for low, high, name in reversed(AGE_BINS):
        found = F.when((age >= low) & (F.lit(True) if high is None else age < high), name).otherwise(found)
    return found


def error_type(relative: Column, threshold: float = 0.2) -> Column:
    return F.when(relative > threshold, "underestimated").when(relative < -threshold, "overestimated").otherwise("ok")
