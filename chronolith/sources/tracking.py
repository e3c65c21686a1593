"""File tracking from nested full commits: renames, deletions and missing content in one plan.

A name may stand for several files one after another: each rename away from it ends one of its lives. A commit's file
meets the life that its name has at that commit, counted by a running sum over the name's own commits, so no join by
time ranges is needed; renames link lives, and pointer doubling gives each the last life of its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators.graph import lineage
from ..session import checkpointed
from .history import content_status

CONTENT = "sha string, path string, http_status int, is_list boolean, kind string, size long"


def commit_files(commits: DataFrame) -> DataFrame:
    """(sha, pos, date, committer, path, status, previous, additions, deletions, changes): a row per file of nested full
    commits; commits without files give none, and neither do files without a name."""
    c = commits.select("sha", F.try_to_timestamp("commit.author.date").alias("date"), S.author_or_committer(F.col("committer.login"), F.col("commit.committer.name")).alias("committer"), F.posexplode("files").alias("pos", "f"))
    zero = lambda n: F.coalesce(F.col(f"f.{n}"), F.lit(0)).cast("long").alias(n)
    return c.select("sha", "pos", "date", "committer", F.col("f.filename").alias("path"), F.col("f.status").alias("status"), F.col("f.previous_filename").alias("previous"), zero("additions"), zero("deletions"), zero("changes")).where("path is not null")


def lives(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with life, the number of renames away from their name before them; and renames (path, previous) of lives, as
    structs of name and number."""
    moved = (F.col("status") == "renamed") & F.col("previous").isNotNull() & (F.col("previous") != F.col("path"))
    plain = files.select("*", F.lit(0).alias("out"), F.col("path").alias("name"))
    away = files.where(moved).select("*", F.lit(1).alias("out"), F.col("previous").alias("name"))
    w = Window.partitionBy("name").orderBy("date", "sha", "pos", "out").rowsBetween(Window.unboundedPreceding, -1)
    both = plain.unionByName(away).withColumn("life", F.struct("name", F.coalesce(F.sum("out").over(w), F.lit(0)).alias("number")))
    both = checkpointed(both.drop("name"))
    touched, left = both.where("out = 0").drop("out"), both.where("out = 1").select("sha", "pos", F.col("life").alias("from_life"))
    renames = touched.join(left, ["sha", "pos"]).select(F.col("from_life").alias("path"), F.col("life").alias("previous"))
    return touched, renames


def entries(commits: DataFrame, content: DataFrame) -> DataFrame:
    """One row per commit of a file: head (the file's last life: name and number), path at that commit, and entry, a struct
    that begins with date and sha.

    content(CONTENT) answers for (sha, path). A missing file counts as deleted, with size 0; the commit that renames a file
    has no entry if its content is missing; directories, links, odd answers and files without an answer have no entry.
    """
    files, renames = lives(commit_files(commits))
    # Links lead forward in time, so what lineage calls the origin is the last life of the file.
    last = lineage(renames).select(F.col("path").alias("life"), F.col("origin").alias("head"))
    placed = files.join(last, "life", "left").withColumn("head", F.coalesce("head", "life"))
    answers = content.dropDuplicates(["sha", "path"])
    known = content_status(placed.join(answers, ["sha", "path"]).withColumn("renamed", F.coalesce(F.col("status") == "renamed", F.lit(False))).drop("status"))
    entry = F.struct(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), "sha", "committer", "size", "additions", "deletions", F.col("changes").alias("total_changes"))
    return known.select("head", "path", entry.alias("entry"))


def tracked(commits: DataFrame, content: DataFrame) -> DataFrame:
    """One row per file under its last name: path, previous_paths (former names, sorted) and commit_history by date, of
    entries(). A file's whole history is one value here; summaries() needs no such value."""
    names = F.array_sort(F.array_except(F.collect_set("path"), F.array(F.first("head.name"))))
    found = entries(commits, content).groupBy("head").agg(names.alias("previous_paths"), F.array_sort(F.collect_list("entry")).alias("commit_history"))
    return found.select(F.col("head.name").alias("path"), "previous_paths", "commit_history")


def summaries(commits: DataFrame, content: DataFrame) -> DataFrame:
    """Per file of tracked() its path, numbers of former names and entries, sums of size and additions, and the first entry's
    committer, added up where the entries are: no history is gathered in one row."""
    found = entries(commits, content)
    other = F.when(F.col("path") != F.col("head.name"), F.col("path"))
    by = found.groupBy("head").agg(F.count_distinct(other).alias("previous"), F.count("*").alias("entries"), F.sum("entry.size").alias("size"), F.sum("entry.additions").alias("additions"), F.min("entry").alias("first"))
    return by.select(F.col("head.name").alias("path"), "previous", "entries", "size", "additions", F.col("first.committer").alias("first_committer"))
