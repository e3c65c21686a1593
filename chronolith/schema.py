"""Schemas of the history tables and the names of their columns."""

from __future__ import annotations

from pyspark.sql import types as T

HISTORY_ENTRY = T.StructType([
    T.StructField("sha", T.StringType()), T.StructField("date", T.StringType()), T.StructField("committer", T.StringType()),
    T.StructField("size", T.LongType()), T.StructField("additions", T.LongType()), T.StructField("deletions", T.LongType()), T.StructField("total_changes", T.LongType()),
])
FILE_TRACKING = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("previous_paths", T.ArrayType(T.StringType())), T.StructField("commit_history", T.ArrayType(HISTORY_ENTRY)),
])
COMMIT_FILE = T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("status", T.StringType()), T.StructField("previous_filename", T.StringType()),
    T.StructField("additions", T.LongType()), T.StructField("deletions", T.LongType()), T.StructField("changes", T.LongType()),
])
FULL_COMMIT = T.StructType([
    T.StructField("sha", T.StringType()),
    T.StructField("commit", T.StructType([
        T.StructField("author", T.StructType([T.StructField("date", T.StringType())])),
        T.StructField("committer", T.StructType([T.StructField("name", T.StringType())])),
    ])),
    T.StructField("committer", T.StructType([T.StructField("login", T.StringType())])),
    T.StructField("files", T.ArrayType(COMMIT_FILE)),
])
#: The commit fact frame; ord breaks ties of date.
FACTS = ("ord", "path", "date", "size", "committer", "lines_added", "lines_deleted", "line_change")
NOT_FEATURES = ("ord", "path", "date", "completion_date", "completion_reason", "days_until_completion", "committer", "size")
