"""Scans: nested file histories, generic collections, and views of the sample tables as commit facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_documents(spark: SparkSession, path: str, schema, kind: str = "json") -> DataFrame:
    """Landed store documents with a fixed schema (no inference pass)."""
    return spark.read.schema(schema).format(kind).load(path)


def explode_history(tracking: DataFrame) -> DataFrame:
    """One row per file and commit; files without history give none, missing line counts are 0."""
    e = tracking.select("path", F.posexplode("commit_history").alias("pos", "c"))
    zero = lambda c: F.coalesce(F.col(f"c.{c}"), F.lit(0)).cast("long")
    return e.select(
        F.concat_ws(":", F.lpad(F.col("pos").cast("string"), 10, "0"), "c.sha").alias("ord"), "path", F.try_to_timestamp("c.date").alias("date"),
        F.col("c.size").cast("long").alias("size"), F.col("c.committer").alias("committer"),
        zero("additions").alias("lines_added"), zero("deletions").alias("lines_deleted"), zero("total_changes").alias("line_change"),
    )


def scan(df: DataFrame, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """A filtered, projected scan; both reach the Parquet reader."""
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def key_set(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def has_commit(tracking: DataFrame, sha: str) -> DataFrame:
    """Files whose nested history holds the commit."""
    return tracking.where(F.exists("commit_history", lambda c: c["sha"] == F.lit(sha)))


def in_directory(facts: DataFrame, prefix: str) -> DataFrame:
    """Paths that begin with prefix, without a separator check; the empty prefix keeps all."""
    return facts.where(F.col("path").startswith(prefix)) if prefix else facts


ORDERS_VIEW = {
    "ord": "o_orderkey",
    "path": "concat(CASE o_custkey%4 WHEN 0 THEN 'src/core/' WHEN 1 THEN 'src/tests/' WHEN 2 THEN 'src/docs/' ELSE 'lib/.github/workflows/' END, 'file_', o_custkey, CASE o_custkey%6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.yml' WHEN 3 THEN '.JSON' WHEN 4 THEN '' ELSE '.js' END)",
    "date": "o_orderdate",
    "size": "CASE WHEN o_orderkey%11=0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END",
    "committer": "concat(o_orderpriority, CASE WHEN o_orderkey%50<47 THEN '' ELSE concat('-',o_orderkey%50,'-',o_custkey%10) END)",
    "lines_added": "o_orderkey%7",
    "lines_deleted": "o_orderkey%3",
    "line_change": "o_orderkey%7+o_orderkey%3",
}
EVENTS_VIEW = {
    "ord": "event_id",
    "path": "concat('src/u', user_id, '.py')",
    "date": "ts",
    "size": "CAST(floor(value*100) AS BIGINT)",
    "committer": "event_type",
    "lines_added": "event_id%7",
    "lines_deleted": "event_id%3",
    "line_change": "event_id%7+event_id%3",
}


def commit_facts(spark: SparkSession, sf_dir: str, view: str = "orders") -> DataFrame:
    """A sample table read as commit facts: a customer (user) is a file, an order (event) a commit."""
    exprs = ORDERS_VIEW if view == "orders" else EVENTS_VIEW
    df = table(spark, sf_dir, view).selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])
    whole = {c: F.col(c).cast("long") for c in ("ord", "size", "lines_added", "lines_deleted", "line_change")}
    return df.withColumns(whole | {"date": F.col("date").cast("timestamp")})


def content_status(records: DataFrame) -> DataFrame:
    """Size or status of landed content records (http_status, is_list, kind, size, renamed): a missing file that wasn't
    renamed counts as deleted with size 0; directories, links and odd answers are dropped."""
    status = F.when(F.col("http_status") == 404, "file_not_found").when(F.col("is_list"), "is_directory").when(F.col("kind") == "symlink", "is_symlink").when(F.col("size").isNull(), "unexpected_response")
    found = records.withColumn("status", status)
    gone = F.col("status") == "file_not_found"
    return found.where(F.col("status").isNull() | (gone & ~F.col("renamed"))).withColumn("size", F.when(gone, F.lit(0)).otherwise(F.col("size")).cast("long"))


def history_entries(commits: DataFrame, files: DataFrame) -> DataFrame:
    """One entry per commit and file of commits(sha, path, date, login, name, size): line counts of the file's entry in
    that commit, zeros if there is none. files(sha, filename, additions, deletions, changes)."""
    f = files.groupBy("sha", F.col("filename").alias("path")).agg(F.max("additions").alias("additions"), F.max("deletions").alias("deletions"), F.max("changes").alias("changes"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return commits.join(f, ["sha", "path"], "left").select("sha", "path", "date", S.author_or_committer(F.col("login"), F.col("name")).alias("committer"), "size", zero("additions").alias("additions"), zero("deletions").alias("deletions"), zero("changes").alias("total_changes"))


def paths_of_commits(full_commits: DataFrame) -> DataFrame:
    """Distinct file names of full commits whose last segment has a dot."""
    return full_commits.select(F.explode("files.filename").alias("path")).where(S.has_dot(F.col("path"))).distinct()
