"""URL filters against dated lists: an as-of join of captures with the entries that were active at fetch time.

A list is a log of dated changes: an entry (a host, or a host and the first folders of a path) is added with an
action, or removed. Changes of one entry become validity intervals [from, to); of changes at the same moment the
removal comes last. A capture's keys are its host, every parent domain, and the host with every leading folder of its
path. Intervals are cut at month borders, so captures and intervals meet by equality on (key, month) and only the few
changes within one month are compared; keys that no list entry has go before the join, and a hot host is spread over
its months and, where it is among the commonest keys, over copies of the few intervals that it meets. Of the entries active at fetch time the one with the longest key decides.

Defined cases: a null, empty or unparseable URL, or a null fetch time, matches nothing and is kept; list rows with a
null entry or date are ignored; repeated changes count once; captures that repeat are each judged; URLs of any length
are read whole; an empty table gives no rows, an empty list keeps all; captures keep their columns, whatever these are
called: where they have an entry or action of their own, those of the list come as list_entry and list_action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, literal_table, salted_join, small_join

FOREVER = "9999-12-31 00:00:00"
URL = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.$", "")


def keys(url: Column) -> Column:
    """All entries that would match the URL: parent domains and leading folders, lower-case host, path as it is."""
    h = host(url)
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.filter(F.split(F.regexp_extract(url, URL, 2), "/"), lambda x: x != "")
    paths = F.when(F.size(folders) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(folders), F.lit(1))), lambda i: F.concat(h, F.lit("/"), F.array_join(F.slice(folders, F.lit(1), i), "/"))))
    none = F.expr("cast(array() as array<string>)")
    return F.when(F.coalesce(h, F.lit("")) != "", F.array_distinct(F.concat(parents, F.coalesce(paths, none)))).otherwise(none)


def intervals(changes: DataFrame) -> DataFrame:
    """changes(entry, action, at): action null removes -> (entry, action, valid_from, valid_to)."""
    name = F.concat(F.lower(F.regexp_extract("entry", "^[^/]*", 0)), F.regexp_extract("entry", "/.*$", 0))  # the host in lower case, the path as it is
    c = changes.select(F.when(F.col("entry").isNotNull(), name).alias("entry"), "action", F.col("at").cast("timestamp").alias("at")).where("entry is not null and at is not null").distinct()
    last = c.groupBy("entry", "at").agg(F.max(F.struct(F.col("action").isNull().alias("gone"), "action")).alias("x")).select("entry", "at", F.col("x.action").alias("action"))
    to = F.lead("at").over(Window.partitionBy("entry").orderBy("at"))
    return last.withColumn("valid_to", F.coalesce(to, F.lit(FOREVER).cast("timestamp"))).where("action is not null").select("entry", "action", F.col("at").alias("valid_from"), "valid_to")


def as_of(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """captures(row, url, fetched_at) -> (row, entry, action) for every list entry that was active at fetch time.

    Months run from the first to the last fetch, so an open interval is cut into no more pieces than captures span.
    """
    c = captures.select("row", "url", F.col("fetched_at").cast("timestamp").alias("t"))
    span = c.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo is not null")
    month = lambda x: F.date_trunc("month", x)
    held = intervals(changes).crossJoin(F.broadcast(span)).where("valid_to > lo and valid_from <= hi")  # one row
    cells = F.sequence(month(F.greatest("valid_from", "lo")), month(F.least("valid_to", "hi")), F.expr("interval 1 month"))
    held = held.select("entry", "action", "valid_from", "valid_to", F.explode(cells).alias("month"))
    asked = c.where("t is not null").select("row", "t", month(F.col("t")).alias("month"), F.explode(keys(F.col("url"))).alias("entry"))
    listed = cut(held.select("entry").distinct())
    asked = small_join(asked, listed, ["entry"], "left_semi").select("row", "t", "month", "entry")
    return salted_join(asked, held, ["entry", "month"]).where("t >= valid_from and t < valid_to").select("row", "entry", "action")


def filter_captures(captures: DataFrame, changes: DataFrame, default: str = "keep") -> DataFrame:
    """captures with the longest entry active at fetch time and its action; default where none is active."""
    names = [f"c{i}" for i in range(len(captures.columns))]
    whole = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(captures.columns, names, strict=True)])
    c = cut(captures.select(whole.alias("capture"), "url", "fetched_at", F.monotonically_increasing_id().alias("row")))  # the numbers must not change between two reads
    best = as_of(c, changes).groupBy("row").agg(F.max(F.struct(F.length("entry").alias("n"), "entry", "action")).alias("x"))
    taken = {x.lower() for x in captures.columns}
    entry, action = (x if x not in taken else f"list_{x}" for x in ("entry", "action"))
    own = [F.col(f"capture.{n}").alias(x) for x, n in zip(captures.columns, names, strict=True)]
    return c.join(best, "row", "left").select(*own, F.col("x.entry").alias(entry), F.coalesce("x.action", F.lit(default)).alias(action))


#: Dated changes of the list that the query applies.
CHANGES = [
    ("spam-farm.example.org", "block", "2024-01-01"), ("spam-farm.example.org", None, "2024-05-15"), ("spam-farm.example.org", "block", "2024-08-01"),
    ("cheap-pills.example.com", "block", "2024-02-10"), ("cheap-pills.example.com", None, "2024-11-20"),
    ("example.net", "review", "2024-03-01"), ("example.net", None, "2024-09-30"), ("blog.tionsh.example.com", "block", "2024-04-01"),
    ("blog.tionsh.example.com/en", "keep", "2024-06-01"), ("tionble.example.org/fr", "block", "2024-01-20"), ("m.ththth.example.net", "block", "2024-07-01"),
    ("m.ththth.example.net", "review", "2024-10-01"), ("ththan.example.com/de", "review", "2024-02-29"),
]


def op9_url_lists(spark, sf_dir: str) -> DataFrame:
    """pages as captures: the fetch time is set from the id, the list is CHANGES."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919 % 527040) * 60)
    changes = literal_table(spark, [{"entry": e, "action": a, "at": f"{t} 00:00:00"} for e, a, t in CHANGES], "entry: string, action: string, at: string")
    found = filter_captures(pages.select("page_id", "url", at.alias("fetched_at")), changes)
    return found.select("page_id", F.unix_micros("fetched_at").alias("fetched_us"), "entry", "action")


ORACLE = f"""
WITH ch(entry, action, day) AS (VALUES {', '.join(f"('{e}', {f"'{a}'" if a else 'NULL'}, TIMESTAMP '{t}')" for e, a, t in CHANGES)}),
iv AS (SELECT entry, action, day AS f, coalesce(lead(day) OVER (PARTITION BY entry ORDER BY day), TIMESTAMP '9999-12-31') AS u FROM ch),
p AS (SELECT page_id, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 527040) AS t, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT page_id, arg_max(entry, length(entry)) AS entry, arg_max(action, length(entry)) AS action FROM p JOIN iv ON action IS NOT NULL AND t >= f AND t < u
  AND CASE WHEN contains(entry, '/') THEN starts_with(host || path || '/', entry || '/') ELSE host = entry OR suffix(host, '.' || entry) END GROUP BY page_id)
SELECT p.page_id, epoch_us(t) AS fetched_us, m.entry, coalesce(m.action, 'keep') AS action FROM p LEFT JOIN m USING (page_id)
"""
