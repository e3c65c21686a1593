r"""Quality rules: base counts, and a hashed n-gram likelihood ratio between a trusted target and the raw corpus.

Words are runs of [^\x20\x09-\x0D]. Each word and each pair of neighbours falls into one of BUCKETS hash buckets;
two multinomials over the buckets are counted, of the trusted documents and of all documents, with additive
smoothing. A document's score is the mean over its n-grams of log p_target - log p_raw, in whole units of 2^-20, so
sums have no rounding order and the comparison with the threshold is exact. A document fails only if its n-grams are,
in geometric mean, over e^0.25 times likelier in the raw corpus than in the target.

Trusted are all documents with a label of quality 1 and toxic not 1, so both multinomials cover all rows. Their ids are
broadcast while they are few (BROADCAST_ROWS, some megabytes), else they meet the documents by a shuffle. Everything is DataFrame functions: one counting pass with a map-side sum per bucket,
one scoring pass without a shuffle.

Defined cases: null and empty texts have no words and fail the base rule; without trusted documents every ratio is
zero and the base rule decides alone; rows that repeat count as often as they are there; a text of any length is counted
and scored whole, in one row; an empty table gives none; the columns that judging adds may be there under the same names:
keep_passing returns the rows as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, pinned, salted_join

BUCKETS, SMOOTH, UNIT, THRESHOLD = 1 << 16, 1.0, 1 << 20, -0.25
#: White space between words, beside the space itself.
SPACES, SYMBOLS = "\t\n\x0b\x0c\r", "#*$%&|<>"


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def with_words(docs: DataFrame) -> DataFrame:
    """Adds _words, _h (their hashes) and _h2 (hashes of neighbour pairs)."""
    text = text_of(docs)
    for c in SPACES:  # a split at one plain character needs no regular expression
        text = F.replace(text, F.lit(c), F.lit(" "))
    df = pinned(docs, _words=F.array_remove(F.split(text, " "), ""))
    df = pinned(df, _h=F.transform("_words", lambda w: F.xxhash64(w)))
    return pinned(df, _h2=joined("_h", "_h", 1))


def joined(a: str, b: str, lag: int) -> Column:
    """Hashes of a[i] and b[i + lag], for all i where both are there."""
    n = F.greatest(F.size(b) - lag, F.lit(0))
    n = F.least(n, F.size(a))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(lag + 1), n), lambda x, y: F.xxhash64(x, y))


def with_base(df: DataFrame) -> DataFrame:
    """Adds the base counts to rows that have _words, _h and _h2."""
    window = 5
    text = text_of(df)
    bare = lambda x: F.trim(x, F.lit(" " + SPACES))
    symbols = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    df = pinned(pinned(df, _h4=joined("_h2", "_h2", 2)), _g=joined("_h4", "_h", 4))
    df = pinned(
        df, _lines=F.filter(F.split(text, "\n"), lambda x: bare(x) != ""), _n=F.size(F.array_distinct("_g")),
        n_words=F.size("_words").cast("long"), word_chars=F.char_length(F.array_join("_words", "")).cast("long"), n_symbols=symbols.cast("long"),
    )
    # Only texts with a repeated window sort their windows; the others are known to have none from the distinct count.
    at = F.sort_array(F.transform(F.col("_g"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = pinned(df, _s=F.when(F.col("_n") < F.size("_g"), at), n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    s = F.col("_s")
    last = F.size(s) - 1
    twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
    df = pinned(df, _p=F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_p", start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")), lambda a: a["n"])
    df = pinned(df, n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"))
    return pinned(df, base_failed=(F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).drop("_g", "_h4", "_lines", "_s", "_p", "_n")


def bucket(h: Column, buckets: int) -> Column:
    """The bucket of a hash: its lowest bits."""
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").cast("long").alias("_id")).distinct().withColumn("_trusted", F.lit(1).cast("long"))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_id, text, _trusted) of every row: 1 or null."""
    docs, known = docs.select(F.col("doc_id").cast("long").alias("_id"), "text"), cut(trusted_ids(labels))
    if known.count() <= common.BROADCAST_ROWS:
        return docs.join(F.broadcast(known), "_id", "left")
    none = docs.where("_id is null").withColumn("_trusted", F.lit(None).cast("long"))  # else all in one task
    return salted_join(docs.where("_id is not null"), known, "_id", "left").select("_id", "text", "_trusted").unionByName(none)


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: weights, the log ratio of every bucket in whole units."""
    rows = with_words(marked(docs, labels))
    seen = rows.select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode_outer(F.concat("_h", "_h2")).alias("h")).where("h is not null").select("t", bucket(F.col("h"), buckets).alias("b"))
    counts = cut(seen.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target")))  # one row a bucket, read twice
    sums = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    share = lambda n, of: (F.coalesce(F.col(n), F.lit(0)) + SMOOTH) / (F.coalesce(F.col(of), F.lit(0)) + SMOOTH * buckets)
    both = every.join(counts, "b", "left").crossJoin(F.broadcast(sums))  # one row
    log = F.when(F.coalesce(F.col("all_target"), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.log(share("target", "all_target")) - F.log(share("raw", "all_raw")))
    weight = F.round(log * UNIT).cast("long")
    return both.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", weight.alias("w")))), lambda x: x["w"]).alias("weights"))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text and a struct row, if there is one) with the base counts, llr (mean per n-gram) and kept."""
    docs = docs.select("doc_id", "text", *[c for c in docs.columns if c == "row"])
    weights = cut(ratios(docs, labels, buckets)).scalar()
    # The subquery's one value is read by reference inside the fold; no row carries the table.
    df = with_base(with_words(docs)).withColumn("_t", weights)
    df = pinned(df, _w=F.aggregate(F.concat("_h", "_h2"), F.lit(0).cast("long"), lambda a, h: a + F.get("_t", bucket(h, buckets))))
    n = (F.size("_h") + F.size("_h2")).cast("long")
    kept = ~F.col("base_failed") & (F.col("_w") >= F.lit(round(threshold * UNIT)) * n)
    return pinned(df, llr=F.when(n > 0, F.col("_w") / (n * F.lit(UNIT))), kept=kept).drop("_words", "_h", "_h2", "_w", "_t")


def keep_passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # own names, as docs may have a column called kept
    plain = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("row"))
    return judged(plain, labels).where("kept").select(*[F.col(f"row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = read("documents").select("doc_id", "text")
    return judged(docs, read("labels")).select("doc_id", *COUNTS, "base_failed", "kept", "llr")
