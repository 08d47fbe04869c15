"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

The raw corpus and a trusted target are two multinomials over hashed one- and
two-token features. A document's score is the mean over its features of
log p(feature | target) - log p(feature | raw); documents that pass the base
rules and score at or above a fixed threshold are kept, every one by the same
deterministic rule. Everything is DataFrame expressions: counting is one pass
with map-side sums over ``BUCKETS`` keys, scoring is a map over the rows with
the ratios as one constant array.

The trusted target is every document with a good label. The distinct ids are
joined to the documents by a shuffled hash join at every size: the id list
grows with the input, so it is not broadcast, and each text is shuffled once
for the counts. The raw counts cover every document.

Defined cases: a null or blank text has no words, fails the base rules and
scores 0; without trusted documents all ratios are 0; repeated rows are judged
alike, each on its own; a null doc_id is never trusted; other columns are
carried along untouched, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm import common

BUCKETS = 16_384
SMOOTHING = 1.0
#: A document whose mean log ratio is below is rejected.
THRESHOLD = -0.3
SYMBOLS = r"[#*$%&|<>]"
#: ``common.SPACE`` with each character by itself, which Java looks up in a set; ranges it tries one by one.
SPACE = r"[ \t\n\x0B\f\r]+"
_ASCII = {c: f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()}
#: Runs of letters and digits (ASCII ones, and all beyond ASCII), and runs of ASCII marks.
TOKEN = f"[^{''.join(_ASCII.values())}]+|[{''.join(v for c, v in _ASCII.items() if 32 < c < 127)}]+"


def base_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs``), ``t`` (its text) and the base statistics.

    Repeated three-word windows are looked for where two hashes agree: there,
    (hash, place) pairs packed into one integer are sorted, and windows whose
    hashes agree are compared as text, so a hash collision never counts.
    """
    d = docs.select(F.struct("*").alias("row"), common.whole_text(F.col(text_col)).alias("t"))
    d = d.withColumn("trimmed", F.expr(r"trim(BOTH ' \t\n\u000B\f\r' FROM t)"))
    d = d.select("row", "t", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACE)).alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike(common.WORD)).alias("lines"))
    d = d.select(
        "row", "t", "words", F.size("words").alias("n"), F.length(F.bin(F.size("words").cast("long"))).alias("bits"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    d = d.withColumn("windows", F.expr(
        "transform(arrays_zip(slice(words, 1, greatest(n - 2, 0)), slice(words, 2, greatest(n - 2, 0)), slice(words, 3, n)), x -> xxhash64(x))"
    ))
    d = d.withColumn("packed", F.expr(
        "CASE WHEN size(array_distinct(windows)) < size(windows)"
        " THEN sort_array(transform(windows, (h, i) -> shiftleft(h, bits) | cast(i AS bigint))) ELSE cast(array() AS array<bigint>) END"
    )).drop("windows")
    d = d.withColumn("near", F.expr(
        "filter(packed, (x, i) -> shiftrightunsigned(x ^ get(packed, i - 1), bits) = 0 OR shiftrightunsigned(x ^ get(packed, i + 1), bits) = 0)"
    )).drop("packed")
    d = d.withColumn("near", F.expr("transform(near, x -> cast(x & (shiftleft(1L, bits) - 1) AS int))"))
    d = d.withColumn("near", F.expr(
        "sort_array(transform(near, i -> struct(concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS w, cast(i AS bigint) AS at)))"
    ))
    d = d.withColumn("at", F.expr(
        "sort_array(transform(filter(near, (x, i) -> x.w = get(near, i - 1).w OR x.w = get(near, i + 1).w), x -> x.at))"
    )).drop("near")
    d = d.withColumn("n_repeat_words", F.expr(
        "aggregate(at, struct(0L AS n, 0L AS upto), (a, p) -> struct(a.n + p + 3 - greatest(p, a.upto) AS n, p + 3 AS upto), a -> a.n)"
    )).drop("at")
    return d.select(
        "row", "t", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n"))).alias("base_failed"),
    )


def tokens(text: str):
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


#: Hashes of the features of the tokens ``k``: each token, and each token with the one before it. Their low bits are the bucket.
FEATURES = (
    "concat(transform(k, x -> xxhash64(x)),"
    " zip_with(slice(k, 1, greatest(size(k) - 1, 0)), slice(k, 2, greatest(size(k) - 1, 0)), (x, y) -> xxhash64(x, y)))"
)


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """bucket, ratio: one row for each of ``buckets`` features, whatever the corpus holds.

    ``trusted`` has the column doc_id and any number of rows.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets is a power of two")
    ids = trusted.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("trusted_id"), F.lit(False).alias("trusted_none")).distinct()
    d = docs.select(F.col(id_col).alias("id"), common.whole_text(F.col(text_col)).alias("t"))
    # rows without an id match nothing and are dealt by their text, not all to one task
    d = d.select("t", F.coalesce(F.col("id").cast("long"), F.xxhash64("t")).alias("id"), F.col("id").isNull().alias("none"))
    d = d.join(ids.hint("shuffle_hash"), (F.col("id") == F.col("trusted_id")) & (F.col("none") == F.col("trusted_none")), "left")
    # the same hashes as FEATURES, but a row for each token, so that all is compiled code: lambda functions are not
    d = d.select(F.col("trusted_id").isNotNull().cast("long").alias("in_target"), tokens("t").alias("k"))
    d = d.select("in_target", F.inline(F.expr("arrays_zip(k, slice(k, 2, size(k)))")).alias("x", "y"))
    d = d.select("in_target", F.explode(F.array(F.xxhash64("x"), F.when(F.col("y").isNotNull(), F.xxhash64("x", "y")))).alias("h")).filter("h IS NOT NULL")
    d = d.withColumn("bucket", F.col("h").bitwiseAND(F.lit(buckets - 1)).cast("int"))
    counts = d.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("in_target").alias("target"))
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    return filled.selectExpr(
        "bucket",
        f"CASE WHEN sum(target) OVER () = 0 THEN 0D ELSE ln((target + {smoothing}D) / (sum(target) OVER () + {smoothing * buckets}D))"
        f" - ln((raw + {smoothing}D) / (sum(raw) OVER () + {smoothing * buckets}D)) END AS ratio",
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of every labelled good document."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def judge(docs: DataFrame, ratio: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``row``, the base statistics, ``base_failed``, ``score`` and ``kept`` of every document."""
    table = ratio.agg(F.expr("transform(array_sort(collect_list(struct(bucket, ratio))), x -> x.ratio)").alias("r")).scalar()
    d = base_stats(docs, text_col).withColumn("k", tokens("t")).drop("t")
    d = d.withColumn("f", F.expr(FEATURES)).drop("k")
    # f is read twice here and table once below, so the optimizer puts the table into the sum instead of copying it into each row
    d = d.withColumns({"m": F.greatest(F.size("f"), F.lit(1)), "table": table})
    d = d.withColumn("score", F.expr(f"aggregate(f, 0D, (s, h) -> s + get(table, cast(h & {buckets - 1} AS int)))") / F.col("m"))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return common.sealed(d, ["row"], ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])


def kept_rows(docs: DataFrame, ratio: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return judge(docs, ratio, **how).filter("kept").select("row.*")
