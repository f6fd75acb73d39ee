"""Quality rules: counts of a text and a hashed n-gram log-likelihood ratio; DataFrame functions only.

Words and pairs of neighbouring words are hashed into `buckets`. Two multinomials are counted over
them: one from the whole raw corpus (add-one smoothed), one from the trusted target documents, mixed
with a share `MIXED` of the raw one. So an n-gram that the target lacks counts against a text, by
log(MIXED), however rare it is elsewhere; shares, not counts, are compared, and the ratio means the
same at any size of either. A text's score is the sum of log(target / raw) over its n-grams, divided
by their number. It is kept if the score reaches the threshold.

The threshold follows by rule: it is the score that all but `HELD_OUT_LOST` of the trusted documents
reach that were held out of the target (a quarter of them by hash, all that pass the base rules). They
are scored as any other document is, and their quantile is exact at any number of them.

Counting and scoring explode the word hashes of a text into rows, so that both run in generated code;
the table of ratios is one row of fixed size and is broadcast.

Cases: a null text has no words, fails the base rules and scores 0.0; an empty one likewise.
Repeated rows are judged alike, each for itself. An empty table gives an empty result. With no
trusted document every ratio is 0. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import exact_quantiles
from ..session import stored
from .columns import sized, without_breaks, words

BUCKETS = 1 << 20
#: Share of the raw corpus in the target's multinomial.
MIXED = 0.1
#: A quarter of the trusted documents set the threshold; so much of them is lost.
HELD_OUT_OF, HELD_OUT_LOST = 4, 0.01
MIN_WORDS, REPEAT_PERCENT = 50, 50
COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(1 + by), F.size(a))


def slot(h: Column, buckets: int) -> Column:
    """The bucket of an n-gram's hash; buckets is a power of two."""
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def neighbours(df: DataFrame, array: str, *keep: str, outer: bool = False) -> DataFrame:
    """keep, and each element of an array (a) with the next one (b; null at the end)."""
    both = F.arrays_zip(F.col(array).alias("a"), shifted(F.col(array), 1).alias("b"))
    return df.select(*keep, (F.inline_outer if outer else F.inline)(both).alias("a", "b"))


def with_repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words, from the word hashes _w.

    These are the words in a 3-word window found twice or more in the text, the first one
    included. Only texts with equal windows go on to the sort.
    """
    keep = df.columns
    heads = F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0)))
    all_ = df.select(*keep, F.transform(heads, lambda h, i: F.xxhash64(h, F.get("_w", i + 1), F.get("_w", i + 2))).alias("_all"))
    some = all_.select(*keep, F.when(F.size(F.array_distinct("_all")) < F.size("_all"), F.col("_all")).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    ranked = some.select(*keep, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("_r"))
    # a window equal to the next or the previous one in hash order is found again
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    pairs = ranked.select(*keep, "_r", F.zip_with("_r", shifted(F.col("_r"), 1), lambda a, b: F.struct(a.getField("h").alias("h"), a.getField("i").alias("i"), b.getField("h").alias("next"))).alias("_n"))
    near = pairs.select(*keep, F.zip_with("_n", F.slice(F.concat(nothing, "_r"), F.lit(1), F.size("_r")), lambda a, b: F.when((a.getField("h") == a.getField("next")) | (a.getField("h") == b.getField("h")), a.getField("i"))).alias("_i"))
    # sorted starts: each window adds the words that the one before it doesn't hold
    at = near.select(*keep, F.sort_array(F.filter("_i", lambda i: i.isNotNull())).alias("_a"))
    held = F.zip_with("_a", shifted(F.col("_a"), 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)).cast("long"))
    return at.select(*keep, F.aggregate(held, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("n_repeat_words"))


def gram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: n-gram counts of all documents and of those whose doc_id is in `trusted`.

    At most `buckets` rows, from partial sums before the shuffle. The trusted ids are broadcast only
    if they are counted to be few enough; else texts and ids meet by shuffle.
    """
    target = sized(trusted.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().withColumn("_t", F.lit(1)))
    marked = docs.select("doc_id", "text").join(target, "doc_id", "left")
    split = marked.select(F.coalesce("_t", F.lit(0)).alias("_t"), words(F.col("text")).alias("_ws"))
    hashed = neighbours(split, "_ws", "_t").select("_t", F.xxhash64("a").alias("a"), F.when(F.col("b").isNotNull(), F.xxhash64("b")).alias("b"))
    one = slot(F.col("a"), buckets)
    two = F.when(F.col("b").isNotNull(), slot(F.xxhash64("a", "b"), buckets))
    grams = hashed.select("_t", F.explode(F.array(one, two)).alias("bucket")).filter(F.col("bucket").isNotNull())
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_t").alias("target"))


def ratio_table(counts: DataFrame, buckets: int = BUCKETS, mixed: float = MIXED) -> DataFrame:
    """One row: ratios, the array of log(target / raw) of all buckets; 0 for all if no document is trusted."""
    counts = stored(counts, "rules-counts", compression="zstd")
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    one = every.join(counts, "bucket", "left").agg(F.sort_array(F.collect_list(rows)).alias("rows"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target"))
    shift = F.lit(1 - mixed) * (F.col("raw") + buckets) / F.col("target")
    ratio = lambda x: F.log(F.col("shift") * x["target"] / (x["raw"] + 1) + F.lit(mixed))
    made = one.select("rows", F.when(F.col("target") > 0, shift).alias("shift"))
    return stored(made.select(F.transform("rows", lambda x: F.coalesce(F.round(ratio(x), 9), F.lit(0.0))).alias("ratios")), "rules-ratios", compression="zstd")


def judge(docs: DataFrame, ratios: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """COUNTS, llr (mean log ratio) and key (hash of the text) of every document; ratios: one row with the array of all buckets' ratios."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        F.xxhash64("text").alias("key"),
        words(F.col("text")).alias("_ws"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("_lines"),
        F.length(without_breaks(text)).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    counted = split.select("doc_id", "key", "word_chars", "n_symbols", F.size("_ws").cast("long").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.transform("_ws", lambda w: F.xxhash64(w)).alias("_w"))
    # a row number for each document: what a text explodes into is summed where it lies
    whole = with_repeated_words(counted).withColumn("_at", F.monotonically_increasing_id())
    each = neighbours(whole, "_w", "_at", "doc_id", "key", "word_chars", "n_symbols", "n_words", "n_dup_lines", "n_repeat_words", outer=True)
    # one row, broadcast once: as a scalar subquery each use of it would be a literal of the tasks' binary
    each, table = each.crossJoin(F.broadcast(ratios.select(F.col("ratios").alias("_ratios")))), F.col("_ratios")
    value = F.coalesce(F.get(table, slot(F.col("a"), buckets)), F.lit(0.0)) + F.coalesce(F.when(F.col("b").isNotNull(), F.get(table, slot(F.xxhash64("a", "b"), buckets))), F.lit(0.0))
    summed = each.groupBy("_at").agg(F.sum(value).alias("_sum"), *[F.first(c).alias(c) for c in ("doc_id", "key", "word_chars", "n_symbols", "n_words", "n_dup_lines", "n_repeat_words")])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    mean = F.coalesce(F.try_divide(F.col("_sum"), (2 * F.col("n_words") - 1).cast("double")), F.lit(0.0))
    return summed.withColumn("base_failed", failed).select(*COUNTS, F.when(F.col("n_words") > 0, mean).otherwise(0.0).alias("llr"), "key")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the trusted documents that only set the threshold."""
    return F.pmod(F.xxhash64(doc_id), F.lit(HELD_OUT_OF)) == 2


def threshold_of(judged: DataFrame, trusted: DataFrame) -> float:
    """The score that all but HELD_OUT_LOST of the held-out trusted documents reach; 0 if none passes the base rules."""
    ids = trusted.select("doc_id").filter(F.col("doc_id").isNotNull() & held_out(F.col("doc_id"))).distinct()
    own = judged.filter(~F.col("base_failed")).select("doc_id", "llr").join(sized(ids), "doc_id", "left_semi")
    rows = exact_quantiles(stored(own.select("llr"), "rules-held-out"), [], "llr", {"low": HELD_OUT_LOST}).collect()  # one row
    low = rows[0]["low"] if rows else None
    return 0.0 if low is None else low


def verdicts(docs: DataFrame, trusted: DataFrame, buckets: int, threshold: float | None) -> DataFrame:
    """COUNTS, llr, key and kept of every document."""
    target = trusted if threshold is not None else trusted.filter(~held_out(F.col("doc_id")))
    judged = judge(docs.select("doc_id", "text"), ratio_table(gram_counts(docs, target, buckets), buckets), buckets)
    if threshold is None:
        judged = stored(judged, "rules-judged", compression="zstd")
        threshold = threshold_of(judged, trusted)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.round("llr", 6) >= F.round(F.lit(float(threshold)), 6)))


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """Judges every document of docs; trusted has the doc_id of the target documents. COUNTS, llr and kept."""
    return verdicts(docs, trusted, buckets, threshold).drop("key")


def accepted(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns: those whose doc_id and text were kept."""
    kept = verdicts(docs, trusted, buckets, threshold).filter("kept").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    kept = stored(kept, "rules-kept", compression="zstd")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_h"))
    # by shuffle at any size: what is kept grows with the input
    return keyed.join(kept.hint("merge"), F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k")), "left_semi").select("row.*")
