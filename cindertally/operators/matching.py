"""Name matching: fragments in names, once or not at all; pairs by derived names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Characters of a gram.
GRAM = 3


def grams(text: Column, n: Column) -> Column:
    """The distinct runs of n characters (0 to GRAM; n = 0: one empty run) of a text, in linear time."""
    chars = F.split(text, "")  # an array, since a substring of a long text is found by counting from its start

    def run(k: int) -> Column:
        out = chars
        for j in range(1, k):  # shifted arrays, so that the split isn't made anew for each place
            out = F.zip_with(out, F.slice(chars, F.lit(j + 1), F.size(chars)), lambda x, y: F.concat(x, y))
        return F.array_compact(out)

    out = F.when(n == 0, F.array(F.lit("")))
    for k in range(1, GRAM + 1):
        out = out.when((n == k) & (F.length(text) >= k), F.array_distinct(run(k)))
    return F.coalesce(out, F.array().cast("array<string>"))


def fragment_hits(fragments: DataFrame, names: DataFrame, fragment: str, name: str) -> DataFrame:
    """Every (fragment, name) where the name contains it, over an inverted index of grams.

    A fragment is looked up by the rarest of its grams (as counted over the names), so that it meets only
    names that hold this one, and is then verified. The grams of names reach the shuffle only where a
    fragment has them. Fragments of under GRAM characters are one gram; an empty one is in every name;
    null fragments and names hit nothing. Repeated rows hit each for itself. Columns of both sides stay.
    """
    size = lambda c: F.least(F.length(c), F.lit(GRAM))
    wanted = fragments.select(F.col(fragment).alias("_f")).filter(F.col("_f").isNotNull()).distinct()
    own = stored(wanted.select("_f", size(F.col("_f")).alias("_n"), F.explode(grams(F.col("_f"), size(F.col("_f")))).alias("_g")), "fragment-grams", compression="zstd")
    sizes = [r["_n"] for r in own.select("_n").distinct().collect()]  # four at most
    if not sizes:
        return names.join(fragments, F.lit(False))
    keys = own.select("_g").distinct()
    each = F.concat(*[grams(F.col("_t"), F.lit(n)) for n in sizes])
    held = names.select(F.col(name).alias("_t")).filter(F.col("_t").isNotNull()).groupBy("_t").agg(F.count("*").alias("_c"))
    posted = stored(held.select("_t", "_c", F.explode(each).alias("_g")).join(keys, "_g", "left_semi").select(F.xxhash64("_t").alias("_h"), "_c", "_g"), "name-grams", compression="zstd")
    counts = posted.groupBy("_g").agg(F.sum("_c").alias("_c"))
    rarest = own.join(counts, "_g").groupBy("_f").agg(F.min(F.struct("_c", "_g")).alias("_m")).select("_f", F.col("_m._g").alias("_g"))  # without counts: a gram that no name has
    rarest = stored(rarest, "fragment-keys", compression="zstd")
    # names are met by a hash of 64 bits first, and verified whole
    places = posted.select("_g", "_h").join(rarest, "_g").select("_f", "_h")
    sides = names.withColumn("_h", F.xxhash64(name)).filter(F.col(name).isNotNull()).join(places, "_h").filter(F.contains(F.col(name), F.col("_f")))
    return sides.withColumnRenamed("_f", "_f2").join(fragments, F.col("_f2") == F.col(fragment)).drop("_f2", "_h")


def unique_match(fragments: DataFrame, names: DataFrame, fragment: str, name: str) -> DataFrame:
    """Fragments that exactly one name contains, and that name."""
    return fragment_hits(fragments, names, fragment, name).groupBy(fragment).agg(F.min(name).alias(name), F.count("*").alias("_n")).filter("_n = 1").drop("_n")


def first_match(fragments: DataFrame, names: DataFrame, fragment: str, name: str) -> DataFrame:
    """The first name in order that contains each fragment."""
    return fragment_hits(fragments, names, fragment, name).groupBy(fragment).agg(F.min(name).alias(name))


def match_status(fragments: DataFrame, names: DataFrame, fragment: str, name: str) -> DataFrame:
    """none, one or ambiguous for each fragment, with its number of hits."""
    n = fragment_hits(fragments, names, fragment, name).groupBy(fragment).agg(F.count("*").alias("hits"))
    out = fragments.select(fragment).join(n, fragment, "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    return out.withColumn("status", F.when(F.col("hits") == 0, "none").when(F.col("hits") == 1, "one").otherwise("ambiguous"))


def last_by_stem(df: DataFrame, stem: str, order: str) -> DataFrame:
    """One row for each stem, the last in order."""
    k = F.row_number().over(Window.partitionBy(stem).orderBy(F.desc(order)))
    return df.withColumn("_k", k).filter("_k = 1").drop("_k")
