"""Exact duplicates, near-duplicate pairs and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions import text as X
from corvane.operators.components import components
from corvane.operators.skew import spread_join
from corvane.sources.storage import settle


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; sums before the shuffle, so a frequent key costs no more than a rare one."""
    low = df.groupBy(key).agg(F.min(order).alias(order))
    return df.join(low, [key, order], "left_semi")


def canonical_key(*fields) -> F.Column:
    """A digest of several fields that no choice of contents can confuse."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(f, F.lit("")) for f in fields))), 256)


def similar_pairs(df: DataFrame, key: str, tokens: F.Column, n: int = 3, percent: int = 80) -> DataFrame:
    """``a, b, shared, size_a, size_b``: links between n-gram sets with Jaccard similarity of ``percent`` or more, exact.

    Equal sets form a class, named by its smallest key, which is linked with each other member; links between different
    sets join the classes' names. So a group of m copies costs m rows, and no link between different sets is lost.
    Different sets are joined on a prefix of their rarest grams only: two sets at similarity s share a gram among the
    first ``size - ceil(s * size) + 1`` in any common order. The intersection is then counted on whole sets.
    """
    star, first = _classes(df, key, tokens, n)
    return star.unionByName(_set_pairs(first, percent))


def similar_links(df: DataFrame, key: str, tokens: F.Column, n: int = 3, percent: int = 80) -> DataFrame:
    """``a, b``: the links of ``similar_pairs``."""
    return similar_pairs(df, key, tokens, n, percent).select("a", "b")


def _classes(df: DataFrame, key: str, tokens: F.Column, n: int) -> tuple[DataFrame, DataFrame]:
    """Links within classes of equal sets, and ``id, grams, size`` of each class's smallest key."""
    grams = df.select(F.col(key).alias("id"), X.shingles(tokens, n).alias("grams")).where(F.size("grams") > 0)
    hashed = grams.select("id", F.array_sort(F.transform("grams", lambda g: F.xxhash64(g))).alias("grams"))
    sets = settle(hashed.select("id", "grams", F.size("grams").cast("long").alias("size"), *(F.xxhash64(F.lit(k), "grams").alias(f"s{k}") for k in (1, 2))), "gram-sets")
    sig = ["s1", "s2"]
    low = settle(sets.groupBy(*sig).agg(F.min("id").alias("a"), F.count("*").alias("n")), "classes")
    met = spread_join(sets.select("id", "size", *sig), low.select(*sig, "a"), sig, low, F.col("id"))
    star = met.where("a <> id").select("a", F.col("id").alias("b"), F.col("size").alias("shared"), F.col("size").alias("size_a"), F.col("size").alias("size_b"))
    return star, sets.join(low.select(F.col("a").alias("id")), "id", "left_semi").select("id", "grams", "size")


def _set_pairs(sets: DataFrame, percent: int) -> DataFrame:
    grams = settle(sets.select("id", "size", F.explode("grams").alias("g")), "grams")
    often = settle(grams.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "often")
    ordered = spread_join(grams, often.select("g", F.col("n").alias("f")), ["g"], often, F.col("id")).groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("o"))
    # grams of one set alone come first and meet nothing: they only shorten the rest of the prefix
    keep = F.col("size") - F.ceil(F.col("size") * percent / 100.0) + 1 - (F.col("size") - F.size("o"))
    prefix = settle(ordered.where(keep > 0).select("id", "size", F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("x")).select("id", "size", F.col("x.g").alias("g")), "prefixes")
    a, b = (prefix.select(F.col("id").alias(s), F.col("size").alias(f"size_{s}"), "g") for s in "ab")
    close = (F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent) & (F.col("a") < F.col("b"))
    pairs = a.join(b, "g").where(close).select("a", "b", "size_a", "size_b").distinct()
    whole = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    counted = whole.withColumn("shared", F.size(F.array_intersect("ga", "gb")).cast("long"))
    return counted.where(F.col("shared") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("shared")) * percent).select("a", "b", "shared", "size_a", "size_b")


def equal_value_links(df: DataFrame, key: str, value: F.Column) -> DataFrame:
    """``a, b``: each row and the smallest key with the same value; rows without a value link with nothing."""
    rows = df.select(F.col(key).alias("b"), value.alias("v")).where("v is not null and v <> ''")
    return rows.join(rows.groupBy("v").agg(F.min("b").alias("a")), "v").where("a <> b").select("a", "b")


def groups(df: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """``id, root`` for every row: the smallest key it is connected with, itself included."""
    found = components(links.select("a", "b"))
    return df.select(F.col(key).alias("id")).join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def group_keys(members: DataFrame, root: str, fingerprint: str) -> DataFrame:
    """``root, group_key``: the digest of a group's sorted fingerprints."""
    return members.groupBy(root).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(fingerprint)), "\n"), 256).alias("group_key"))
