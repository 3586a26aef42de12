"""Deterministic shuffles, stratified choice and window samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shuffle_key(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def round_robin(df: DataFrame, category: str, key: str, count: int, seed: str = "0") -> DataFrame:
    """``count`` rows, one of each category in turn, in hash order inside a category; raises if there are too few.

    A category gives ``count`` rows at most, so ranks beyond that are cut before the shuffle.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(shuffle_key(seed, F.col(key)), key))).where(F.col("rank") <= count)
    out = ranked.orderBy("rank", category).limit(count)
    have = out.count()
    if have < count:
        raise ValueError(f"{have} rows for {count}")
    return out


def all_or_stratified(df: DataFrame, category: str, key: str, count: int, seed: str = "0") -> DataFrame:
    return df if df.count() == count else round_robin(df, category, key, count, seed)


def window_sample(spark: SparkSession, n_windows: int, count: int, seed: int) -> DataFrame:
    """``i, window_id``: windows drawn with replacement, each draw a hash of the seed and its number."""
    return spark.range(count).select(F.col("id").alias("i"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_windows)).alias("window_id"))


def epoch_order(spark: SparkSession, n_windows: int, seed: int) -> DataFrame:
    """``window_id`` of all windows in the order of an epoch, a permutation by the hash of seed and number."""
    return spark.range(n_windows).select(F.col("id").alias("window_id")).orderBy(F.xxhash64(F.lit(seed), "window_id"), "window_id")
