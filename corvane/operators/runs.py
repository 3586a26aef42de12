"""Run logs: training means, comparisons, trial medians, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def training_means(log: DataFrame, every: int, step: str = "step") -> DataFrame:
    """Losses weighted by tokens over blocks of ``every`` updates."""
    block = F.ceil(F.col(step) / every).cast("long")
    return log.groupBy(block.alias("block")).agg((F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("mean_loss"), F.sum("tokens").alias("tokens"), F.max(step).alias("last_step"))


def until(log: DataFrame, event: str, step: int) -> DataFrame:
    return log.where((F.col("event") == event) & (F.col("step") <= step))


def last_state(log: DataFrame, expected: int) -> DataFrame:
    """The last step's loss; ``sound`` says whether that step is the expected one."""
    return log.agg(F.max("step").alias("step"), F.max_by("loss", "step").alias("loss")).withColumn("sound", F.col("step") == expected)


def trial_medians(df: DataFrame, key: str, value: str, peak: str) -> DataFrame:
    return df.groupBy(key).agg(F.median(value).alias("median_value"), F.max(peak).alias("peak"), F.count("*").alias("trials"))


def compare(a: DataFrame, b: DataFrame, key: str, value: str, same: list[str]) -> DataFrame:
    """Two runs side by side by key; ``comparable`` says whether their settings agree."""
    left = a.select(key, F.col(value).alias("before"), *(F.col(c).alias(f"{c}_a") for c in same))
    right = b.select(key, F.col(value).alias("after"), *(F.col(c).alias(f"{c}_b") for c in same))
    agree = F.lit(True)
    for c in same:
        agree &= F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    return left.join(right, key).select(key, "before", "after", (F.col("after") / F.col("before")).alias("ratio"), percent_change(F.col("before"), F.col("after")).alias("percent_change"), agree.alias("comparable"))


def percent_change(before: Column, after: Column) -> Column:
    return (after - before) / before * 100


def same_size(df: DataFrame, size: str) -> DataFrame:
    return df.agg(F.count_distinct(size).alias("sizes")).withColumn("sound", F.col("sizes") == 1)
