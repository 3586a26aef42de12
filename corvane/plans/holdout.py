"""The final holdout: one plan that loads, verifies, scores and compares, before any number is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators import checks, scoring
from corvane.sources.readers import finished


def corpus_holdout(spark: SparkSession, folder: str, tokenizer: str, part: str = "holdout") -> DataFrame:
    """``fault, item`` of a finished corpus's holdout: index faults, documents or sources it shares with the other
    splits, a file of another split under its name, and counts that the manifest doesn't have."""
    facts = finished(spark, folder, tokenizer)
    index = spark.read.parquet(f"{folder}/documents")
    totals = spark.createDataFrame([(s, t["tokens"]) for s, t in facts["totals"].items()], "split string, tokens long")
    own, rest = index.where(F.col("split") == part), index.where(F.col("split") != part)
    shared = checks.holdout_faults(own, rest, ("fingerprint", "locator")).select(F.col("key").alias("fault"), "item")
    counts = spark.createDataFrame([(s, t["documents"]) for s, t in facts["totals"].items()], "split string, n long")
    have = index.groupBy("split").agg(F.count("*").alias("have"))
    wrong = counts.join(have, "split", "full_outer").where(~F.col("n").eqNullSafe(F.col("have"))).select(F.lit("count").alias("fault"), F.col("split").alias("item"))
    return checks.index_faults(index, totals).unionByName(shared).unionByName(wrong).unionByName(checks.alias_faults(spark, facts["totals"]))


def audit(rows: DataFrame, losses: DataFrame, control: DataFrame, expected: DataFrame, part: str = "holdout", tolerance: float = 1e-6) -> DataFrame:
    """``split, loss, perplexity, scored_tokens`` of ``losses`` (``split, doc_id, nll``), if the control's figures are the
    expected ones and every target but the first of each split was scored; raises otherwise."""
    scored = scoring.weighted_loss(losses, "split")
    for faults, what in ((checks.control_faults(control, expected, "split", tolerance), "control"), (checks.coverage_faults(scored, rows), "coverage")):
        found = faults.take(1)
        if found:
            raise ValueError(f"{what}: {found[0].asDict()}")
    return scored.where(F.col("split") == part)
