"""Scores over (document, position, target, nll) relations and over answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import text as X


def weighted_loss(df: DataFrame, *keys: str) -> DataFrame:
    """``loss, perplexity, scored_tokens`` weighted by tokens; raises on losses that aren't finite."""
    bad = F.col("nll").isNull() | F.isnan("nll") | (F.abs("nll") == float("inf"))
    nll = F.when(bad, F.raise_error(F.lit("a loss isn't finite")).cast("double")).otherwise(F.col("nll"))
    out = df.groupBy(*keys).agg(F.sum(nll).alias("total"), F.count("*").alias("scored_tokens"))
    return out.select(*keys, (F.col("total") / F.col("scored_tokens")).alias("loss"), F.exp(F.col("total") / F.col("scored_tokens")).alias("perplexity"), "scored_tokens")


def masked_accuracy(df: DataFrame, *keys: str, ignore: int = -100) -> DataFrame:
    """Loss and accuracy over positions whose label counts."""
    return df.where(F.col("label") != ignore).groupBy(*keys).agg(F.avg("nll").alias("loss"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("scored_tokens"))


def bigram_losses(tokens: DataFrame, k: float = 1.0) -> DataFrame:
    """An add-k bigram model scored on its own corpus, as a stand-in for a network: ``doc_id, pos, nll``.

    ``tokens`` holds ``doc_id, pos, prev, token``.
    """
    pairs = tokens.groupBy("prev", "token").agg(F.count("*").alias("pair_n"))
    prev = tokens.groupBy("prev").agg(F.count("*").alias("prev_n"))
    size = tokens.agg(F.count_distinct("token").alias("vocabulary"))  # one row
    nll = -F.log((F.col("pair_n") + k) / (F.col("prev_n") + k * F.col("vocabulary")))
    return tokens.join(pairs, ["prev", "token"]).join(prev, "prev").crossJoin(F.broadcast(size)).select("doc_id", "pos", "token", nll.alias("nll"))


def answer_scores(df: DataFrame, predicted: Column, reference: Column) -> DataFrame:
    return df.withColumns({"exact_match": X.answer_normal(predicted) == X.answer_normal(reference), "token_f1": X.token_f1(X.prompt_normal(predicted), X.prompt_normal(reference)), "repeated": X.repeated_fraction(X.words(predicted))})


def summary(df: DataFrame, *keys: str) -> DataFrame:
    """Counts and means of scored answers."""
    aggs = (F.count("*").alias("examples"), F.sum(F.col("exact_match").cast("long")).alias("exact"), F.avg(F.col("exact_match").cast("double")).alias("exact_rate"), F.avg("token_f1").alias("mean_f1"), F.avg(F.col("stopped").cast("double")).alias("stop_rate"), F.avg("repeated").alias("mean_repeated"))
    return df.groupBy(*keys).agg(*aggs)


def with_total(df: DataFrame, category: str) -> DataFrame:
    """Examples and exact answers by category, and in total."""
    out = df.rollup(category).agg(F.count("*").alias("examples"), F.sum(F.col("exact_match").cast("long")).alias("exact"), F.grouping(category).alias("g"))
    return out.select(F.when(F.col("g") == 1, "total").otherwise(F.col(category)).alias(category), "examples", "exact")


def cube(df: DataFrame, *dimensions: str) -> DataFrame:
    """Examples and exact answers by every subset of the dimensions; ``all`` only where a dimension is summed over, null stays null."""
    out = df.cube(*dimensions).agg(F.count("*").alias("examples"), F.sum(F.col("exact_match").cast("long")).alias("exact"), *(F.grouping(c).alias(f"__{c}") for c in dimensions))
    return out.select(*(F.when(F.col(f"__{c}") == 1, "all").otherwise(F.col(c)).alias(c) for c in dimensions), "examples", "exact")


def zipped(details: DataFrame, raw: DataFrame, ordinal: str, key: str) -> DataFrame:
    """Both tables side by side by ``ordinal``; raises where one has no partner or their ``key`` differs."""
    both = details.join(raw.withColumnRenamed(key, "__key"), ordinal, "full_outer")
    bad = F.when(~F.col(key).eqNullSafe(F.col("__key")), F.raise_error(F.concat(F.lit("different rows at "), F.col(ordinal).cast("string"))).cast("boolean"))
    return both.withColumn("__key", F.coalesce(bad, F.lit(True))).where("__key").drop("__key")


def paired(control: DataFrame, treated: DataFrame, key: str) -> DataFrame:
    """Both results of each key; a key that one side lacks is an error."""
    both = control.select(F.col(key), F.col("exact_match").alias("before")).join(treated.select(F.col(key), F.col("exact_match").alias("after")), key, "full_outer")
    missing = F.col("before").isNull() | F.col("after").isNull()
    check = F.when(missing, F.raise_error(F.lit("the key sets differ")).cast("boolean"))
    return both.select(key, F.coalesce(check, F.col("before")).alias("before"), "after")


def gains(pairs: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has right."""
    return pairs.where("before <> after").select(key, F.when(F.col("after"), "gained").otherwise("lost").alias("change"))


def joint(df: DataFrame, context: str, size: int = 2) -> DataFrame:
    """Contexts all of whose queries are right; a context must have ``size`` of them."""
    out = df.groupBy(context).agg(F.count("*").alias("queries"), F.bool_and("exact_match").alias("all_right"))
    return out.withColumn("sound", F.col("queries") == size)


def constant_answer(train: DataFrame, dev: DataFrame, task: str, answer: str) -> DataFrame:
    """How often the most frequent training answer of a task is right on dev."""
    counts = train.groupBy(task, answer).agg(F.count("*").alias("n"))
    top = counts.groupBy(task).agg(F.max(F.struct("n", answer)).alias("t")).select(task, F.col(f"t.{answer}").alias("constant"))
    return dev.join(top, task).groupBy(task).agg(F.count("*").alias("examples"), F.sum((F.col(answer) == F.col("constant")).cast("long")).alias("right"))


def partner_errors(outputs: DataFrame, train: DataFrame, context: str, *keys: str) -> DataFrame:
    """``examples, wrong, partner`` by ``keys``: how many wrong outputs equal a training answer of their context.

    ``outputs`` holds the context key, ``predicted`` and ``reference``; ``train`` holds the context key and ``answer``.
    A null output is wrong and equals nothing; a context may have several training answers.
    """
    said = X.answer_normal(F.col("predicted"))
    right = F.coalesce(said == X.answer_normal(F.col("reference")), F.lit(False))
    rows = outputs.select(*keys, F.col(context).alias("__context"), said.alias("__answer"), right.alias("__right"))
    known = train.select(F.col(context).alias("__context"), X.answer_normal(F.col("answer")).alias("__answer")).distinct().withColumn("__known", F.lit(True))
    met = rows.join(known, ["__context", "__answer"], "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return met.groupBy(*keys).agg(F.count("*").alias("examples"), count(~F.col("__right")).alias("wrong"), count(~F.col("__right") & F.col("__known")).alias("partner"))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often; empty if both hold the same rows equally often."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
