"""The instruction set end to end: turns to rows, ordered filters, groups, split, selection."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import text as X, tokens as K
from corvane.operators import checks, dedup, filters, sampling, splits
from corvane.sources.sinks import instruction_rows, write_text
from corvane.sources.storage import settle


def rows(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it; the conversation's first system turn is its context."""
    user = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    answer = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    system = conversations.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("context"))
    out = user.join(answer, ["conv_id", "turn"]).join(system, "conv_id", "left")
    return out.select((F.col("conv_id") * 1000 + F.col("turn")).alias("source_id"), "instruction", F.coalesce("context", F.lit("")).alias("context"), "response")


def keyed(df: DataFrame) -> DataFrame:
    """With the fingerprint of all three fields, and with token counts where they aren't known."""
    key = dedup.canonical_key(*(X.prompt_normal(F.col(c)) for c in ("instruction", "context", "response")))
    prompt = K.prompt(F.col("instruction"), F.col("context"))
    counts = {"prompt_tokens": X.n_pieces(prompt), "answer_tokens": X.n_pieces(F.col("response")) + 1}
    return df.withColumns({"fingerprint": key} | {c: v for c, v in counts.items() if c not in df.columns})


def grouped(df: DataFrame) -> DataFrame:
    """``source_id, root, group_key, split``: rows linked by instruction, by context, or by similar instructions."""
    text = X.prompt_normal(F.col("instruction"))
    links = dedup.equal_value_links(df, "source_id", text).unionByName(dedup.equal_value_links(df, "source_id", X.prompt_normal(F.col("context"))))
    links = links.unionByName(dedup.similar_links(df, "source_id", X.words(text)))
    members = df.join(dedup.groups(df, "source_id", links).withColumnRenamed("id", "source_id"), "source_id")
    keys = dedup.group_keys(members, "root", "fingerprint")
    return members.join(keys, "root").select("source_id", "root", "group_key", splits.group_split(F.col("group_key")).alias("split"))


def piece_lengths(text: Column) -> Column:
    """Stand-in ids: the length of each blank-separated piece."""
    return F.transform(X.pieces(text), lambda w: F.char_length(w))


def encoded(df: DataFrame, encode=piece_lengths, end: int = 0) -> DataFrame:
    """``ids, prompt_tokens``: the prompt and the answer encoded one by one, the end token behind them; the boundary
    is the prompt's length, whatever tokens would join over it."""
    prompt, answer = encode(K.prompt(F.col("instruction"), F.col("context"))), encode(F.col("response"))
    parts = df.withColumns({"__p": prompt, "__a": answer})
    return parts.withColumns({"ids": K.with_end(F.concat("__p", "__a"), end), "prompt_tokens": F.size("__p"), "answer_tokens": F.size("__a") + 1}).drop("__p", "__a")


def accounted(df: DataFrame, excluded: DataFrame, end_text: str, categories: tuple[str, ...] = filters.CATEGORIES, most_answer: int = 80, most_total: int = 256) -> DataFrame:
    """``df`` (``keyed`` and with ``category``) with ``reason``: the first rule that a row fails, in their order: review,
    category or blanks, special token, length, duplicate; null for rows that stay."""
    review = [("quality", F.col("__bad").isNull())]
    rules = review + filters.instruction_rules(end_text, F.col("prompt_tokens"), F.col("answer_tokens"), most_answer, most_total, categories)
    told = df.join(excluded.select("source_id", F.lit(True).alias("__bad")).distinct(), "source_id", "left")
    return filters.with_duplicates(told, filters.first_reason(rules), "fingerprint", "source_id").drop("__bad")


def prepare(df: DataFrame, excluded: DataFrame, folder: str, counts: dict[str, int], end_text: str, encode=piece_lengths, end: int = 0, vocabulary: int = 1 << 20, seed: str = "0", **limits) -> DataFrame:
    """Write an instruction set: ordered rejects, groups, splits, round-robin choice, encoded rows, and a manifest.

    ``df`` holds ``source_id, instruction, context, response, category``; ``counts`` says how many rows each split gets.
    """
    spark = df.sparkSession
    told = settle(accounted(keyed(encoded(df, encode, end)), excluded, end_text, **limits), "told")
    rejects = {r.reason: r.n for r in filters.reject_counts(told, F.col("reason")).collect()}
    good = settle(told.where("reason is null").drop("reason"), "good")
    rows = settle(good.join(grouped(good), "source_id"), "grouped")
    chosen: DataFrame | None = None
    for split, count in counts.items():
        part = sampling.round_robin(rows.where(F.col("split") == split), "category", "fingerprint", count, seed)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = settle(chosen, "chosen")
    faults = checks.instruction_faults(chosen, end, vocabulary, limits.get("most_total", 256)).take(1)
    if faults:
        raise ValueError(f"instruction set: {faults[0].asDict()}")
    instruction_rows(chosen).write.mode("errorifexists").partitionBy("split").parquet(f"{folder}/rows")
    stats = chosen.groupBy("split").agg(F.count("*").alias("rows"), F.sum(F.size("ids")).alias("tokens"), F.sum(F.size("ids") - F.col("prompt_tokens")).alias("answer_tokens"), F.max(F.size("ids")).alias("longest"), F.count_distinct("group_key").alias("groups"))
    write_text(spark, f"{folder}/manifest.json", json.dumps({"version": 1, "status": "complete", "rejects": rejects, "splits": {r.split: r.asDict() for r in stats.collect()}}, sort_keys=True), overwrite=False)
    return spark.read.parquet(f"{folder}/rows")
