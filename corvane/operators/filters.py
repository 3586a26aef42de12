"""Eligibility rules and ordered reject accounting."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corvane.functions import text as X

# Fixed values.
LICENSES = ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "mit")
CATEGORIES = ("classification", "closed_qa", "information_extraction", "summarization")
LEAST_CHARS, MOST_CHARS, MOST_CODE_CHARS, LEAST_ALPHA = 100, 2_000_000, 100_000, 0.2


def long_enough(text: Column) -> Column:
    return F.coalesce(F.char_length(text).between(LEAST_CHARS, MOST_CHARS), F.lit(False))


def alphabetic(text: Column) -> Column:
    return F.coalesce((X.n_visible(text) > 0) & (X.n_letters(text) >= LEAST_ALPHA * X.n_visible(text)), F.lit(False))


def eligible(text: Column) -> Column:
    return long_enough(text) & alphabetic(text)


@F.pandas_udf(T.BooleanType())
def parses(code: pd.Series) -> pd.Series:
    """Whether the code is syntactically valid Python 3; it is never executed."""

    def check(source: str | None) -> bool:
        try:
            ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError, TypeError):
            return False
        return True

    return code.map(check)


def code_eligible(df: DataFrame) -> DataFrame:
    """Code documents that pass every rule; the parser sees only what the cheap rules leave."""
    cheap = df.where(
        F.char_length("content").between(LEAST_CHARS, MOST_CODE_CHARS) & (X.collapse(F.col("repo_name")) != "") & F.col("path").endswith(".py")
        & F.col("license").isin(*LICENSES) & F.col("autogenerated").eqNullSafe(False)
    )
    return cheap.where(parses("content"))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first failing rule; null if none fails. Rules are predicates that hold for good rows."""
    out = None
    for name, good in rules:
        failed = ~F.coalesce(good, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def reject_counts(df: DataFrame, reason: Column) -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def instruction_rules(end: str, prompt_tokens: Column, answer_tokens: Column, most_answer: int = 80, most_total: int = 256, categories: tuple[str, ...] = CATEGORIES) -> list[tuple[str, Column]]:
    """Category and blanks, special token, length; in the order in which they are counted."""
    fields = ("instruction", "context", "response")
    filled = F.col("category").isin(*categories) & (X.collapse(F.col("instruction")) != "") & (X.collapse(F.col("response")) != "") & F.col("context").isNotNull()
    clean = ~F.concat_ws(" ", *fields).contains(end)
    short = answer_tokens.between(1, most_answer) & (prompt_tokens + answer_tokens <= most_total)
    return [("category_or_empty", filled), ("special", clean), ("length", short)]


def with_duplicates(df: DataFrame, reason: Column, key: str, order: str) -> DataFrame:
    """``df`` with ``reason``, the first failing rule; a row that passes them all but repeats an earlier such row's key is a ``duplicate``."""
    told = df.withColumn("reason", reason)
    first = told.where("reason is null").groupBy(key).agg(F.min(order).alias("__first"))
    again = F.col("reason").isNull() & (F.col(order) != F.col("__first"))
    return told.join(first, key, "left").withColumn("reason", F.when(again, "duplicate").otherwise(F.col("reason"))).drop("__first")


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't excluded."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")
