"""Forward tensor math over array columns: normalisation, rotation, gates, losses, attention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def rms_norm(x: Column, eps: float = 1e-6, weight: float = 1.0) -> Column:
    """x / sqrt(mean(x^2) + eps) * weight."""
    scale = F.sqrt(total(F.transform(doubles(x), lambda v: v * v)) / F.size(x) + eps)
    return F.get(F.transform(F.array(F.struct(doubles(x).alias("x"), scale.alias("s"))), lambda r: F.transform(r["x"], lambda v: v / r["s"] * weight)), F.lit(0))


def rotate(x: Column, position: Column, theta: float = 10_000.0) -> Column:
    """Rotary embedding: the pair (2i, 2i + 1) turns by position * theta^(-2i / d)."""

    def one(v, i):
        half = F.floor(i / 2)
        angle = position * F.pow(F.lit(theta), -2.0 * half / F.size(x))
        other = F.get(x, F.when(i % 2 == 0, i + 1).otherwise(i - 1)).cast("double")
        return F.when(i % 2 == 0, v * F.cos(angle) - other * F.sin(angle)).otherwise(other * F.sin(angle) + v * F.cos(angle))

    return F.transform(doubles(x), one)


def silu(v: Column) -> Column:
    return v / (1 + F.exp(-v))


def swiglu(gate: Column, up: Column) -> Column:
    return F.zip_with(doubles(gate), doubles(up), lambda g, u: silu(g) * u)


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax(logits)[target], with the maximum taken out first; target counts from 0."""
    top = F.array_max(doubles(logits))
    return F.log(total(F.transform(doubles(logits), lambda v: F.exp(v - top)))) + top - F.get(doubles(logits), target)


def argmax(x: Column) -> Column:
    return (F.array_position(x, F.array_max(x)) - 1).cast("long")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def embedding_lookup(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """``tokens(sequence, pos, token)`` joined to ``table(token, vector)``."""
    return tokens.join(table, "token")


def token_vectors(texts: DataFrame, sequence: str, pieces: Column, table: DataFrame, rows: int) -> DataFrame:
    """``sequence, pos, token, vector`` of every piece of every text; a piece's token is its hash among ``rows`` ids."""
    each = texts.select(F.col(sequence), F.posexplode(pieces).alias("pos", "piece"))
    return embedding_lookup(each.select(sequence, "pos", F.pmod(F.xxhash64("piece"), F.lit(rows)).alias("token")), table).select(sequence, "pos", "token", "vector")


def causal_attention(df: DataFrame, sequence: str, pos: str, x: str, value: str) -> DataFrame:
    """One head with x as query and key: softmax over earlier positions of the sequence, weighted scalar value.

    The join is on the sequence, whose length bounds the pairs, as in any attention.
    """
    q = df.select(F.col(sequence).alias("s"), F.col(pos).alias("q"), F.col(x).alias("xq"))
    k = df.select(F.col(sequence).alias("s"), F.col(pos).alias("k"), F.col(x).alias("xk"), F.col(value).cast("double").alias("v"))
    scores = q.join(k, "s").where("k <= q").withColumn("z", dot(F.col("xq"), F.col("xk")) / F.sqrt(F.size("xq").cast("double")))
    row = Window.partitionBy("s", "q")
    shifted = scores.withColumn("e", F.exp(F.col("z") - F.max("z").over(row)))
    return shifted.groupBy("s", "q").agg((F.sum(F.col("e") * F.col("v")) / F.sum("e")).alias("attended"), F.count("*").alias("n_keys"))


def grouped_attention(heads: int, groups: int):
    """A pandas-batch function for ``sequence, xs``: causal attention of ``heads`` query heads over ``groups`` shared
    key and value heads (``groups == heads`` is plain multi-head attention); heads are concatenated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"sequence": batch["sequence"], "out": [attend(np.stack(xs).astype(float), heads, groups).tolist() for xs in batch["xs"]]})

    return run


def attend(x: np.ndarray, heads: int, groups: int) -> np.ndarray:
    n, width = x.shape
    d = width // heads
    q = x.reshape(n, heads, d)
    kv = q[:, :: heads // groups][:, np.repeat(np.arange(groups), heads // groups)]
    z = np.einsum("ihd,jhd->hij", q, kv) / np.sqrt(d)
    z[:, np.triu(np.ones((n, n), bool), 1)] = -np.inf
    p = np.exp(z - z.max(-1, keepdims=True))
    return np.einsum("hij,jhd->ihd", p / p.sum(-1, keepdims=True), kv).reshape(n, width)


def greedy(step, ids: list[int], context: int, end: int, limit: int) -> list[int]:
    """Greedy generation: ``step(ids)`` gives logits for the last ``context`` ids; stops after ``end``."""
    out = list(ids)
    for _ in range(limit):
        out.append(int(np.argmax(step(out[-context:]))))
        if out[-1] == end:
            break
    return out
