"""Prompts, token arrays, label masks, windows and schedules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corvane.functions import text as X

IGNORE = -100
# The section titles of a prompt.
INSTRUCTION, CONTEXT, RESPONSE = "### Instruction:\n", "### Context:\n", "### Response:\n"


def prompt(instruction: Column, context: Column) -> Column:
    """The prompt of an instruction; the context section only where there is one."""
    gap = F.lit("\n\n")
    body = X.strip(F.coalesce(context, F.lit("")))
    middle = F.when(body != "", F.concat(F.lit(CONTEXT), body, gap)).otherwise("")
    return F.concat(F.lit(INSTRUCTION), X.strip(instruction), gap, middle, F.lit(RESPONSE))


def with_end(ids: Column, end: int, limit: Column | None = None) -> Column:
    """``ids`` and the end token; cut to ``limit`` tokens, the last of them the end token."""
    whole = F.concat(ids, F.array(F.lit(end)))
    return whole if limit is None else F.when(F.size(whole) <= limit, whole).otherwise(F.concat(F.slice(ids, 1, limit - 1), F.array(F.lit(end))))


def in_vocabulary(ids: Column, size: int) -> Column:
    """``ids``, or an error if one is outside the vocabulary."""
    bad = (F.array_min(ids) < 0) | (F.array_max(ids) >= size)
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("token id outside the vocabulary")).cast("array<int>")).otherwise(ids)


def inputs(ids: Column) -> Column:
    return F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))


def targets(ids: Column) -> Column:
    return F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))


def padded_inputs(ids: Column, width: Column, pad: int) -> Column:
    return F.concat(inputs(ids), F.array_repeat(F.lit(pad), (width - F.size(ids) + 1).cast("int")))


def masked_labels(ids: Column, boundary: Column, width: Column) -> Column:
    """Targets from the response on; everything before it and the padding is ignored."""
    head = F.array_repeat(F.lit(IGNORE), (boundary - 1).cast("int"))
    tail = F.slice(ids, boundary.cast("int") + 1, F.size(ids))
    return F.concat(head, tail, F.array_repeat(F.lit(IGNORE), (width - F.size(ids) + 1).cast("int")))


def windows(ids: Column, length: int) -> Column:
    """Windows of ``length + 1`` tokens, ``length`` apart: each token but the first is a target once."""

    def cut(xs):
        n = F.size(xs)
        last = F.floor((n - 2) / length).cast("int")
        found = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.cast("long").alias("window_id"), (k * length).cast("long").alias("start"), F.slice(xs, k * length + 1, length + 1).alias("tokens")))
        return F.when(n >= 2, found)

    return F.get(F.transform(F.array(ids), cut), F.lit(0))


def padded_windows(ids: Column, length: int, pad: int) -> Column:
    """A document's tokens in pieces of exactly ``length``, the last one filled up with ``pad``; no token is in two."""
    count = F.ceil(F.size(ids) / length).cast("int")
    own = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(ids, k * length + 1, length))
    filled = F.transform(own, lambda w: F.concat(w, F.array_repeat(F.lit(pad), length - F.size(w))))
    return F.when(F.size(ids) > 0, filled).otherwise(F.array().cast("array<array<int>>"))


def n_batches(tokens: Column, length: int, batch: int) -> Column:
    """Batches per epoch: full windows by ``batch``, and one for a short tail."""
    full = F.floor((tokens - 1) / length)
    return (F.ceil(full / batch) + F.when((tokens - 1) % length > 0, 1).otherwise(0)).cast("long")


def evaluation_offset(i: Column, n: Column, k: Column) -> Column:
    """The i-th of k evenly spaced window numbers in [0, n - 1]."""
    return F.when(k <= 1, F.lit(0)).otherwise(F.floor(i * (n - 1) / (k - 1))).cast("long")


def learning_rate(step: Column, peak: float, floor: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then cosine decay to ``floor`` times the peak; steps start at 1."""
    low = peak * floor
    done = (step - warmup) / float(max(1, total - warmup))
    return F.when(step <= warmup, peak * step / float(max(1, warmup))).otherwise(low + 0.5 * (peak - low) * (1 + F.cos(F.lit(3.141592653589793) * done)))


def tokens_seen(step: Column, total: int, length: int, batch: int) -> Column:
    """Targets scored after ``step`` updates over epochs of ``total`` tokens; an epoch's short tail is its last batch."""
    full = (total - 1) // length
    per_epoch = -(-full // batch) + ((total - 1) % length > 0)
    return (F.floor(step / per_epoch) * (total - 1) + F.least(step % per_epoch * batch, F.lit(full)) * length).cast("long")
