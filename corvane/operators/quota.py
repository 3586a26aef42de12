"""Token quotas filled by prefixes, offsets, nested subsets and their checks.

Running sums go through range partitions, so no split of a corpus is summed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.operators.dedup import first_per_key
from corvane.operators.order import running
from corvane.sources.storage import settle


class BudgetError(ValueError):
    """A source or split can't fill its budget."""


def validated(budgets: dict[str, int]) -> dict[str, int]:
    """``budgets``, if there are any and each is a whole number above 0; raises otherwise."""
    wrong = {k: n for k, n in budgets.items() if isinstance(n, bool) or not isinstance(n, int) or n < 1}
    if wrong or not budgets:
        raise BudgetError(f"budgets must be whole numbers above 0: {wrong or 'none given'}")
    return budgets


def quota_of(budgets: dict[str, int], part: str = "split") -> Column:
    out = None
    for name, n in budgets.items():
        out = F.when(F.col(part) == name, n) if out is None else out.when(F.col(part) == name, n)
    return out.cast("long")


def fill(df: DataFrame, budgets: dict[str, int], order: str = "seq", keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Rows that a prefix fill takes, with ``tokens`` (the last one cut), ``original_tokens`` and ``truncated``.

    ``df`` holds ``split``, ``n_tokens`` and the order column; a row is taken while its split's quota isn't full.
    """
    summed = running(df, list(keys), [order], {"before": "n_tokens"}, label="fill")
    quota = quota_of(budgets)
    taken = summed.withColumn("quota", quota).where("before < quota")
    return taken.withColumn("original_tokens", F.col("n_tokens")).withColumn("tokens", F.least(F.col("n_tokens"), F.col("quota") - F.col("before"))).withColumn("truncated", F.col("tokens") < F.col("n_tokens")).drop("before", "quota", "n_tokens")


def require(filled: DataFrame, budgets: dict[str, int], part: str = "split") -> DataFrame:
    """``filled``, if each split has exactly its budget; raises otherwise."""
    have = {r[part]: r.n for r in filled.groupBy(part).agg(F.sum("tokens").alias("n")).collect()}
    short = {k: (have.get(k, 0), n) for k, n in budgets.items() if have.get(k, 0) != n}
    if short:
        raise BudgetError(f"splits without their budget (have, need): {short}")
    return filled


def offsets(filled: DataFrame, order: list[str], part: str = "split") -> DataFrame:
    """``start_token``: the tokens before a row of its split."""
    return running(filled, [part], list(order), {"start_token": "tokens"}, label="offsets")


def fill_sources(df: DataFrame, sources: list[str], budgets: dict[str, int]) -> DataFrame:
    """Quota fill per source, in the order given, with first-wins deduplication over the visited prefixes.

    ``df`` holds ``source, seq, fingerprint, split, n_tokens`` of eligible rows. A source is read until all its
    quotas are full; fingerprints count as seen only up to there. One small action per source finds that place.
    """
    seen: DataFrame | None = None
    parts: list[DataFrame] = []
    for name in sources:
        own = df.where(F.col("source") == name)
        if seen is not None:
            own = own.join(seen, "fingerprint", "left_anti")
        fresh = settle(first_per_key(own, "fingerprint", "seq"), "fresh")
        summed = settle(running(fresh, ["split"], ["seq"], {"before": "n_tokens"}, label="source"), "summed").withColumn("quota", quota_of(budgets))
        ends = {r.split: r.stop for r in summed.where("before + n_tokens >= quota").groupBy("split").agg(F.min("seq").alias("stop")).collect()}
        if set(ends) != set(budgets):
            raise BudgetError(f"source {name} can't fill {sorted(set(budgets) - set(ends))}")
        stop = max(ends.values())
        visited = fresh.where(F.col("seq") <= stop).select("fingerprint")
        seen = visited if seen is None else seen.unionByName(visited)
        parts.append(summed.where("before < quota"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("original_tokens", F.col("n_tokens")).withColumn("tokens", F.least(F.col("n_tokens"), F.col("quota") - F.col("before"))).withColumn("truncated", F.col("tokens") < F.col("original_tokens")).drop("before", "quota", "n_tokens")


def subset(index: DataFrame, budget: int, part: str = "train") -> DataFrame:
    """A smaller prefix of one split, with its parent's offsets and lengths; other splits pass through."""
    own = index.where(F.col("split") == part)
    lineage = own.select("*", F.col("start_token").alias("parent_start_token"), F.col("tokens").alias("parent_tokens"))
    kept = lineage.where(F.col("start_token") < budget)
    cut = F.least(F.col("tokens"), budget - F.col("start_token")).cast("long")
    small = kept.withColumn("tokens", cut).withColumn("truncated", F.col("truncated") | (F.col("tokens") < F.col("parent_tokens")))
    rest = index.where(F.col("split") != part).select("*", F.col("start_token").alias("parent_start_token"), F.col("tokens").alias("parent_tokens"))
    return small.unionByName(rest)


def gaps(index: DataFrame) -> DataFrame:
    """Rows whose ``start_token`` isn't the tokens before them; empty for a sound index."""
    return running(index, ["split"], ["start_token"], {"expected": "tokens"}, label="gaps").where("start_token <> expected").select("split", "start_token", "expected")


def legacy_fill(df: DataFrame, train: int, val: int, order: str = "seq") -> DataFrame:
    """Train first, then later rows for val; the border row's tail is dropped, cut rows get no end token."""
    summed = settle(running(df, [], [order], {"before": "n_tokens"}, label="legacy"), "legacy")
    first = summed.where(F.col("before") < train).withColumn("split", F.lit("train")).withColumn("tokens", F.least("n_tokens", train - F.col("before")))
    edge = summed.where(F.col("before") < train).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("used")).first().used
    rest = summed.where(F.col("before") >= train).withColumn("at", F.col("before") - edge).where(F.col("at") < val)
    second = rest.withColumn("split", F.lit("val")).withColumn("tokens", F.least("n_tokens", val - F.col("at"))).drop("at")
    return first.unionByName(second).drop("before")
