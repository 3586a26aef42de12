"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key is hot if it has more rows than this, and more than one in ``SHARE``; so there are ``SHARE`` hot keys at most.
FEW, SHARE = 256, 400
#: Tasks over which a hot key is dealt at most.
WAYS = 64


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], sizes: DataFrame, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` on ``keys``, hot keys spread over many tasks.

    ``sizes`` has one row per key with ``n``, how many of ``rows`` have it; it is settled, as it is read twice. The
    hashes of the hot keys, ``SHARE`` numbers at most, become part of the plan; ``salt``, a number that differs between
    the rows of a key, deals their rows, and the rows of ``groups`` are repeated for each way. Keys compare as in ``=``.
    """
    code = F.xxhash64(*keys)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    most = max(FEW, -(-total // SHARE))
    hot = sizes.where(F.col("n") > most).select(code.alias("code"), "n").collect()
    if not hot:
        return rows.join(groups, keys, how)
    ways = min(WAYS, -(-max(r.n for r in hot) // most) * 2)
    is_hot = F.coalesce(code.isin([r.code for r in hot]), F.lit(False))
    dealt = rows.withColumn("__way", F.when(is_hot, F.pmod(salt, F.lit(ways))).otherwise(0).cast("int"))
    every = F.array(*(F.lit(w) for w in range(ways)))
    repeated = groups.withColumn("__way", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated, [*keys, "__way"], how).drop("__way")
