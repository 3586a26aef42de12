"""Order-dependent sums without a one-task window: range partitions, their totals, and the offsets between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.sources.storage import settle


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str], slices: int | None = None, label: str = "ordered") -> DataFrame:
    """``df`` with one column per entry of ``sums``: the sum of ``source column`` over the rows before it.

    Rows are ordered by ``order`` within each group of ``keys``. A range shuffle over keys and order cuts hot groups
    into many partitions; the partitioned rows are written out with their partition's number, so that each row's
    place is fixed, and a table of one row per (partition, group) carries the offsets. ``order`` must tell rows
    apart, or rows that it doesn't tell apart must be equal.
    """
    names = list(sums)
    ordered = [F.col(k).asc_nulls_last() for k in keys] + [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
    parts = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settle(df.repartitionByRange(parts, *ordered).withColumn("__part", F.spark_partition_id()), label)
    totals = cut.groupBy(*keys, "__part").agg(*(F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())))
    ahead = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"__t{i}").over(ahead), F.lit(0)).alias(f"__o{i}") for i in range(len(names))))
    match = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy("__part", *keys).orderBy(*ordered[len(keys) :]).rowsBetween(Window.unboundedPreceding, -1)
    for i, (name, c) in enumerate(sums.items()):
        cut = cut.withColumn(f"__i{i}", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    out = cut.join(offsets, match, "left")
    for i, name in enumerate(names):
        out = out.withColumn(name, (F.col(f"__i{i}") + F.col(f"__o{i}")).cast("long"))
    return out.drop("__part", "__p", *(f"__k{i}" for i in range(len(keys))), *(f"__{x}{i}" for x in "io" for i in range(len(names))))
