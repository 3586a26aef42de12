"""Shards along a Hilbert curve over metadata, in DataFrame operations only.

Size (on a log scale), language and source are quantised to ``LEVELS`` bits each; the Hilbert index of that cell
orders the documents, and runs of equal length are cut from the order, so that a shard covers a compact box of all
three dimensions and file statistics prune on each. Law ``rows``: shard sizes differ by one row at most.

Equal texts share one cell (the smallest language and source of the group) and follow each other in the order, so a
group is only split where a cut falls into it or where it is larger than a shard.

Edge cases: a null text has no bytes; null languages and sources are cells of their own; repeated rows take slots
of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm import common as C
from corvane.operators.order import running
from corvane.operators.skew import spread_join

SHARDS, OVERHEAD, LEVELS = 40, 16, 8


def hilbert(axes: list[Column], bits: int = LEVELS) -> Column:
    """The Hilbert index of a cell: inverse undo, Gray code and bit interleaving over an array of coordinates."""
    n = len(axes)
    x = F.array(*(a.cast("long") for a in axes))
    put = lambda a, i, v: F.transform(a, lambda e, k: F.when(k == i, v).otherwise(e))
    steps = F.array(*(F.struct(F.lit(1 << q).cast("long").alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)))

    def undo(a: Column, s: Column) -> Column:
        low = s["q"] - 1
        first, own = F.get(a, F.lit(0)), F.get(a, s["i"])
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        flipped = put(a, 0, first.bitwiseXOR(low))
        swapped = F.transform(a, lambda e, k: F.when((k == 0) & (s["i"] != 0), e.bitwiseXOR(swap)).when((k == s["i"]) & (k != 0), e.bitwiseXOR(swap)).otherwise(e))
        return F.when(own.bitwiseAND(s["q"]) != 0, flipped).otherwise(swapped)

    x = F.aggregate(steps, x, undo)
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), x, lambda a, i: F.transform(a, lambda e, k: F.when(k == i, e.bitwiseXOR(F.get(a, i - 1))).otherwise(e)))
    masks = F.array(*(F.lit(1 << q).cast("long") for q in range(bits - 1, 0, -1)))
    turned = lambda g: F.aggregate(masks, F.lit(0).cast("long"), lambda t, q: F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    # one-element arrays keep each stage evaluated once
    done = F.transform(F.array(gray), lambda g: F.struct(g.alias("g"), turned(g).alias("t")))
    places = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, -1, -1) for i in range(n)))
    bit = lambda s, p: F.call_function("shiftright", F.get(s["g"], p["i"]).bitwiseXOR(s["t"]), p["q"]).bitwiseAND(F.lit(1).cast("long"))
    index = F.transform(done, lambda s: F.aggregate(places, F.lit(0).cast("long"), lambda r, p: r * 2 + bit(s, p)))
    return F.get(index, F.lit(0))


def cells(size: Column, lang: Column, source: Column, bits: int = LEVELS) -> list[Column]:
    """Quantised coordinates; a category's cell is a hash of its name, so new names move no others."""
    top = (1 << bits) - 1
    name = lambda c: F.when(c.isNull(), 0).otherwise(1 + F.crc32(c.cast("binary")) % top)
    return [F.least(F.floor(F.log2(size.cast("double")) * 8), F.lit(top)), name(lang), name(source)]


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve`` for every document."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.xxhash64(raw).alias("h"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.monotonically_increasing_id().alias("row"),
    )
    own = C.settle(own, "shard-keys")
    group = ["h", "text_crc32", "size"]
    box = C.settle(own.groupBy(*group).agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.count("*").alias("n")).select(*group, "n", hilbert(cells(F.col("size"), F.col("lang"), F.col("source"))).alias("curve")), "boxes")
    # a group of equal texts may hold any share of all rows
    met = spread_join(own.drop("lang", "source"), box.drop("n"), group, box, F.col("row"))
    placed = running(met.withColumn("one", F.lit(1)), [], ["curve", "text_crc32", "h", "doc_id", "row"], {"rank": "one"}, label="curve")
    total = box.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    out = placed.crossJoin(F.broadcast(total))  # one row
    at = F.expr(f"cast(rank * {shards} div total as int)")
    return out.withColumn("shard", at).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
