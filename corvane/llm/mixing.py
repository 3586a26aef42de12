"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Source weights give each source a share of the mix; a share stops at ``MOST`` times what the source holds and the
excess goes to the others by weight (water filling, solved in closed form over the sources ordered by the level at
which each is full). Over training time t in [0, 1] the weight of a source moves linearly from ``1 + tilt`` to
``1 - tilt`` times its share, with tilts that differ by source. The cumulative demand of a source is the integral
of that schedule; inverting it at a document's cumulative words gives the document's training position. A document's
second use has a position of its own, where the demand has gone once through the whole source.

Within a source documents follow the hash of their id. The first ``size`` words of the target take each document
once, the rest starts again from the front; the document at the border is taken in part, so the words taken equal
the target rounded down.

Rows that are equal in all that counts are added up before any shuffle and told apart again by their number at the end,
and the join with the sources' targets deals a hot source over many tasks.

Edge cases: a null text has size 0 and takes nothing; documents without a source form a source of their own, last
in order; sources without words have target 0; repeated rows count one by one, each with words of its own; other
columns are ignored by ``mix`` and kept, whatever their names, by ``mixed_documents``; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.llm import common as C
from corvane.operators.order import running
from corvane.operators.skew import spread_join

#: The share of all words that the mix holds, the most a source may be repeated, and the cycle of weights.
SHARE, MOST, WEIGHTS = 1.5, 2, (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``: one row per source."""
    spark = sizes.sparkSession
    ranked = running(sizes.withColumn("one", F.lit(1)), [], ["source"], {"rank": "one"}, label="sources")
    cycle = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", cycle.cast("double").alias("weight")).withColumns(
        {"full_at": F.col("source_size") * MOST / F.col("weight"), "cap": (F.col("source_size") * MOST).cast("double"), "w": F.col("weight").cast("long")}
    )
    # before a source fills, the level has filled those that fill earlier (their caps) and the rest by weight
    steps = running(weighed, [], ["full_at", "source"], {"words_before": "source_size", "weight_before": "w"}, label="levels")
    totals = steps.agg(F.sum("source_size").alias("words"), F.sum("w").alias("weights"))
    level = (F.col("words") * SHARE - F.col("words_before") * MOST) / (F.col("weights") - F.col("weight_before"))
    levels = steps.crossJoin(F.broadcast(totals)).withColumn("level", level)  # one row of totals
    # the level is right at the first source, in this order, that it doesn't fill
    found = levels.where("level <= full_at").agg(F.min_by("level", F.struct("full_at", F.col("source").isNull(), "source")).alias("at"))
    out = steps.crossJoin(F.broadcast(found))
    return out.select("source", "source_size", "weight", F.when(F.col("source_size") > 0, F.least(F.col("weight") * F.coalesce("at", F.lit(float("inf"))), "cap")).otherwise(0.0).alias("target"))


def tilt(source: Column) -> Column:
    """How far a source's weight moves over training, in [-0.75, 0.75]; a fixed function of its name."""
    return (F.conv(F.substring(F.sha2(F.coalesce(source, F.lit("")), 256), 1, 12), 16, 10).cast("long") % 7 - 3) / 4.0


def position(share: Column, lean: Column) -> Column:
    """The time at which the integral of ``1 + lean - 2 * lean * t`` reaches ``share``."""
    root = F.sqrt(F.greatest((1 + lean) * (1 + lean) - 4 * lean * share, F.lit(0.0)))
    return F.when(lean == 0, share).otherwise(2 * share / (1 + lean + root))


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def row_keys(documents: DataFrame) -> list[Column]:
    """Two hashes of a whole row: rows that share both are equal in every column."""
    columns = [F.to_json(C.quoted(f.name)) if f.dataType.typeName() == "map" else C.quoted(f.name) for f in documents.schema]
    nulls = F.concat(*(F.when(c.isNull(), "0").otherwise("1") for c in columns))
    return [F.xxhash64(F.lit(seed), nulls, *columns) for seed in (1, 2)]


def place(documents: DataFrame, keys: list[Column]) -> DataFrame:
    """Equal rows as one: ``doc_id, source, size, crc, __h..., __deal, rows, before`` and their source's ``source_size, target``.

    ``before`` are the words of the source in front of the first of ``rows``; the others follow it. Rows are added up
    in 64 parts, so that no number of copies makes a group of all of them.
    """
    own = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"),
        F.sha2(F.col("doc_id").cast("long").cast("string"), 256).alias("h"), text_crc(F.col("text")).alias("crc"),
        *(k.alias(f"__h{i}") for i, k in enumerate(keys)), (F.spark_partition_id() % 64).alias("__deal"),
    )
    groups = own.groupBy(*own.columns).agg(F.count("*").alias("rows")).withColumn("words", F.col("rows") * F.col("size"))
    order = ["h", "doc_id", "size", "crc", *(f"__h{i}" for i in range(len(keys))), "__deal"]
    placed = C.settle(running(groups, ["source"], order, {"before": "words"}, label="mix").drop("h").withColumn("__s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))), "placed")
    sums = C.settle(placed.groupBy("source", "__s").agg(F.sum("words").alias("source_size"), F.count("*").alias("n")), "sources")
    goal = C.settle(targets(sums.select("source", "source_size")), "targets").select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("__s"), "source_size", "target")
    return spread_join(placed, goal, ["__s"], sums, F.xxhash64("before", "doc_id")).drop("__s", "words")


def assign(documents: DataFrame, keys: list[Column] | None = None) -> DataFrame:
    """``doc_id, size, crc, source_size, target, taken, position, again, __h...``; one narrow row per document, in no order.

    ``position`` and ``again`` are those of its first and second use; null for a use that takes nothing.
    """
    names = [f"__h{i}" for i in range(len(keys or []))]
    nth = place(documents, keys or []).withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    joined = nth.withColumn("before", F.col("before") + F.col("__nth") * F.col("size"))
    whole = F.floor("target")
    part = lambda start: F.greatest(F.least(whole - start, F.col("size")), F.lit(0))
    taken = (part(F.col("before")) + part(F.col("before") + F.col("source_size"))).cast("long")
    at = lambda start: position(start / F.col("target"), tilt(F.col("source")))
    out = joined.withColumn("taken", taken).withColumns({
        "position": F.when(F.col("taken") > 0, at(F.col("before"))), "again": F.when(F.col("taken") > F.col("size"), at(F.col("before") + F.col("source_size"))),
    })
    return out.select("doc_id", "size", "crc", "source_size", "target", "taken", "position", "again", *names, "__deal", "__nth")


def mix(documents: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, position`` for every document, by position.

    ``position`` is that of a document's first use; null where nothing is taken. ``assign`` has that of the second too.
    """
    return assign(documents).select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them, each use at its own position, with the same columns.

    A document that the mix takes in part is cut behind its last taken word; a document of no words never counts
    towards a target and stays once. Texts move twice: to their narrow row of the mix, and to their position. Rows
    that are equal in every column move as one.
    """
    keys, names = row_keys(documents), ["__h0", "__h1"]
    columns = [f"c{i}" for i in range(len(documents.columns))]
    rows = documents.select(F.struct(*(C.quoted(c).alias(x) for c, x in zip(documents.columns, columns, strict=True))).alias("__row"), *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    narrow = C.settle(assign(documents, keys).select("doc_id", "size", "taken", "position", "again", *names, "__deal", "__nth"), "uses")
    copies = C.settle(narrow.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1"), "copies")
    if copies.isEmpty():
        met = narrow.join(rows, names)
    else:
        met = spread_join(narrow, rows.groupBy(*names).agg(F.first("__row").alias("__row")), names, copies, F.xxhash64("__deal", "__nth"))
    size, taken = F.col("size"), F.col("taken")
    nothing = F.lit(0).cast("long")
    use = lambda n, at: F.struct(n.alias("n"), F.col(at).alias("at"))
    both = F.filter(F.array(use(F.least(taken, size), "position"), use(F.greatest(taken - size, nothing), "again")), lambda x: x["n"] > 0)
    uses = F.when(size == 0, F.array(use(nothing, "position"))).otherwise(both)
    again = met.withColumn("__one", F.explode(uses)).withColumns({"__use": F.col("__one.n"), "__at": F.col("__one.at")})
    text = F.col("__row").getField(columns[documents.columns.index("text")])
    # only the few documents at a border are cut: into words with the blanks before them
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(parts, F.lit(1), F.col("__use").cast("int")), "")
    kept = F.when((F.col("__use") < size) & (size > 0), cut).otherwise(text)
    ordered = again.orderBy(F.col("__at").asc_nulls_last(), "doc_id")
    return ordered.select(*((kept if c == "text" else F.col("__row").getField(x)).alias(c) for c, x in zip(documents.columns, columns, strict=True)))
