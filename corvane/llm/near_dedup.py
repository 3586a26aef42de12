"""MinHash near-duplicates by fast similarity sketching, banding, and exact verification on full sets.

A sketch has ``BANDS * ROWS`` coordinates. In round i of the first T each shingle is thrown into one hashed bin, in
round T + i all shingles go to bin i, and a coordinate keeps the smallest (round, hash) it saw; a document stops at
the first round that leaves no bin empty, so 2T rounds fill every coordinate. Sets that agree in all rows of a band
become candidates. With 32 bands of 5 rows a pair at similarity 0.8 is missed with probability 3e-6.

Equal sets are collapsed first. Each bucket's first member is its pivot and is compared with the others; a group of
near copies costs one comparison a member and band, most of them the same. Members of buckets that this leaves with
several components are dealt anew, by the shingles of their sets' prefixes in order of rarity, which every pair to be
linked shares and documents that merely hold the same passage don't. There several pivots a round, four times as many
each time, are compared with the members of other components until each bucket is one component or each pair across
components was compared. Pairs reach verification only if their sizes and one bit of each of 128 coordinates allow
the threshold (a true pair fails that with probability under 1e-10); verification then counts the intersection of
the whole sets.

Joins on buckets, shingles and equal sets deal hot keys over many tasks (``operators/skew.py``); a row that is
repeated with its id goes to verification once.

Edge cases: a null, empty or wordless text has an empty set and is linked with nothing; with fewer words than a
shingle has, the whole sequence is one shingle; in ``near_duplicates`` a null ``doc_id`` is returned with its size, no
component, and kept, and rows that share a ``doc_id`` are one node of the graph; ``keep_one`` judges rows, whatever
their ids; other columns are ignored, or kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corvane.llm import common as C
from corvane.operators.components import components
from corvane.operators.skew import spread_join

BANDS, ROWS = 32, 5
#: Agreeing bits of 128 below which a pair isn't verified; 115 are expected at similarity 0.8.
LEAST_BITS = 92
_LOWER = C.byte_table(lower=True, blank="")
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, in a row, and the size of each set."""
    h, counts = C.batch_words(texts, _LOWER)
    ends = np.cumsum(counts)
    chain = h.copy()
    for k in range(1, words):
        chain = C.mix64(chain[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k:]) if len(chain) > 1 else chain[:0]
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        if n >= words:
            own = C.sorted_unique(chain[end - n : end - words + 1])
        elif n:
            short = np.uint64(n)
            for x in h[end - n : end]:
                short = C.mix64(np.array([short], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + x)[0]
            own = np.array([short], np.uint64)
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes


def sketches(values: np.ndarray, sizes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``size`` coordinates for each set; the row of an empty set stays unfilled."""
    out = np.full(len(sizes) * size, _FULL)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    low = np.uint64((1 << 48) - 1)
    for i in range(2 * size):
        if not len(doc):
            break
        x = C.mix64(values + np.uint64((i * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))
        value = (x & low) | (np.uint64(i) << np.uint64(48))
        at = ((x >> np.uint64(48)) * np.uint64(size) >> np.uint64(16)).astype(np.int64) if i < size else i - size
        np.minimum.at(out, doc * size + at, value)
        open_rows = (out.reshape(-1, size) == _FULL).any(1)
        keep = open_rows[doc]
        if not keep.all():
            doc, values = doc[keep], values[keep]
    return out.reshape(-1, size)


def sketch_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = shingles(batch.column("text"), words)
            table = sketches(values, sizes)
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            sums = []
            for salt in (1, 2):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(C.mix64(values + np.uint64(salt)), dtype=np.uint64)))
                sums.append(C.mix64(total[cuts[1:]] - total[cuts[:-1]] + sizes.astype(np.uint64)).view(np.int64))
            bits = (C.mix64(table[:, :128].copy()) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(bits, axis=1).view(np.int64)
            bands = np.empty((len(sizes), BANDS), np.uint64)
            for b in range(BANDS):
                chain = np.full(len(sizes), b + 1, np.uint64)
                for r in range(ROWS):
                    chain = C.mix64(chain * np.uint64(0x9E3779B97F4A7C15) + table[:, b * ROWS + r])
                bands[:, b] = chain
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.array(packed[:, 0].copy()), pa.array(packed[:, 1].copy()), lists],
                ["doc_id", "n_shingles", "s1", "s2", "bits0", "bits1", "bands"],
            )

    return run


def set_batches(words: int):
    """``id, n_shingles, bits0, bits1, text`` to the same with the set's bytes instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = shingles(batch.column("text"), words)
            data = values.tobytes()
            cuts = np.concatenate(([0], np.cumsum(sizes))) * 8
            sets = pa.array([data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), batch.column("bits0"), batch.column("bits1"), sets], ["id", "n_shingles", "bits0", "bits1", "members"])

    return run


def list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, members`` (bytes) to ``id, grams`` (a list of hashes)."""
    for batch in batches:
        data = batch.column("members").cast(pa.binary())
        flat, offsets = C.flat_bytes(data)
        lists = pa.ListArray.from_arrays(pa.array((offsets // 8).astype(np.int32)), pa.array(np.frombuffer(flat.tobytes(), np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "grams"])


def prefix_buckets(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """``key, id, n, r``: the shingles of each set's prefix, rarest first among these sets, the set's size, and how many
    shingles from the key on the set has.

    Two sets of similarity s share a shingle among the first ``n - ceil(s * n) + 1`` of each in any common order, so
    every pair that is to be linked shares a key, while a passage that many documents hold is in few prefixes.
    """
    rows = C.settle(sets.join(ids, "id", "left_semi").select("id", "members").mapInArrow(list_batches, "id long, grams array<long>").select("id", F.size("grams").alias("n"), F.explode("grams").alias("g")), "grams")
    often = C.settle(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "often")
    known = often.select("g", F.col("n").alias("f"))
    ordered = spread_join(rows, known, ["g"], often, F.col("id")).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("o"))
    # shingles of one set alone come first and meet nothing: they only shorten the rest of the prefix
    alone = F.col("n") - F.size("o")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1 - alone
    return ordered.where(length > 0).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("o", F.lit(1), length.cast("int"))).alias("at", "x")).select(F.col("x.g").alias("key"), "id", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("r"))


def verify_batches(percent: int):
    """``a, b, set_a, set_b`` to the pairs ``a, b`` with ``100 * intersection >= percent * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((p, q)))
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``documents``."""
    spark = documents.sparkSession
    C.small_batches(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = C.settle(texts.mapInArrow(C.tidy(sketch_batches(words)), "doc_id long, n_shingles long, s1 long, s2 long, bits0 long, bits1 long, bands array<long>").withColumn("row", F.monotonically_increasing_id()), "sketches")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    if not rows.where(linked).groupBy("doc_id", "s1", "s2").count().where("count > 1").isEmpty():
        texts = texts.where("doc_id is not null").dropDuplicates()
    reps = C.settle(
        rows.where(linked).groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.min_by(F.struct("n_shingles", "bits0", "bits1", "bands"), "doc_id").alias("x")).select("s1", "s2", "id", "n", "x.*"),
        "representatives",
    )
    spread = reps.select("id", F.explode("bands").alias("key")).distinct()
    shared = C.settle(spread.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1"), "shared")
    buckets = C.settle(spread_join(spread, shared.select("key", "pivot"), ["key"], shared, F.col("id")).select("key", "id", "pivot"), "buckets")
    wanted = reps.select("id", "bits0", "bits1").join(buckets.select("id").distinct(), "id")
    sets = C.settle(
        texts.withColumnRenamed("doc_id", "id").join(wanted, "id").mapInArrow(C.tidy(set_batches(words)), "id long, n_shingles long, bits0 long, bits1 long, members binary"),
        "sets",
    )
    light = sets.select("id", "n_shingles", "bits0", "bits1")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*(F.col(c).alias(name if c == "id" else f"{c}_{name}") for c in df.columns))

    def verified(pairs: DataFrame) -> DataFrame:
        close = pairs.distinct().join(side(light, "a"), "a").join(side(light, "b"), "b")
        close = close.where(
            (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
            & (128 - F.bit_count(F.col("bits0_a").bitwiseXOR(F.col("bits0_b"))) - F.bit_count(F.col("bits1_a").bitwiseXOR(F.col("bits1_b"))) >= LEAST_BITS)
        ).select("a", "b")
        own = sets.select("id", "members")
        both = close.join(own.withColumnsRenamed({"id": "a", "members": "set_a"}), "a").join(own.withColumnsRenamed({"id": "b", "members": "set_b"}), "b")
        return both.select("a", "b", "set_a", "set_b").mapInArrow(C.tidy(verify_batches(percent)), "a long, b long")

    roots = C.settle(components(C.settle(verified(buckets.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))), "links")), "roots")
    # buckets that the first pivots left open are dealt anew, by rare shingles
    live, sizes = _unresolved(prefix_buckets(sets, _open_ids(buckets, roots), percent), roots, percent)
    pivots = 4
    while not live.isEmpty():
        ranked = F.row_number().over(Window.partitionBy("key").orderBy("n", "id"))
        first = C.settle(live.withColumn("rank", ranked).where(F.col("rank") <= pivots), "pivots")
        last = first.groupBy("key").agg(F.max(F.struct("n", "id")).alias("last"))
        ahead = first.select("key", *(F.col(c).alias(f"{c}_a") for c in ("id", "n", "r", "root")))
        later = F.struct("n", "id") > F.struct(F.col("n_a"), F.col("id_a"))
        fits = (percent * (F.col("n") + F.col("n_a")) <= (100 + percent) * F.least("r", "r_a")) & (100 * F.col("n_a") >= percent * F.col("n"))
        pairs = spread_join(live, ahead, ["key"], sizes, F.col("id")).where(later & (F.col("root") != F.col("root_a")) & fits).select(F.col("id_a").alias("a"), F.col("id").alias("b"))
        links = C.settle(verified(pairs), "links")
        if not links.isEmpty():
            step = C.settle(components(_contract(links, roots)), "steps")
            roots = C.settle(_compose(roots, step), "roots")
        beyond = spread_join(live, last, ["key"], sizes, F.col("id")).where(F.struct("n", "id") > F.col("last")).select("key", "id", "n", "r")
        rest, rest_sizes = _unresolved(beyond, roots, percent)
        C.forget(live, sizes, first, links)
        live, sizes, pivots = rest, rest_sizes, pivots * 4
    C.forget(live, sizes, sets, buckets, shared)
    named = reps.select("s1", "s2", "id").join(roots, "id", "left").select("s1", "s2", F.coalesce("root", "id").alias("component_id"))
    own = rows.where(linked).select("doc_id", "n_shingles", "s1", "s2", "row")
    out = spread_join(own, named, ["s1", "s2"], reps.select("s1", "s2", "n"), F.col("row")).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rooted(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    return buckets.join(roots, "id", "left").select(*buckets.columns, F.coalesce("root", "id").alias("root"))


def _open_ids(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    known = C.settle(_rooted(buckets.select("key", "id"), roots), "members")
    split = C.settle(known.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1"), "split")
    return C.settle(spread_join(known, split.select("key"), ["key"], split, F.col("id")).select("id").distinct(), "open")


def _unresolved(buckets: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members, with their roots, of the buckets that hold more than one component, and these buckets' sizes; written out.

    Sets whose first common shingle is the key share ``least(r)`` shingles at most, and need ``percent / (100 +
    percent)`` of both sizes; members that miss that even with the bucket's smallest size and largest ``r`` leave.
    """
    known = C.settle(_rooted(buckets, roots), "members")
    split = C.settle(known.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("n").alias("least_n"), F.max("r").alias("most_r")).where("r0 <> r1"), "split")
    met = spread_join(known, split.select("key", "least_n", "most_r"), ["key"], split, F.col("id")).where(percent * (F.col("n") + F.col("least_n")) <= (100 + percent) * F.least("r", "most_r"))
    live = C.settle(met.select("key", "id", "n", "r", "root"), "live")
    sizes = C.settle(live.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    C.forget(known, split)
    return live, sizes


def _contract(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between the components of ``roots``."""
    a = roots.withColumnsRenamed({"id": "a", "root": "ra"})
    b = roots.withColumnsRenamed({"id": "b", "root": "rb"})
    return links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))


def _compose(roots: DataFrame, step: DataFrame) -> DataFrame:
    """``roots`` after its components were merged as ``step`` says."""
    renamed = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
    old = roots.join(renamed, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return old.unionByName(step.join(roots, "id", "left_anti").select("id", "root"))


def numbered(documents: DataFrame, name: str) -> DataFrame:
    """``documents`` with a row number in the column ``name``, by ``doc_id`` (null last); written out."""
    at = F.monotonically_increasing_id()
    order = [F.col("doc_id").asc_nulls_last(), C.quoted(name)]
    return C.settle(documents.withColumn(name, at).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, at), "numbered")


def keep_one(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id, with the columns of ``documents``.

    Where all rows have an id of their own, it names them; otherwise they are numbered first, so that rows without an
    id or with the id of another text are judged like all others.
    """
    if documents.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows, key = documents, "doc_id"
    else:
        key = C.fresh("row", documents.columns)
        rows = numbered(documents, key)
    found = C.settle(near_duplicates(rows.select(C.quoted(key).cast("long").alias("doc_id"), "text"), words, percent), "verdicts")
    dropped = found.where("not kept").select(F.col("doc_id").alias(key))
    return rows.join(dropped, key, "left_anti").select(*(C.quoted(c) for c in documents.columns))
