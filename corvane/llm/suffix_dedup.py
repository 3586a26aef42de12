"""Repeated passages by a depth-limited radix sort of suffixes, most significant digit first.

A suffix counts only up to its first ``LENGTH`` bytes. The sort goes through digits from the front of the suffix, and
after each pass only suffixes in groups of more than one stay; what is left at depth ``LENGTH`` are exactly the
repeated windows. Only groups matter in the end, so a pass needs no order between them and compares digits by hash.

One row for each suffix would be several times the input, so suffixes move in runs wherever that is possible:

1. *Thinning.* Each window of ``LENGTH`` bytes has an anchor, the place inside it where the hash of the next ``GRAM``
   bytes is smallest; neighbouring windows share it, and equal windows have equal anchors at equal places. One row,
   the suffix at the anchor, stands for the run of up to ``LENGTH - GRAM + 1`` windows around it.
2. *First digit of the anchored suffix*, its first ``GRAM`` bytes: runs alone in their group leave the sort.
3. *Whole runs.* Runs that agree in all bytes that their windows cover are equal window by window and are settled
   together. Of each kind one run goes on.
4. *Further digits.* A pass goes ``STEP`` bytes deeper into the anchored suffix, and as far into the reversed text in
   front of it. Where a run is alone at a depth, its windows that reach that far are alone too and leave the sort.
5. *Last pass.* The windows still in are told apart by their whole ``LENGTH`` bytes.

Groups are counted with map-side sums and joined back with hot groups dealt over many tasks, so a passage that a third
of all documents share costs no task more than its share. Each table is deleted when the next one is written. Digits
are 64-bit hashes, with which a run may at worst stay too long; kinds of runs and whole windows are told apart by 128 bits.

Edge cases: a null or empty text has no bytes and keeps the hash of nothing; texts shorter than ``LENGTH`` keep all
bytes; repeated rows count as copies of each other; a null ``doc_id`` is a document like any other; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm import common as C
from corvane.operators.skew import spread_join

LENGTH, GRAM, STEP = 200, 64, 34
#: Suffixes handled in one go; 20 bits of the sliding minimum hold a position.
SPAN = (1 << 20) - 1024
_SECOND = C.mix64(C.BYTE64 + np.uint64(0x1234567))


def _prefix(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash of ``data``, and the inverse powers that shift a substring to the front."""
    power, inverse = C.powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    v = values[data]
    v *= power
    np.cumsum(v, out=total[1:])
    return total, inverse


def spans_of(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Cuts a batch into (first document, one past the last, first byte, end); a long document is cut into several."""
    d, n = 0, len(offsets) - 1
    while d < n:
        a = int(offsets[d])
        if offsets[d + 1] - a > SPAN:
            end = int(offsets[d + 1])
            for s in range(a, end - length + 1, SPAN - length + 1):
                yield d, d + 1, s, min(end, s + SPAN)
            d += 1
            continue
        e = max(d + 1, int(np.searchsorted(offsets, a + SPAN, side="right")) - 1)
        yield d, e, a, int(offsets[e])
        d = e


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (document, first start, windows before the anchor's, further windows, first digit, hash of all bytes)."""
    out: list[tuple[np.ndarray, ...]] = []
    width = length - gram + 1
    for d, e, a, b in spans_of(offsets, length):
        if b - a < length:
            continue
        own = data[a:b]
        edges = np.clip(offsets[d : e + 1] - a, 0, b - a)
        total, inverse = _prefix(own, C.BYTE64)
        grams = C.mix64((total[gram:] - total[:-gram]) * inverse[: len(own) - gram + 1])
        low = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        anchor = (low & np.uint64(0xFFFFF)).astype(np.int64)
        steps = np.zeros(len(own) + 1, np.int32)
        long = edges[1:] - edges[:-1] >= length
        np.add.at(steps, edges[:-1][long], 1)
        np.add.at(steps, edges[1:][long] - length + 1, -1)
        start = np.flatnonzero(np.cumsum(steps)[: len(anchor)] > 0)
        if not len(start):
            continue
        at = anchor[start]
        owner = np.searchsorted(edges, start, side="right") - 1
        cut = np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
        head = np.flatnonzero(cut)
        first, last = start[head], start[np.append(head[1:], len(start)) - 1]
        at, owner = at[head], owner[head]
        context = C.mix64((total[last + length] - total[first]) * inverse[first] + ((at - first) << 32 | (last - first)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        base = offsets[d + owner] - a
        out.append((d + owner, first - base, at - first, last - first, grams[at].view(np.int64), context.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))


def run_batches(length: int, gram: int, digits_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, first, lead, more, digit, context = runs(*C.flat_bytes(batch.column("text")), length, gram)
            if digits_only:
                yield pa.RecordBatch.from_arrays([pa.array(digit)], ["digit"])
                continue
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array((first * 4096 + lead) * 4096 + more), pa.array(digit), pa.array(context)], ["k1", "k2", "span", "digit", "context"])

    return run


def piece_batches(length: int, gram: int, depths: list[int]):
    """``k1, k2, text, spans`` to the bytes under each of the spans, and their digits to both sides of the anchor:
    ``k1, k2, first, lead, more, piece, ahead, behind``; a digit that the piece is too short for is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.flat_bytes(batch.column("text"))
            counts = np.diff(batch.column("spans").offsets.to_numpy())
            span = batch.column("spans").flatten().to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), counts)
            raw = data.tobytes()
            for i in range(0, len(span), 2_000):
                first, lead, more = span[i : i + 2_000] >> 24, span[i : i + 2_000] >> 12 & 4095, span[i : i + 2_000] & 4095
                a = offsets[rows[i : i + 2_000]] + first
                pieces = [raw[x:y] for x, y in zip(a.tolist(), (a + more + length).tolist(), strict=True)]
                own = np.frombuffer(b"".join(pieces), np.uint8)
                end = np.cumsum(more + length)
                start = end - (more + length)
                total, inverse = _prefix(own, C.BYTE64)
                at = start + lead
                sides: list[np.ndarray] = []
                for depth in depths:
                    for lo, hi in ((at, at + gram + depth), (at - depth, at + gram)):
                        x, y = np.maximum(lo, start), np.minimum(hi, end)
                        digit = C.mix64((total[y] - total[x]) * inverse[x]).view(np.int64)
                        sides.append(np.where((lo >= start) & (hi <= end), digit, 0))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.stack(sides[k::2], 1).reshape(-1)), len(depths)).cast(pa.list_(pa.int64())) for k in (0, 1)]
                where = pa.array(rows[i : i + 2_000])
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(where), batch.column("k2").take(where), *map(pa.array, (first, lead, more)), pa.array(pieces, pa.binary()), *lists], ["k1", "k2", "first", "lead", "more", "piece", "ahead", "behind"])

    return run


def window_batches(length: int):
    """``id, piece, lo, hi`` to the windows from ``lo`` to ``hi``: ``id * 4096 + place`` and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.flat_bytes(batch.column("piece"))
            ids, low, high = (np.asarray(batch.column(c)) for c in ("id", "lo", "hi"))
            counts = high - low + 1
            rows = np.repeat(np.arange(len(ids)), counts)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + low[rows]
            sums = []
            for values in (C.BYTE64, _SECOND):
                total, inverse = _prefix(data, values)
                at = offsets[rows] + place
                sums.append(pa.array(C.mix64((total[at + length] - total[at]) * inverse[at]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows] * 4096 + place), *sums], ["at", "d1", "d2"])

    return run


def cut_batches(length: int):
    """``doc_id, text, spans`` to the result's rows; spans are window starts, ``first * 4096 + more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, str]] = []
            spans_column = batch.column("spans")
            for raw, spans in zip(C.raw_texts(batch.column("text")), spans_column, strict=True):
                raw = raw or b""
                if not spans.is_valid:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                s = np.sort(spans.values.to_numpy())
                first = s // 4096
                end = np.maximum.accumulate(first + s % 4096 + length)
                head = np.concatenate(([True], first[1:] > end[:-1]))
                lo, hi = first[head], end[np.append(np.flatnonzero(head)[1:], len(s)) - 1]
                digest, at = hashlib.sha256(), 0
                for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                    digest.update(raw[at:x])
                    at = y
                digest.update(raw[at:])
                out.append((len(raw), int((hi - lo).sum()), len(lo), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _replaced(df: DataFrame, label: str, *old: DataFrame) -> DataFrame:
    """``df`` written out; the tables it was made of are deleted."""
    out = C.settle(df, label)
    C.forget(*old)
    return out


def shrunk(pieces: DataFrame, length: int, gram: int, depths: list[int]) -> DataFrame:
    """``id, lo, hi``: the windows of each piece that the passes over further digits leave in, where any are."""
    side = lambda k, digits, reach: F.struct(F.lit(k).alias("side"), F.col(digits).alias("digits"), reach.cast("int").alias("reach"))
    both = F.array(side(0, "ahead", F.col("more") + (length - gram) - F.col("lead")), side(1, "behind", F.col("lead")))
    sides = C.settle(pieces.select("id", F.explode(both).alias("x")).select("id", "x.*"), "sides")
    live, steps, alone = sides, [sides], []
    for i, depth in enumerate(depths):
        # a run that doesn't reach that deep has no window that does
        now = live.where(F.col("reach") >= depth).withColumn("digit", F.get("digits", F.lit(i)))
        groups = C.settle(now.groupBy("side", "digit").agg(F.count("*").alias("n")).where("n > 1"), "groups")
        steps.append(C.settle(spread_join(now, groups.select("side", "digit", F.lit(True).alias("shared")), ["side", "digit"], groups, F.col("id"), "left"), "step"))
        C.forget(groups)
        alone.append(steps[-1].where("shared is null").select("id", "side", F.lit(depth).alias("depth")))
        live = steps[-1].where("shared").select("id", "side", "digits", "reach")
    cut = alone[0]
    for deeper in alone[1:]:
        cut = cut.unionByName(deeper)
    cut = cut.groupBy("id").agg(F.min(F.when(F.col("side") == 0, F.col("depth"))).alias("ahead"), F.min(F.when(F.col("side") == 1, F.col("depth"))).alias("behind"))
    low = F.coalesce(F.col("lead") - F.col("behind") + 1, F.lit(0))
    high = F.coalesce(F.least("more", F.col("lead") + F.col("ahead") + (gram - length) - 1), F.col("more"))
    bounds = pieces.select("id", "lead", "more").join(cut, "id", "left").select("id", low.cast("long").alias("lo"), high.cast("long").alias("hi")).where("lo <= hi")
    return _replaced(bounds, "bounds", *steps)


def repeated_passages(documents: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """``k1, k2, spans``: the repeated windows by document key; a span is ``first start * 4096 + further starts``."""
    C.small_batches(documents.sparkSession)
    gram = gram or min(GRAM, max(1, length * 5 // 8))
    depths = sorted({*range(STEP, length - gram, STEP), length - gram})
    texts = keyed(documents).select("k1", "k2", "text")
    digits = texts.select("text").mapInArrow(C.tidy(run_batches(length, gram, True)), "digit long")
    twice = C.settle(digits.groupBy("digit").agg(F.count("*").alias("n")).where("n > 1"), "digits")
    every = texts.mapInArrow(C.tidy(run_batches(length, gram, False)), "k1 long, k2 long, span long, digit long, context long")
    left = _replaced(spread_join(every, twice.select("digit"), ["digit"], twice, F.xxhash64("k2", "span")), "runs", twice)
    kind = ["digit", "context"]
    groups = C.settle(left.groupBy(*kind).agg(F.count("*").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("span").alias("span")), "kinds")
    again = C.settle(groups.where("n > 1").select(*kind, "n"), "kinds-again")
    settled = F.shiftright("span", 24) * 4096 + F.col("span").bitwiseAND(F.lit(4095))
    whole = _replaced(spread_join(left, again.select(*kind), kind, again, F.xxhash64("k2", "span")).select("k1", "k2", settled.alias("span")), "whole-runs", left, again)
    mixed = C.settle(groups.groupBy("digit").agg(F.count("*").alias("n")).where("n > 1"), "mixed")
    single = _replaced(spread_join(groups, mixed.select("digit"), ["digit"], mixed, F.col("context")).select("k1", "k2", "span"), "single-runs", groups, mixed)
    spans = single.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))
    schema = "k1 long, k2 long, first long, lead long, more long, piece binary, ahead array<long>, behind array<long>"
    opened = texts.join(spans, ["k1", "k2"]).mapInArrow(C.tidy(piece_batches(length, gram, depths)), schema)
    pieces = _replaced(opened.withColumn("id", F.monotonically_increasing_id()), "pieces", single)
    bounds = shrunk(pieces, length, gram, depths)
    windows = _replaced(pieces.select("id", "piece").join(bounds, "id").mapInArrow(C.tidy(window_batches(length)), "at long, d1 long, d2 long"), "windows", bounds)
    equal = C.settle(windows.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1"), "equal")
    places = spread_join(windows, equal.select("d1", "d2"), ["d1", "d2"], equal, F.col("at")).select(F.shiftright("at", 12).alias("id"), F.col("at").bitwiseAND(F.lit(4095)).alias("place"))
    found = _replaced(places.join(pieces.select("id", "k1", "k2", "first"), "id").select("k1", "k2", ((F.col("first") + F.col("place")) * 4096).alias("span")), "repeats", pieces, windows, equal)
    # copies of a row share its key and repeat its spans
    return _replaced(whole.unionByName(found).groupBy("k1", "k2").agg(F.collect_set("span").alias("spans")), "spans", whole, found)


def keyed(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` and a key that equal rows share."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumns({"k1": F.coalesce("doc_id", F.lit(-1).cast("long")), "k2": F.xxhash64("doc_id", "text")})


def drop_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every document."""
    rows = keyed(documents).join(repeated_passages(documents, length), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(C.tidy(cut_batches(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
