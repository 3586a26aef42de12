"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashed unigrams, bigrams and one-word skip-grams of its lower-cased
words (ASCII punctuation separates words). Per-coordinate learning rates and L1 leave few weights, which are
broadcast; the hash space ``2 ** BITS`` bounds them whatever the corpus holds.

Edge cases: a null, empty or wordless text scores the model's prior; without labels of both classes every score
is 0.0; a null ``doc_id`` is never held out and never trains; repeated rows are scored one by one; of rows that share an id
one trains, the one with the smallest features, so copies don't stretch the sample; columns of ``documents`` other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm import common as C

#: log2 of the number of hashed coordinates.
BITS = 20
#: The training sample's bound: so many labelled documents at most, the same in every run.
SAMPLE = 12_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 4.0, 1.0
THRESHOLD, DIVISOR, HELD_OUT = 0.5, 5, 0
_SPLIT = C.byte_table(lower=True, blank="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text of a batch: (row numbers, coordinates), sorted by row."""
    h, counts = C.batch_words(texts, _SPLIT)
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    shift = np.uint64(64 - bits)
    parts = [(doc << np.uint64(bits)) | (C.mix64(h) >> shift)]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = C.mix64(h[:-gap] * np.uint64(factor) + h[gap:] + np.uint64(gap))
            parts.append((((doc[gap:]) << np.uint64(bits)) | (pair >> shift))[same])
    keys = C.sorted_unique(np.concatenate(parts))
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sample_id, label, text`` to ``sample_id, label, feats``."""
    for batch in batches:
        rows, idx = features(batch.column("text"))
        offsets = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        feats = pa.ListArray.from_arrays(pa.array(offsets), pa.array(idx.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("label"), feats], ["sample_id", "label", "feats"])


def fit(examples: list[tuple[np.ndarray, int]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the examples in order: (coordinates, weights, bias). Presence features count 1."""
    positive = sum(y for _, y in examples)
    if not positive or positive == len(examples):
        return np.zeros(0, np.int64), np.zeros(0), float("-inf")
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = float(np.log((positive + 0.5) / (len(examples) - positive + 0.5)))
    bias_n = 0.0
    for _ in range(EPOCHS):
        for idx, y in examples:
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            g = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            sigma = (np.sqrt(ni + g * g) - root) / ALPHA
            z[idx] = zi + g - sigma * w
            n[idx] = ni + g * g
            bias_n += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w)
    return at, w[at], bias


def train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task over the bounded sample, in an order that no partitioning changes."""
    rows: list[tuple[int, int, np.ndarray]] = []
    for batch in batches:
        feats = batch.column("feats")
        values, offsets = feats.values.to_numpy(zero_copy_only=False), feats.offsets.to_numpy()
        for i, (key, y) in enumerate(zip(batch.column("sample_id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
            rows.append((key, y, values[offsets[i] : offsets[i + 1]].copy()))
    rows.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, r[0], r[1], len(r[2])))
    at, w, bias = fit([(idx, y) for _, y, idx in rows])
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], ["at", "w"])


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Dense float32 weights and the bias, learned from at most ``limit`` labelled rows that are not held out."""
    spark = documents.sparkSession
    C.small_batches(spark)
    sample = C.bounded_sample(labels, label, limit, DIVISOR, HELD_OUT)
    feats = C.sample_texts(documents, sample).select("sample_id", "label", "text").mapInArrow(C.tidy(extract), "sample_id long, label int, feats array<int>")
    once = feats.groupBy("sample_id", "label").agg(F.min("feats").alias("feats"))
    model = once.coalesce(1).mapInArrow(C.tidy(train_task), "at long, w double").collect()
    weights, bias = np.zeros(1 << BITS, np.float32), float("-inf")
    for at, w in model:
        if at < 0:
            bias = w
        else:
            weights[at] = w
    return weights, bias


def scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The score of each text of a batch."""
    rows, idx = features(texts)
    total = np.bincount(rows, weights=weights[idx], minlength=len(texts)) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700))) if np.isfinite(bias) else np.zeros(len(texts))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(train(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scores(batch.column("text"), *model.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(C.crc_remainder(F.col("doc_id"), DIVISOR) == HELD_OUT, F.lit(False))
    return own.mapInArrow(C.tidy(run), "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the model does not reject; whatever their columns are called, they stay as they are."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(train(documents, labels))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), *model.value) < THRESHOLD))

    return C.map_rows(documents, run)
