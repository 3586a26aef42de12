"""Quality scores from supervised subword embeddings, trained by numpy stochastic gradient descent.

A document is the mean of the vectors of its units: lower-cased words and their character 3- to 5-grams with word
borders, hashed into ``2 ** BITS`` rows. A softmax over two classes reads that mean. As both are linear, scoring
needs one number per row, so the trained model is broadcast as ``2 ** BITS`` floats.

Edge cases: a null, empty or wordless text scores the share of label 1 among the training rows; without labels of
both classes every score is that share (0.0 without any); a null ``doc_id`` is never held out and never trains;
repeated rows are scored one by one; of rows that share an id the one with the smallest text trains, so copies don't
stretch the sample; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm import common as C

BITS, WIDTH, GRAMS = 18, 16, (3, 4, 5)
#: The training sample's bound: so many labelled documents at most, the same in every run.
SAMPLE = 5_000
EPOCHS, RATE, SEED = 4, 0.5, 5
THRESHOLD, DIVISOR, HELD_OUT = 0.7, 4, 2
#: Characters hashed in one go.
SPAN = 1 << 19
_LOWER = C.byte_table(lower=True, blank="\t\n\v\f\r")
_POINT64 = C.mix64(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))


def unit_spans(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The units of a text, by spans of characters: (positions, rows)."""
    shift = np.uint64(64 - BITS)
    text = np.frombuffer((b" " + raw.translate(_LOWER) + b" ").decode(errors="replace").encode("utf-32-le"), "<u4")
    for a in range(0, len(text), SPAN):
        points = text[a : a + SPAN + GRAMS[-1] - 1]
        code, blank = _POINT64[points], points == 32
        for n in GRAMS:
            m = min(SPAN, len(points) - n + 1)
            if m <= 0:
                continue
            inner = ~blank[1 : 1 + m] if n == 3 else ~np.logical_or.reduce([blank[k : k + m] for k in range(1, n - 1)])
            at = np.flatnonzero(inner)
            h = code[at]
            for k in range(1, n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + code[at + k]
            yield at + a, (C.mix64(h + np.uint64(n)) >> shift).astype(np.int64)


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, counts = C.batch_words(texts, _LOWER)
    return (C.mix64(h + np.uint64(77)) >> np.uint64(64 - BITS)).astype(np.int64), counts


def units(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a text's units, and how often each occurs."""
    words, _ = word_rows(pa.array([text], pa.string()))
    parts = [words] + [rows for _, rows in unit_spans(text.encode())] if len(words) else []
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """One number per row and the bias of the log-odds of label 1."""
    share = sum(y for *_, y in examples) / max(1, len(examples))
    if share in (0, 1):
        return np.zeros(1 << BITS, np.float32), float("inf") if share else float("-inf")
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((2, WIDTH), np.float32), np.array([np.log(1 - share), np.log(share)])
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            rows, counts, y = examples[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(rows):
                continue
            part = (counts / counts.sum()).astype(np.float32)
            own = vectors[rows]
            mean = part @ own
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = (rate * (p @ out)).astype(np.float32)
            out -= (rate * np.outer(p, mean)).astype(np.float32)
            bias -= 0.1 * rate * p
            # the update is shared by units as they make up the mean, scaled as if each were one of few
            vectors[rows] = own - np.minimum(part * 50, 1.0)[:, None] * step
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for key, y, text in zip(*(batch.column(c).to_pylist() for c in ("sample_id", "label", "text")), strict=True):
            rows.append((key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, key, y, *units(text)))
    rows.sort(key=lambda r: (*r[:3], int(r[4].sum())))
    weights, bias = fit([(r, n, y) for *_, y, r, n in rows])
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], ["weights", "bias"])


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The scoring numbers, learned from at most ``limit`` labelled rows that are not held out."""
    C.small_batches(documents.sparkSession)
    sample = C.bounded_sample(labels, label, limit, DIVISOR, HELD_OUT)
    texts = C.sample_texts(documents, sample).select("sample_id", "label", F.col("text").cast("string").alias("text"))
    once = texts.groupBy("sample_id", "label").agg(F.min("text").alias("text"))
    got = once.coalesce(1).mapInArrow(train_task, "weights binary, bias double").collect()
    return (np.frombuffer(got[0].weights, np.float32), got[0].bias) if got else (np.zeros(1 << BITS, np.float32), float("-inf"))


def log_odds(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The log-odds of label 1 of each text of a batch."""
    rows, counts = word_rows(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(doc, weights=weights[rows], minlength=len(counts))
    number = counts.astype(np.float64)
    raws, size = [], 0

    def flush() -> None:
        nonlocal raws, size
        if raws:
            # a character is a position; texts are joined by a blank, which no unit crosses
            lengths = np.array([len(r.decode(errors="replace")) + 1 for _, r in raws])
            ends = np.cumsum(lengths) + 1
            which = np.array([i for i, _ in raws])
            for at, unit in unit_spans(b" ".join(r for _, r in raws)):
                # a gram that starts at the border blank belongs to the text that follows it
                owner = which[np.minimum(np.searchsorted(ends, at + 1, side="right"), len(which) - 1)]
                total[:] += np.bincount(owner, weights=weights[unit], minlength=len(counts))
                number[:] += np.bincount(owner, minlength=len(counts))
        raws, size = [], 0

    for i, raw in enumerate(C.raw_texts(texts)):
        if raw and counts[i]:
            raws.append((i, raw))
            size += len(raw)
            if size >= SPAN:
                flush()
    flush()
    return total / np.maximum(number, 1) + bias


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(train(documents, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, bias = model.value
            p = 1.0 / (1.0 + np.exp(-np.clip(log_odds(batch.column("text"), weights, bias), -700, 700))) if np.isfinite(bias) else np.full(batch.num_rows, float(bias > 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(C.crc_remainder(F.col("doc_id"), DIVISOR) == HELD_OUT, F.lit(False))
    return own.mapInArrow(score, "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")
