"""Shared plumbing of the training-data operators: tables, shared storage, word splitting, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corvane.sources.storage import forget, settle

__all__ = ["T", "forget", "settle"]

#: Rows in one Arrow batch at most; long documents make large batches otherwise.
BATCH_ROWS = 1000
BATCH_BYTES = "32m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python stages, by rows and by bytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(run):
    """A batch function that gives unused Arrow memory back when its task ends; Python workers live on."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def quoted(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until none of ``columns`` is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, run, text: str = "text") -> DataFrame:
    """``df`` through a batch function that keeps its columns by place; names never matter, and ``text`` comes out as string."""
    fields = [T.StructField(f"c{i}", T.StringType() if f.name == text else f.dataType) for i, f in enumerate(df.schema)]
    return df.toDF(*(f.name for f in fields)).mapInArrow(tidy(run), T.StructType(fields)).toDF(*df.columns)


def crc_remainder(key: Column, divisor: int) -> Column:
    """``crc32(key as text) mod divisor``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def bounded_sample(labels: DataFrame, label: str, limit: int, divisor: int, held_out: int) -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out remainder, the same ones in every run.

    The order is a hash of the id, so the choice does not lean on any column. Repeated rows count once.
    """
    return (
        labels.select(F.col("doc_id").alias("sample_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("sample_id").isNotNull() & F.col("label").isin(0, 1) & (crc_remainder(F.col("sample_id"), divisor) != held_out))
        .distinct()
        .orderBy(F.xxhash64("sample_id"), "sample_id", "label")
        .limit(limit)
    )


def sample_texts(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """``sample_id, label, text``; the sample has a fixed bound, so it is broadcast and no text moves."""
    own = documents.select(F.col("doc_id").alias("sample_id"), "text")
    return own.join(F.broadcast(sample), "sample_id")


_ASCII = bytes(range(256))


def byte_table(lower: bool, blank: str) -> bytes:
    """A table for ``bytes.translate``: ASCII lower case, and the characters of ``blank`` as spaces."""
    out = bytearray(_ASCII)
    if lower:
        for c in range(65, 91):
            out[c] = c + 32
    for c in blank.encode():
        out[c] = 32
    return bytes(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a plain sort is several times faster here than ``np.unique``'s hash table."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))]


#: Bytes whose words are hashed in one go; bounds the working memory of ``word_hashes``.
SPAN = 1 << 20
_RNG = np.random.default_rng(20240607)
BYTE64 = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1 & (1 << 64) - 1
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SPAN + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a batch in a row, and each text's first offset with the end after them (null: no bytes)."""
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_null()), 0, np.diff(offsets))
        if lengths.sum() != offsets[-1] - offsets[0]:
            return flat_bytes(texts.fill_null(""))
    data = texts.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a batch: runs outside the six ASCII blanks, never across texts."""
    word = np.zeros(len(data) + 1, bool)
    np.logical_not(_BLANK[data], out=word[:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = word[:-1] & (~word[1:] | edge[1:])
    return np.flatnonzero(starts), np.flatnonzero(ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, side="right")))
        a = starts[i]
        power, inverse = powers(int(ends[j - 1] - a))
        v = BYTE64[data[a : ends[j - 1]]]
        v *= power
        total = np.cumsum(v, dtype=np.uint64)
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e - 1] - total[s] + v[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(out)


def batch_words(texts: pa.Array, translate: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of a batch, and the number of words of each text."""
    data, offsets = flat_bytes(texts)
    if translate:
        data = np.frombuffer(data.tobytes().translate(translate), np.uint8)
    starts, ends = word_spans(data, offsets)
    return word_hashes(data, starts, ends), np.diff(np.searchsorted(starts, offsets))


def raw_texts(texts: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each text, None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return iter(texts.cast(kind).to_pylist())

