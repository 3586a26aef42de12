"""Host-level quality rules: failures of per-document rules by host, rates shrunk by an empirical beta prior.

A host is the ``source`` of a document. Each rule's failures are counted by host (pre-aggregated before the
shuffle); a beta prior is fitted to the hosts' raw rates by moments, and a host is rejected when its shrunk rate
under some rule exceeds that rule's limit. Verdicts are joined back to the documents, those of a large host, or
without one, dealt over many tasks.

Edge cases: a null, empty or wordless text has no words and fails the base rule; documents without a host get no
host verdict; repeated rows count one by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm import common as C
from corvane.operators.skew import spread_join

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
_POINT = np.array([(b & 0xC0) != 0x80 and b not in (9, 10, 11, 12, 13, 32) for b in range(256)], np.int32)
_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)], np.int32)
#: rule name: (failing predicate, the shrunk rate beyond which a host is rejected)
RULES = {
    "base": ("base_failed", 0.6),
    "symbols": ("10 * n_symbols > word_chars", 0.6),
    "lines": ("n_dup_lines > 0 and 2 * n_dup_lines > n_lines", 0.6),
}


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text of a batch."""
    data, offsets = C.flat_bytes(texts)
    starts, ends = C.word_spans(data, offsets)
    h = C.word_hashes(data, starts, ends)
    counts = np.diff(np.searchsorted(starts, offsets))
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    repeated = np.zeros(len(counts), np.int64)
    if len(h) >= WINDOW:
        chain = h + doc * np.uint64(0xD6E8FEB86659FD93)
        for k in range(1, WINDOW):
            chain = C.mix64(chain[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
        whole = doc[: len(chain)] == doc[WINDOW - 1 :]
        order = np.sort(chain[whole])
        twice = C.sorted_unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            hit = np.flatnonzero(whole & (twice[np.minimum(np.searchsorted(twice, chain), len(twice) - 1)] == chain))
            edge = np.zeros(len(h) + WINDOW + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
            repeated = np.bincount(doc[np.cumsum(edge)[: len(h)] > 0].astype(np.int64), minlength=len(counts))
    lines, again = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    for i, raw in enumerate(C.raw_texts(texts)):
        if raw:
            full = [x for x in raw.split(b"\n") if x.strip()]
            lines[i], again[i] = len(full), len(full) - len(set(full))
    return {"n_words": counts, "word_chars": _sums(_POINT[data], offsets), "n_symbols": _sums(_SYMBOL[data], offsets), "n_dup_lines": again, "n_repeat_words": repeated, "n_lines": lines}


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = measure(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(found[c].astype(np.int64)) for c in _COUNTS)], ["doc_id", "host", *_COUNTS])


def host_verdicts(measured: DataFrame) -> DataFrame:
    """``host, n, <rule>_rate..., host_rejected``: one row per host, and one, never rejected, for documents without."""
    hosts = C.settle(
        measured.groupBy("host").agg(F.count("*").cast("double").alias("n"), *(F.sum(F.expr(f"case when {test} then 1.0D else 0.0D end")).alias(f"{rule}_fails") for rule, (test, _) in RULES.items())),
        "hosts",
    )
    moments = hosts.where("host is not null").agg(*(f(F.col(f"{rule}_fails") / F.col("n")).alias(f"{rule}_{name}") for rule in RULES for name, f in (("mean", F.avg), ("var", F.var_pop)))).first()
    out, bad = hosts, F.lit(False)
    for rule, (_, limit) in RULES.items():
        mean, var = moments[f"{rule}_mean"] or 0.0, moments[f"{rule}_var"] or 0.0
        # moments of a beta distribution; without spread between hosts the prior is strong
        strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var > 0 and 0 < mean < 1 else 100.0
        rate = (F.col(f"{rule}_fails") + mean * strength) / (F.col("n") + strength)
        out = out.withColumn(f"{rule}_rate", rate)
        bad = bad | (F.col(f"{rule}_rate") > limit)
    return out.withColumn("host_rejected", bad & F.col("host").isNotNull())


def judge(documents: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept``, ``n_lines`` and ``host_rejected`` for every document."""
    C.small_batches(documents.sparkSession)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = C.settle(own.mapInArrow(measure_batches, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS)).withColumns({"base_failed": failed, "row": F.monotonically_increasing_id()}), "measured")
    verdicts = host_verdicts(measured)
    sizes = verdicts.select("host", F.col("n").cast("long").alias("n"))
    out = spread_join(measured, verdicts.select("host", "host_rejected"), ["host"], sizes, F.col("row"), "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.select("doc_id", *_COUNTS[:5], "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "n_lines", "host_rejected")
