"""Exact top-k BM25 search: an inverted index per shard, block-max WAND pruning, and an exact merge.

*Index.* Runs of ``SHARD`` documents, fewer if they have over ``POSTINGS`` postings, become one row each: the documents' ids and lengths, and for each term its postings
(places and counts). It is written once to the shared folder, with the corpus's document frequencies beside it; queries
read only these tables, whatever their number. Terms are told apart by 64-bit hashes.

*Search.* A shard's most frequent terms keep their scores in dense rows with the maximum of each block of ``BLOCK``
documents. WAND splits a query's lists at the pivot beyond which they can lift a document above the threshold: here the
rare lists are walked in full and the dense ones only bounded. A document whose rare score, plus the block maxima of its
block, stays under the query's threshold is skipped, with its block if all are; the others are scored in full.
Thresholds start at the k-th score of a first pass over one shard in ``FIRST`` and rise from shard to shard within a
task, which keeps one top k per query for all its shards. Tasks are as many as the session runs at a time, so what they
return grows with the queries alone.

Scores use the document count, mean length and document frequencies of the whole corpus, so the merge is exact.
Queries come in blocks of so many terms, which bounds what is sent to a task by its size; all of a block's documents
are looked at in batches of ``BATCH`` queries.

Edge cases: a null or empty text has no terms and is never found, nor finds anything; ties (scores equal to nine
decimals) go to the smaller ``doc_id`` (null last); rows that share a ``doc_id`` are documents of their own, and as
queries share an id but not their results' ranks; a null query id asks nothing; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corvane.llm import common as C
from corvane.llm.toxicity import _SPLIT
from corvane.operators.order import running
from corvane.operators.skew import spread_join

K1, B, TOP = 1.2, 0.75, 10
#: Documents of a shard, of a block, queries of a batch, dense lists of a shard, and the share of shards searched first.
SHARD, BLOCK, BATCH, DENSE, FIRST = 4_096, 8, 64, 512, 8
#: Terms of a block of queries, 24 bytes each when sent.
TERMS = 1_000_000
#: Postings of a shard, but for those of a part of one Arrow batch.
POSTINGS = 4_000_000
_LAST = np.iinfo(np.int64).max


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each distinct term of each text, by row, and the texts' lengths in terms."""
    h, counts = C.batch_words(texts, _SPLIT)
    rows, terms, tf = [], [], []
    for i, (n, end) in enumerate(zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True)):
        if n:
            own = np.sort(h[end - n : end])
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            rows.append(np.full(len(head), i))
            terms.append(own[head])
            tf.append(np.diff(np.append(head, n)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    return np.concatenate(rows), np.concatenate(terms), np.concatenate(tf), counts


INDEX = "shard long, words long, doc_ids binary, lengths binary, terms binary, cuts binary, places binary, counts binary"


def index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` to one row per shard; a null id becomes the largest number."""
    parts: list[tuple[np.ndarray, ...]] = []
    size = held = 0

    def flush() -> pa.RecordBatch:
        ids, rows, terms, tf, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        known, code = np.unique(terms, return_inverse=True)
        by = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[by], np.arange(len(known) + 1))
        # documents of like length and language stand together, so that blocks have tight maxima
        first = np.full(len(ids), len(known))
        np.minimum.at(first, rows, np.argsort(np.argsort(-np.diff(cuts), kind="stable"), kind="stable")[code])
        order = np.lexsort((lengths, first))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        wide = "<u2" if not len(tf) or tf.max() < 1 << 16 else "<u4"
        kinds = (ids[order], lengths[order].astype("<i8"), known, cuts.astype("<i8"), rank[rows][by].astype("<u2"), tf[by].astype(wide))
        return pa.RecordBatch.from_arrays([pa.array([int(C.mix64(known[:1] ^ np.uint64(len(terms)))[0] >> np.uint64(1)) if len(known) else 0]), pa.array([int(lengths.sum())]), *(pa.array([x.tobytes()], pa.binary()) for x in kinds)], [f.split()[0] for f in INDEX.split(", ")])

    for batch in batches:
        rows, terms, tf, lengths = distinct_terms(batch.column("text"))
        ids = np.array([_LAST if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
        for a in range(0, len(ids), SHARD):
            i, j = np.searchsorted(rows, (a, a + SHARD))
            part = ids[a : a + SHARD]
            if size and (size + len(part) > SHARD or held + j - i > POSTINGS):
                yield flush()
                parts, size, held = [], 0, 0
            parts.append((part, rows[i:j] - a + size, terms[i:j], tf[i:j], lengths[a : a + SHARD]))
            size += len(part)
            held += j - i
    if size:
        yield flush()


def _array(column: pa.Array, i: int, kind: str) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


def frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index to ``term, n``: documents of the shard that hold the term."""
    for batch in batches:
        for i in range(batch.num_rows):
            terms, cuts = _array(batch.column("terms"), i, "<i8"), _array(batch.column("cuts"), i, "<i8")
            for a in range(0, len(terms), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(terms[a : a + 50_000]), pa.array(np.diff(cuts[a : a + 50_001]))], ["term", "n"])


def query_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, terms, tf, _ = distinct_terms(batch.column("text"))
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("row").take(at), pa.array(terms.view(np.int64)), pa.array(tf)], ["query_id", "row", "term", "n"])


class Shard:
    """The index of some documents, ready to be searched."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, cuts: np.ndarray, places: np.ndarray, counts: np.ndarray, mean: float) -> None:
        self.size, self.terms, self.cuts, self.places = len(lengths), terms, cuts, places.astype(np.int64)
        self.impact = counts * (K1 + 1) / (counts + (K1 * (1 - B) + K1 * B / mean * lengths)[self.places])
        self.blocks = -(-self.size // BLOCK)
        df = np.diff(cuts)
        heavy = np.sort(np.argsort(-df, kind="stable")[:DENSE])
        self.column = np.full(len(terms), -1)
        self.column[heavy] = np.arange(len(heavy))
        self.dense = np.zeros((self.blocks * BLOCK, len(heavy)))
        for c, t in enumerate(heavy.tolist()):
            self.dense[self.places[cuts[t] : cuts[t + 1]], c] = self.impact[cuts[t] : cuts[t + 1]]
        self.most = self.dense.reshape(self.blocks, BLOCK, len(heavy)).max(1)

    def search(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the best ``k`` documents, and ties, that reach their query's floor; ``query`` counts from 0."""
        n = len(floors)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[at] == terms
        query, at, weights = query[hit], at[hit], weights[hit]
        column = self.column[at]
        rare = column < 0
        asked = np.zeros((n, self.dense.shape[1]))
        asked[query[~rare], column[~rare]] = weights[~rare]
        start, count = self.cuts[at[rare]], self.cuts[at[rare] + 1] - self.cuts[at[rare]]
        post = _ranges(start, count)
        width = self.blocks * BLOCK
        key = np.repeat(query[rare] * width, count) + self.places[post]
        score = np.bincount(key, weights=np.repeat(weights[rare], count) * self.impact[post], minlength=n * width).reshape(n, self.blocks, BLOCK)
        bound = asked @ self.most.T
        least = _margin(floors)[:, None] - bound - 1e-9
        # whole blocks first, then the documents of those that are left
        open_blocks = np.flatnonzero((score.max(2) >= least).any(0))
        some = score[:, open_blocks]
        used = np.flatnonzero((some >= least[:, open_blocks, None]).any(0).reshape(-1))
        place = (open_blocks[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)[used]
        total = some.reshape(n, -1)[:, used] + asked @ self.dense[place].T
        cut = floors
        if len(place) > k:
            cut = np.maximum(floors, np.partition(total, len(place) - k, axis=1)[:, len(place) - k])
        q, d = np.nonzero(total >= _margin(cut)[:, None])
        return q, place[d], total[q, d]


def _margin(floors: np.ndarray) -> np.ndarray:
    """Thresholds, lowered by more than what rounding may have added."""
    return np.maximum(floors * (1 - 1e-9) - 2e-9, 1e-12)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of ``start[i], ..., start[i] + count[i] - 1``, in a row."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def best_of(query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each query, by query, falling score and key."""
    order = np.lexsort((key, -score, query))
    query, score, key = query[order], score[order], key[order]
    head = np.searchsorted(query, query)
    keep = np.arange(len(query)) - head < k
    return query[keep], score[keep], key[keep]


FOUND = "query_id long, row long, doc_id long, score double"


def search_batches(shared, k: int):
    """Shards of the index to the best ``k`` of each query over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, cuts, terms, weights, floors, mean = shared.value
        floors = floors.copy()
        starts = range(0, len(ids), BATCH)
        nothing = np.zeros(0, np.int64)
        best = {a: (nothing, np.zeros(0), nothing) for a in starts}
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, known, at = (_array(batch.column(c), i, t) for c, t in (("doc_ids", "<i8"), ("lengths", "<i8"), ("terms", "<u8"), ("cuts", "<i8")))
                if not len(known):
                    continue
                places, raw = _array(batch.column("places"), i, "<u2"), batch.column("counts")[i].as_buffer()
                shard = Shard(lengths, known, at, places, np.frombuffer(raw, "<u2" if raw.size == 2 * len(places) else "<u4"), mean)
                for a in starts:
                    b = min(a + BATCH, len(ids))
                    own = slice(cuts[a], cuts[b])
                    query, place, score = shard.search(np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1])), terms[own], weights[own], floors[a:b], k)
                    if len(query):
                        old = best[a]
                        best[a] = best_of(np.append(old[0], query), np.append(old[1], np.round(score, 9)), np.append(old[2], doc_ids[place]), k)
                        full = np.flatnonzero(np.bincount(best[a][0], minlength=b - a) == k)
                        last = np.searchsorted(best[a][0], full, side="right") - 1
                        floors[a + full] = np.maximum(floors[a + full], best[a][1][last])
        for a, (query, score, key) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids[a + query]), pa.array(rows[a + query]), pa.array(key, mask=key == _LAST), pa.array(score)], [f.split()[0] for f in FOUND.split(", ")])

    return run


def build_index(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The shards to be searched first, the other shards, and ``term, df``; written out."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = C.settle(own.mapInArrow(C.tidy(index_batches), INDEX), "index")
    first, rest = (C.settle(index.where(test), "shards") for test in (f"shard % {FIRST} = 0", f"shard % {FIRST} <> 0"))
    C.forget(index)
    frequency = first.unionByName(rest).select("terms", "cuts").mapInArrow(C.tidy(frequency_batches), "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return first, rest, C.settle(frequency, "frequencies")


def weigh(queries: DataFrame, frequencies: DataFrame, documents: int) -> tuple[DataFrame, int]:
    """``block, query_id, row, term, weight`` by block, and the number of blocks; queries equal in id and text count once."""
    own = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("row", F.xxhash64("query_id", "text")).dropDuplicates(["query_id", "row"])
    asked = C.settle(own.mapInArrow(C.tidy(query_batches), "query_id long, row long, term long, n long"), "asked")
    sizes = C.settle(asked.groupBy("term").agg(F.count("*").alias("n")), "sizes")
    idf = F.log1p((documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = spread_join(asked, frequencies, ["term"], sizes, F.col("row")).select("query_id", "row", "term", (F.col("n") * idf).alias("weight"))
    place = running(asked.groupBy("query_id", "row").agg(F.count("*").alias("terms")), [], ["query_id", "row"], {"before": "terms"}, label="queries")
    blocks = place.select("query_id", "row", F.floor(F.col("before") / TERMS).cast("long").alias("block"))
    order = ["block", "query_id", "row", "term"]
    weighed = C.settle(known.join(blocks, ["query_id", "row"]).repartitionByRange(*order).sortWithinPartitions(*order), "weighed")
    C.forget(asked, sizes)
    return weighed, (weighed.agg(F.max("block").alias("b")).first().b or 0) + 1


def search(documents: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id, rank, doc_id, score``: the k best rows of ``documents`` for each row of ``queries`` (``query_id, text``)."""
    spark = documents.sparkSession
    C.small_batches(spark)
    first, rest, frequencies = build_index(documents)
    size = first.unionByName(rest).agg(F.coalesce(F.sum(F.octet_length("doc_ids") / 8), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    weighed, blocks = weigh(queries, frequencies, size.n)
    C.forget(frequencies)
    tasks = spark.sparkContext.defaultParallelism
    merged: list[DataFrame] = []
    for b in range(blocks):
        table = weighed.where(F.col("block") == b).toArrow().sort_by([(c, "ascending") for c in ("query_id", "row", "term")])
        ids, rows, terms, weights = (table.column(c).to_numpy() for c in ("query_id", "row", "term", "weight"))
        head = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])))) if len(ids) else np.zeros(0, np.int64)
        asked = (ids[head], rows[head], np.append(head, len(ids)), terms.view(np.uint64), weights)
        mean = max(size.words / max(size.n, 1), 1e-9)
        top = []
        floors = np.zeros(len(head))
        for shards in (first, rest):
            model = spark.sparkContext.broadcast((*asked, floors, mean))
            found = C.settle(shards.coalesce(tasks).mapInArrow(C.tidy(search_batches(model, k)), FOUND), "found")
            model.destroy()
            top.append(found)
            if shards is first:
                # the k-th score so far of each query of the block
                ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score")))).where(F.col("rank") == k).select("query_id", "row", "score").toArrow()
                at = {key: i for i, key in enumerate(zip(asked[0].tolist(), asked[1].tolist(), strict=True))}
                for q, r, s in zip(*(ranked.column(c).to_pylist() for c in ("query_id", "row", "score")), strict=True):
                    floors[at[q, r]] = s
        best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = top[0].unionByName(top[1]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        merged.append(C.settle(ranked.select("query_id", "rank", "doc_id", "score"), "top"))
        C.forget(*top)
    C.forget(first, rest, weighed)
    out = merged[0]
    for part in merged[1:]:
        out = out.unionByName(part)
    return out


def self_search(documents: DataFrame, every: int = 100, k: int = TOP) -> DataFrame:
    """Rows whose id is divisible by ``every``, as queries against all rows."""
    queries = documents.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(documents, queries, k)
