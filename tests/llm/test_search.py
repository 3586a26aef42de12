import math
from collections import Counter

import numpy as np
import pytest

from corvane.llm import search as S
from corvane.llm.toxicity import _SPLIT


def bm25(rows, queries, k):
    bags = [(i, Counter((t or "").encode().translate(_SPLIT).split())) for i, t, *_ in rows]
    df = Counter(w for _, bag in bags for w in bag)
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    out = {}
    for q, text in queries:
        asked = Counter((text or "").encode().translate(_SPLIT).split())
        found = []
        for i, bag in bags:
            s = sum(n * math.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean)) for w, n in asked.items() if bag[w])
            if s > 0:
                found.append((-round(s, 9), math.inf if i is None else i))
        out[q] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("shard, block, first, dense, terms", [(8192, 8, 8, 512, 1_000_000), (20, 4, 2, 40, 300)])
def test_against_all_scores(docs, rows, no_docs, shard, block, first, dense, terms, monkeypatch):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("FIRST", first), ("DENSE", dense), ("TERMS", terms), ("BATCH", 3), ("POSTINGS", 100 * terms // 30)):
        monkeypatch.setattr(S, name, value)
    got = S.self_search(docs, every=10, k=5).collect()
    queries = {i: t for i, t, *_ in rows if i is not None and i % 10 == 0}
    expected = {q: v for q, v in bm25(rows, list(queries.items()), 5).items() if v}
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append((-r.score, math.inf if r.doc_id is None else r.doc_id))
    assert set(mine) == set(expected)
    for q in mine:
        assert [d for _, d in sorted((round(s, 9), d) for s, d in mine[q])] == [d for _, d in expected[q]]
        assert all(abs(a - b) < 1e-6 for (a, _), (b, _) in zip(mine[q], expected[q]))
    assert S.self_search(no_docs).collect() == []


def test_documents_under_the_floor_are_skipped():
    """Blocks whose bound misses the threshold are never scored; what is returned is what a full scoring returns."""
    rng = np.random.default_rng(3)
    vocabulary = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    bags = [Counter((rng.zipf(1.4, 40).clip(1, 150) - 1 + 150 * (d >= 100)).tolist()) for d in range(200)]
    postings = sorted((t, d, n) for d, bag in enumerate(bags) for t, n in bag.items())
    code, places, counts = (np.array(x) for x in zip(*postings))
    lengths = np.array([sum(b.values()) for b in bags])
    used = np.unique(code)
    cuts = np.searchsorted(code, np.append(used, 300))
    shard = S.Shard(lengths, vocabulary[used], cuts, places, counts, 40.0)
    asked = rng.choice(used[used < 150], 30, replace=False)
    weights = rng.random(30) * 5
    score = np.array([sum(w * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * n / 40)) for t, w in zip(asked, weights) if b[t]) for b, n in zip(bags, lengths)])
    floor = np.sort(score)[-5]
    order = np.argsort(vocabulary[asked])
    looked = []
    shard.dense = type("Spy", (np.ndarray,), {"__getitem__": lambda self, at: looked.append(len(at)) or np.asarray(self)[at]})(shard.dense.shape, buffer=shard.dense)
    _, place, total = shard.search(np.zeros(30, np.int64), vocabulary[asked][order], weights[order], np.array([floor]), 10)
    assert sorted(place.tolist()) == sorted(np.flatnonzero(score >= floor - 1e-9).tolist()) and np.allclose(total, score[place])
    assert looked[0] <= 104


def test_queries_that_share_an_id(spark):
    rows = [(100, "red apple pie"), (100, "blue sea"), (1, "apple pie"), (2, "the sea is blue"), (100, "red apple pie")]
    got = S.self_search(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == [(100, 1, 100), (100, 1, 100), (100, 2, 2), (100, 2, 100)]
