from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from corvane.llm import near_dedup as N
from corvane.operators.components import components


def sets(rows, words):
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())))
    return out


def brute(rows, words, percent=80):
    found = sets(rows, words)
    near = defaultdict(set)
    for (a, x), (b, y) in combinations([r for r in found if r[0] is not None and r[1]], 2):
        if 100 * len(x & y) >= percent * len(x | y):
            near[a].add(b)
            near[b].add(a)
    out = Counter()
    for i, s in found:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        root = min(seen) if i is not None else None
        out[i, len(s), root, i is None or i == root] += 1
    return out


def families(seed=1, n=40):
    """Chains of edits, and a passage that many otherwise different texts share."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    rows, passage = [], word(60)
    for i in range(n):
        rows.append((1000 + i, " ".join(passage + word(int(rng.integers(4, 30))))))
    base = word(120)
    for i in range(n):
        base[int(rng.integers(len(base)))] = f"e{i}"
        rows.append((2000 + i, " ".join(base)))
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_documents(docs, rows, no_docs, words):
    got = N.near_duplicates(docs, words)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, words)
    assert N.near_duplicates(no_docs, words).collect() == []


def test_chains_and_shared_passages(spark):
    rows = families()
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 2)


def test_rows_repeated_with_their_ids(spark, monkeypatch):
    """Hundreds of equal rows of near copies: one node each, all rows returned; hot sets and empty ones are dealt."""
    from corvane.operators import skew

    monkeypatch.setattr(skew, "FEW", 20)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in (3, 30, 50)] + [" ".join(words)]
    rows = [(10 + i, t) for i, t in enumerate(texts) for _ in range(150)] + [(5, texts[0]), (6, "of its own"), (6, "by another text")] + [(900 + i, "") for i in range(100)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 2)


def test_keep_one(docs, rows, no_docs):
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    expected = {i for (i, _, _, k) in brute(rows, 5) if k and i is not None}
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(ids) - {None} == expected and max(n for i, n in ids.items() if i is not None) == 1
    assert ids[None] == 2
    assert N.keep_one(no_docs).collect() == []


def test_keep_one_judges_rows_not_ids(spark):
    """Rows of other texts that share an id, and rows without one, are judged by their texts; columns stay as they are."""
    a, b, c = "a b c d e f g", "v w x y z q r", "k l m n o p q"
    rows = [(1, a, "m"), (1, b, "n"), (2, a, "o"), (None, c, "p"), (None, c, "q"), (3, c, "r"), (3, c, "r"), (4, "", "s"), (4, "", "s"), (None, None, None)]
    got = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string, `row` string").withColumnRenamed("row", "Row"))
    assert got.columns == ["doc_id", "text", "Row"]
    assert Counter(tuple(r) for r in got.collect()) == Counter([rows[0], rows[1], rows[6], rows[7], rows[8], rows[9]])
    odd = spark.createDataFrame([(1, a, 1), (2, a, 2), (3, b, 3)], "doc_id long, text string, `a.b` long")
    assert {tuple(r) for r in N.keep_one(odd).collect()} == {(1, a, 1), (3, b, 3)}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    b = np.concatenate((a[:250], rng.integers(0, 1 << 63, 50).astype(np.uint64)))
    table = N.sketches(np.concatenate((a, b, a[:1])), np.array([300, 300, 1, 0]), 512)
    assert (table[:3] != N._FULL).all() and (table[3] == N._FULL).all()
    assert abs((table[0] == table[1]).mean() - 250 / 350) < 0.08


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 8), (6, 6), (None, 3)] + [(100, k) for k in range(101, 160)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, **{k: 100 for k in range(100, 160)}}
