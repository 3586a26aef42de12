import hashlib
import random
from collections import Counter

import pytest

from corvane.llm import suffix_dedup as S


def brute(rows, length):
    where = Counter()
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, raw in raws:
        where.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    out = Counter()
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if where[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length, span", [(200, 4000), (30, 1 << 20)])
def test_against_every_window(docs, rows, no_docs, length, span, monkeypatch):
    got = S.drop_repeats(docs, length)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, length)
    assert S.drop_repeats(no_docs, length).collect() == []


def test_repeats_inside_one_text(spark):
    rows = [(1, "abcdefghij" * 60), (2, "q" * 500), (3, "unlike " * 5), (4, "ab" * 99 + "x" + "ab" * 100 + "y" + "ab" * 101)]
    got = S.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 200)


def test_passages_of_every_length_around_the_window(spark):
    """Passages just under, at and over the window's length, with other text on one side, both sides or none."""
    rng = random.Random(7)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    rows, passages = [], [word(n) for n in (199, 200, 201, 233, 300, 470, 900)]
    for k, p in enumerate(passages):
        for j in range(4):
            rows.append((10 * k + j, word(rng.randint(0, 90)) * (j != 1) + p + word(rng.randint(0, 90)) * (j != 2)))
    # windows of one passage under two neighbours, which share each half with others
    rows += [(1000 + i, a + passages[5] + b) for i, (a, b) in enumerate([(x, y) for x in (word(50), word(120)) for y in (word(40), word(130))])]
    got = S.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 200)
    assert sum(r.n_removed > 0 for r in got) == 28


def test_long_texts_are_cut_for_hashing_only(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 9000, dtype=np.uint8)
    monkeypatch.setattr(S, "SPAN", 1024)
    offsets = np.array([0, 5000, 5000, 9000])
    doc, first, _, more, *_ = S.runs(data, offsets, 200, 128)
    seen = sorted({(d, k) for d, a, n in zip(doc, first, more) for k in range(a, a + n + 1)})
    assert seen == [(0, k) for k in range(4801)] + [(2, k) for k in range(3801)]


def test_pieces_of_a_long_document_share_no_window(monkeypatch):
    monkeypatch.setattr(S, "SPAN", 1024)
    for size in (1025, 1848, 1849, 1850, 5000):
        pieces = list(S.spans_of(S.np.array([0, size]), 200))
        starts = [w for _, _, a, b in pieces for w in range(a, b - 200 + 1)]
        assert starts == list(range(size - 200 + 1)), size
