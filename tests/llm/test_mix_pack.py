import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from corvane.llm import mixing, packing


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, rest = 1.5 * sum(sizes.values()), {}, set(names)
    while rest:
        level = left / sum(weight[s] for s in rest)
        full = [s for s in rest if weight[s] * level > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            rest.remove(s)
    return out | {s: weight[s] * level for s in rest}


def test_mix(docs, rows, no_docs):
    got = mixing.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += count(t)
    goal = targets(sizes)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, count(t)) for i, t, *_ in rows)
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by_size.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by_size.items():
        match = [s for s in goal if sizes[s] == size and abs(goal[s] - target) < 1e-6]
        assert match and sum(taken) == len(match) * int(target + 1e-9)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed) and 0 <= placed[0] and placed[-1] <= 1
    assert mixing.mix(no_docs).collect() == []


def test_mixed_documents(docs, rows, no_docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(t)
    have = out.collect()
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    assert sum(count(r.text) for r in have) == taken
    assert all(any(t is None and r.text is None or t is not None and r.text is not None and t.startswith(r.text) for t in texts[r.doc_id]) for r in have)
    assert sum(count(t) == 0 for _, t, *_ in rows) == sum(count(r.text) == 0 for r in have)
    assert mixing.mixed_documents(no_docs).collect() == []


def test_pack(docs, rows, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, capacity=256).collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 256):
            expected[i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in got) // 256) + 2
    assert packing.pack(no_docs).collect() == []


def test_copies_of_a_row_are_ranked_in_many_slices(spark, monkeypatch):
    for name, value in (("SLICES", 2), ("RANKED", 100)):
        monkeypatch.setattr(packing, name, value)
    rows = [(None, "the same words")] * 700 + [(i, "other words of another length " * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df, capacity=64).collect()
    assert len(got) == 1000
    assert [(r.doc_id, r.length, r.ids_crc32) for r in sorted(got, key=str) if r.doc_id is not None] == [(r.doc_id, r.length, r.ids_crc32) for r in sorted(packing.pack(df, capacity=64).collect(), key=str) if r.doc_id is not None]
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 64


def test_ids_of_unusual_texts():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer, known = Tokenizer.from_file(path), packing.WordIds(path)
    for text in ["It's don't we'll 've A'S", "a<|endoftext|>b <|ENDOFTEXT|>", "Ünïİ́codé ×÷ ²½", "é café x y", "###''s!!..", "x\x1cy z\x85w", "日本語 テスト 123", "", "  ", "ʼn ǅ ß ẞ"]:
        keys = known.split(text)
        known.learn(set(keys))
        assert b"".join(known[k] for k in keys) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_ids_of_every_plain_character():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer, known = Tokenizer.from_file(path), packing.WordIds(path)
    assert known.by_word
    tried = [c for c in map(chr, range(0x250)) if packing.PLAIN.fullmatch(c)]
    assert len(tried) > 350 and not packing.PLAIN.fullmatch("\u0181") and not packing.PLAIN.fullmatch("\u023a")
    for c in map(chr, [*range(1, 0x250), 0x1E9E, 0x2126, 0x212A, 0x1F600]):
        for text in (f"Ab{c}Cd", f"x {c}{c} 1{c}'S", f"{c}"):
            keys = known.split(text)
            known.learn(set(keys))
            assert b"".join(known[k] for k in keys) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), (hex(ord(c)), text)


def test_a_tokenizer_with_other_rules_is_asked_itself(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    tokenizer, known = Tokenizer.from_file(path), packing.WordIds(path)
    assert not known.by_word
    texts = ["Two  Words\n and\tmore", " x", "", "Ünïcode's 12 "]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_fullest_is_the_best_sum():
    rng = np.random.default_rng(4)
    for _ in range(60):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 30, 4)}
        items = [length for length, n in counts.items() for _ in range(n)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= 40}
        chosen = packing.fullest(counts, 40)
        assert sum(a * n for a, n in chosen) == max(sums) and all(n <= counts[a] for a, n in chosen)
    assert packing.plan({}, 10) == []


def test_a_long_text_at_the_border_is_cut_behind_its_last_taken_word(spark):
    rows = [(1, "  " + "ab \n c\t" * 40_000, "a"), (2, "x y z", "b"), (3, "u v", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert 80_000 < taken[1] < 160_000
    parts = sorted((r.text for r in mixing.mixed_documents(docs).collect() if r.doc_id == 1), key=len)
    assert [len(p.split()) for p in parts] == [taken[1] - 80_000, 80_000]
    assert all(rows[0][1].startswith(p) for p in parts) and not parts[0][-1].isspace()


def test_rows_of_any_name_and_many_copies(spark):
    """Copies take words one by one, rows that differ only in other columns are told apart, and reruns agree."""
    rows = [(1, "a b c d", "s", None, "x")] * 3000 + [(1, "a b c d", "s", "y", None)] * 3 + [(1, "a b c d", "t", None, "x")] * 5 + [(-1, "a b", "t", "p", "q"), (None, "a b", "t", "p", "q"), (2, "", "s", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` string, size string").repartition(5)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    have = Counter(tuple(r) for r in out.collect())
    assert have == Counter(tuple(r) for r in mixing.mixed_documents(docs.repartition(2)).collect())
    assert set(have) <= {(i, t[:k], *r) for i, t, *r in rows for k in (0, 1, 3, 5, 7)} and have[rows[-1]] == 1
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    assert sum(len(k[1].split()) * n for k, n in have.items()) == taken == sum(int(t + 1e-9) for t in targets({"s": 12012, "t": 24}).values())
    assert sum(n for k, n in have.items() if k[3] == "y") >= 3


def test_second_uses_come_after_the_whole_source(spark):
    # source c is taken twice, b and a in part
    rows = [(i, "w " * 10, "c") for i in range(40)] + [(100 + i, "v " * 10, "a") for i in range(60)] + [(200 + i, "u " * 10, "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.doc_id: r for r in mixing.assign(docs).collect()}
    order = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    for source in "abc":
        own = [i for i, _, s in rows if s == source]
        target, lean = plan[own[0]].target, (int(hashlib.sha256(source.encode()).hexdigest()[:12], 16) % 7 - 3) / 4
        first = sorted((i for i in own if plan[i].taken), key=lambda i: plan[i].position)
        second = sorted((i for i in own if plan[i].taken > 10), key=lambda i: plan[i].again)
        assert [i for i in order if i in own] == first + second and second == first[: len(second)]
        for k, i in enumerate(first + second):
            t = plan[i].position if k < len(first) else plan[i].again
            # the integral of the schedule up to the position is the share of the target before this use
            assert abs((1 + lean) * t - lean * t * t - 10 * k / target) < 1e-9
    twice = [i for i, r in plan.items() if r.taken > 10]
    assert len(twice) > 30 and all(order.index(i) + 1 < len(order) - order[::-1].index(i) - 1 for i in twice)
