import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import checks, dedup, filters, quota, sampling, scoring, splits
from corvane.plans import corpus, instructions
from corvane.sources import sinks

INDEX = "seq long, source string, split string, fingerprint string, n_tokens long"


def sequential(rows, sources, budgets):
    """The reading loop as such: one document after the other, each source until its quotas are full."""
    seen, out = set(), []
    for name in sources:
        left = dict(budgets)
        for seq, source, split, fp, n in sorted(rows):
            if source != name or not any(left.values()):
                continue
            if fp in seen:
                continue
            seen.add(fp)
            if left[split]:
                take = min(n, left[split])
                left[split] -= take
                out.append((name, seq, split, take, n, take < n))
    return sorted(out)


def make(seed):
    rng = random.Random(seed)
    return [(i, rng.choice("ab"), rng.choice(["train", "train", "val", "holdout"]), f"f{rng.randrange(150)}", rng.randint(1, 9)) for i in range(240)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fill_equals_the_reading_loop(spark, seed):
    rows, budgets = make(seed), {"train": 60, "val": 20, "holdout": 15}
    df = spark.createDataFrame(rows, INDEX.replace("seq long, source string, split string, fingerprint string", "seq long, source string, split string, fingerprint string")).repartition(5)
    got = quota.fill_sources(df, ["a", "b"], budgets)
    assert sorted((r.source, r.seq, r.split, r.tokens, r.original_tokens, r.truncated) for r in got.collect()) == sequential(rows, ["a", "b"], budgets)
    with pytest.raises(quota.BudgetError):
        quota.fill_sources(df, ["a", "b"], {"train": 10_000, "val": 20, "holdout": 15})


def documents(spark, n=400):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(60)) for _ in range(40)), "en", f"src{i % 4}") for i in range(n)]
    rows += [(n, "  ".join(rows[0][1].split(" ")), "en", "src0"), (n + 1, "short", "en", "src1"), (n + 2, None, "en", "src1"), (n + 3, "1 2 3 " * 60, "en", "src2")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_prepare_writes_once_and_checks_out(spark, tmp_path):
    folder, budgets = str(tmp_path / "corpus"), {"train": 3_000, "val": 60, "holdout": 60}
    index = corpus.prepare(documents(spark), folder, budgets)
    manifest = json.loads((tmp_path / "corpus" / "manifest.json").read_text())
    assert manifest["status"] == "complete" and manifest["version"] == 1
    totals = spark.createDataFrame(list(budgets.items()), "split string, tokens long")
    assert checks.index_faults(index, totals).isEmpty()
    assert not checks.index_faults(index.where("start_token <> 0"), totals).isEmpty()
    assert splits.leaks(index, "fingerprint").isEmpty()
    small = quota.subset(index, 1_000)
    assert {r.split: r.n for r in small.groupBy("split").agg(F.sum("tokens").alias("n")).collect()} == {"train": 1_000, "val": 60, "holdout": 60}
    assert checks.reserved_faults(index, small.select(*index.columns)).isEmpty()
    assert not checks.reserved_faults(index, index.where("split <> 'val'")).isEmpty()
    with pytest.raises(FileExistsError):
        corpus.prepare(documents(spark), folder, budgets)
    # the same rows in other partitions give the same index
    again = corpus.single_stream(documents(spark).repartition(7), budgets)
    same = ["seq", "fingerprint", "split", "start_token", "tokens"]
    first = corpus.single_stream(documents(spark), budgets)
    assert first.select(*same).exceptAll(again.select(*same)).isEmpty()


def test_failure_leaves_an_incomplete_manifest(spark, tmp_path):
    folder = str(tmp_path / "broken")
    with pytest.raises(quota.BudgetError):
        corpus.prepare(documents(spark), folder, {"train": 10**9})
    assert json.loads((tmp_path / "broken" / "manifest.json").read_text())["status"] == "incomplete"


def test_code_rules_change_one_field_each(spark):
    good = {"content": "def f(x):\n    return x + 1\n" * 6, "repo_name": "Ann/One", "path": "a/b.py", "license": "mit", "autogenerated": False, "locator": "s:1", "seq": 1}
    bad = [{"content": "def f(:\n" * 20}, {"license": "gpl"}, {"autogenerated": True}, {"autogenerated": None}, {"repo_name": " "}, {"path": "a/b.txt"}, {"content": "x = 1"}]
    marker = {"content": "open('/tmp/corvane-executed', 'w')\n" * 5, "seq": 99}
    rows = [good, *({**good, **b, "seq": i + 2} for i, b in enumerate(bad)), {**good, **marker}]
    df = spark.createDataFrame([tuple(r[k] for k in good) for r in rows], "content string, repo_name string, path string, license string, autogenerated boolean, locator string, seq long")
    assert sorted(r.seq for r in filters.code_eligible(df).collect()) == [1, 99]
    import os

    assert not os.path.exists("/tmp/corvane-executed")
    names = spark.createDataFrame([("Ann/One",), ("ann/ONE",)], "n string").select(splits.repository_split(F.col("n")).alias("s"))
    assert len({r.s for r in names.collect()}) == 1
    prior = df.where("seq = 1").select(X.fingerprint(F.col("content")).alias("fingerprint"))
    made = corpus.prepare_code(df, prior, {"train": 10**6, "val": 10**6, "holdout": 10**6})
    assert [r.seq for r in made.collect()] == [99]


def test_text_functions_match_python(spark):
    import re
    import unicodedata

    texts = ["Straße  ÄÖ x y\n", "ﬁne ² Å", "İstanbul ǅ", "a_b ½ ٣ 日本", "", " \t ", "K ſ ẞ", "x\x1cy\x85z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.normal(F.col("t")).alias("n"), X.prompt_normal(F.col("t")).alias("p"), X.n_letters(F.col("t")).alias("a"), X.fingerprint(F.col("t")).alias("f")).collect()
    for r in got:
        assert r.n == " ".join(unicodedata.normalize("NFKC", r.t).split())
        assert r.p == " ".join(unicodedata.normalize("NFKC", r.t).casefold().split())
        assert r.a == sum(unicodedata.category(c)[0] == "L" for c in r.t)
    f1 = spark.createDataFrame([("red blue", "red green"), ("", ""), ("a", ""), ("a a b", "a b b")], "p string, r string").select(X.token_f1(F.col("p"), F.col("r")).alias("s")).collect()
    assert [round(r.s, 6) for r in f1] == [0.5, 1.0, 0.0, round(2 * 2 / 6, 6)]
    assert spark.range(1).select(X.answer_normal(F.lit("  BLUE. ")).alias("x")).first().x == "blue"
    assert re  # the patterns above are Python's


def test_groups_link_transitively(spark):
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "ask one", "ctx"), (2, "ask two", "ctx"), (3, "ask one", "other"), (4, near, ""), (5, near + " more", ""), (6, "alone here now", "")]
    df = spark.createDataFrame([(i, a, c, "r") for i, a, c in rows], "source_id long, instruction string, context string, response string")
    found = {r.source_id: r.root for r in instructions.grouped(instructions.keyed(df)).select("source_id", "root").collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_round_robin_and_first_per_key(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 5, 2)], f"k{i}") for i in range(60)], "id long, c string, k string")
    got = sampling.round_robin(df, "c", "k", 9).collect()
    assert sorted(r.c for r in got) == list("aaabbbccc")
    with pytest.raises(ValueError):
        sampling.round_robin(df, "c", "k", 100)
    twice = spark.createDataFrame([(2, "x"), (1, "x"), (3, "y")], "i long, k string")
    assert {(r.i, r.k) for r in dedup.first_per_key(twice, "k", "i").collect()} == {(1, "x"), (3, "y")}


def test_sinks_refuse_what_is_not_finite(spark, tmp_path):
    sinks.append_event(spark, str(tmp_path / "log"), {"event": "x", "loss": 1.0})
    with pytest.raises(ValueError):
        sinks.append_event(spark, str(tmp_path / "log"), {"event": "x", "loss": float("nan")})


def test_wrong_outputs_that_equal_their_training_partner(spark):
    train = spark.createDataFrame([("lea", "Tom"), ("lea", "Tom"), ("lea", "Max"), ("ben", "Ida"), (None, "Zoe")], "holder string, answer string")
    rows = [
        ("map", "lea", "Tom", "Eva"), ("map", "lea", "max", "Eva"), ("map", "ben", "Ida", "Eva"),  # the partner's answer
        ("map", "ben", "Tom", "Eva"), ("map", "lea", None, "Eva"), ("map", None, "Zoe", "Eva"), ("map", "new", "Ida", "Eva"),  # other errors
        ("key", "lea", "Tom", "Tom"), ("key", "ben", "Ida", "Ida"),  # right, though the partner's answer too
    ]
    outputs = spark.createDataFrame(rows, "task string, holder string, predicted string, reference string")
    got = scoring.partner_errors(outputs, train, "holder", "task")
    assert {r.task: (r.examples, r.wrong, r.partner) for r in got.collect()} == {"map": (7, 7, 3), "key": (2, 0, 0)}


@pytest.mark.parametrize("seed", [4, 5])
def test_source_counters_equal_the_reading_loop(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(90)) for _ in range(rng.randint(20, 50))) for _ in range(6000)]
    # most documents fall to train, so a few dozen of each split are picked
    by_split = spark.createDataFrame([(x,) for x in pool], "text string").select("text", splits.document_split(X.fingerprint(F.col("text"))).alias("split")).collect()
    pool = [x for s in ("train", "val", "holdout") for x in sorted(r.text for r in by_split if r.split == s)[:30]]
    rows = [(i, rng.choice([*pool, "short", None, "1 2 3 " * 60]) if rng.random() < 0.8 else rng.choice(["short", None]), rng.choice("abz")) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    budgets = {"train": 300, "val": 165, "holdout": 140}
    t = F.col("text")
    known = {r.doc_id: r for r in df.select("doc_id", "source", F.coalesce(filters.eligible(t), F.lit(False)).alias("good"), X.fingerprint(t).alias("fp"), splits.document_split(X.fingerprint(t)).alias("split"), (X.n_pieces(t) + 1).alias("n")).collect()}
    seen, expected = set(), {}
    for name in ("b", "a"):
        left, own = dict(budgets), dict.fromkeys(("visited", "filtered", "duplicates", "truncated", *(f"{s}_{k}" for k in ("documents", "tokens") for s in budgets)), 0)
        for i in sorted(i for i, r in known.items() if r.source == name):
            r = known[i]
            own["visited"] += 1
            if not r.good:
                own["filtered"] += 1
                continue
            if r.fp in seen:
                own["duplicates"] += 1
                continue
            seen.add(r.fp)
            take = min(r.n, left[r.split])
            if take:
                left[r.split] -= take
                own[f"{r.split}_documents"] += 1
                own[f"{r.split}_tokens"] += take
                own["truncated"] += take < r.n
            if not any(left.values()):
                break
        assert not any(left.values()), left
        expected[name] = own
    got = {r.source: r.asDict() for r in corpus.source_counters(df, F.col("source"), ["b", "a"], budgets).collect()}
    assert got == {s: {"source": s, **own} for s, own in expected.items()}
    assert all(own["duplicates"] and own["truncated"] and own["filtered"] for own in expected.values())


def test_a_subset_keeps_its_parent_and_finds_changes(spark, tmp_path):
    parent, child = str(tmp_path / "parent"), str(tmp_path / "child")
    texts = [" ".join(f"w{(i * 7 + k) % 53}" + "abcdefgh"[k % 8] * (k % 5 + 1) for k in range(40)) + f" no {'x' * (i % 9)} {i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    corpus.prepare(docs, parent, {"train": 5000, "val": 300, "holdout": 200})
    small = corpus.prepare_subset(parent, child, spark, 1234)
    sums = {r.split: r.n for r in small.groupBy("split").agg(F.sum("tokens").alias("n")).collect()}
    assert sums == {"train": 1234, "val": 300, "holdout": 200}
    for folder, least in ((parent, 5000), (child, 1234)):
        tokens = spark.read.parquet(f"{folder}/tokens").where("split = 'train'").orderBy("start_token").collect()
        assert sum(len(r.ids) for r in tokens) == least and all(r.ids[-1] == 0 and r.ids.count(0) == 1 for r in tokens)
    row = small.where("split = 'train'").orderBy(F.desc("start_token")).first()
    assert row.truncated and row.parent_tokens > row.tokens and row.parent_start_token == row.start_token
    import json

    facts = json.loads(open(f"{child}/manifest.json").read())
    assert facts["status"] == "complete" and facts["totals"]["val"] == json.loads(open(f"{parent}/manifest.json").read())["totals"]["val"]
    with pytest.raises(FileExistsError):
        corpus.prepare_subset(parent, child, spark, 1234)
    with pytest.raises(quota.BudgetError):
        corpus.prepare_subset(parent, str(tmp_path / "more"), spark, 5001)
    from corvane.plans import holdout

    assert holdout.corpus_holdout(spark, child, "blank-separated").collect() == []
    # one row of the index is written twice: the manifest no longer fits
    spark.read.parquet(f"{parent}/documents").limit(1).write.mode("append").partitionBy("split").parquet(f"{parent}/documents")
    with pytest.raises(ValueError):
        corpus.prepare_subset(parent, str(tmp_path / "other"), spark, 1000)


def test_a_corpus_that_fails_says_so(spark, tmp_path):
    import json

    docs = spark.createDataFrame([(1, "some words " * 30, "s")], "doc_id long, text string, source string")
    with pytest.raises(quota.BudgetError):
        corpus.prepare(docs, str(tmp_path / "c"), {"train": 10**6})
    assert json.loads((tmp_path / "c" / "manifest.json").read_text())["status"] == "incomplete"


def test_raw_parts_are_the_tokens_in_order(spark):
    import numpy as np

    rows, at = [], 0
    for n in (3, 1, 17, 5, 0, 9, 30):
        rows.append(("train", at, list(range(at, at + n))))
        at += n
    parts = sinks.raw_parts(spark.createDataFrame(rows, "split string, start_token long, ids array<int>"), 8).orderBy("part").collect()
    assert [r.part for r in parts] == list(range(9)) and [r.tokens for r in parts] == [8] * 8 + [1]
    assert np.frombuffer(b"".join(bytes(r.content) for r in parts), "<u4").tolist() == list(range(at))


def test_zipped_tables_must_agree(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "n long, id string, v int")
    b = spark.createDataFrame([(1, "x", 7), (2, "y", 8)], "n long, id string, w int")
    assert sorted(map(tuple, scoring.zipped(a, b, "n", "id").select("n", "id", "v", "w").collect())) == [(1, "x", 5, 7), (2, "y", 6, 8)]
    for wrong in (b.withColumn("id", F.lit("x")), b.where("n = 1")):
        with pytest.raises(Exception):
            scoring.zipped(a, wrong, "n", "id").collect()


@pytest.mark.parametrize("budgets", [{}, {"train": 0}, {"train": -5}, {"train": 1.5}, {"train": True}, {"train": "9"}])
def test_budgets_are_whole_numbers_above_zero(spark, tmp_path, budgets):
    docs = spark.createDataFrame([(1, "some words " * 30, "s")], "doc_id long, text string, source string")
    with pytest.raises(quota.BudgetError):
        corpus.prepare(docs, str(tmp_path / "c"), budgets)
    assert not (tmp_path / "c").exists()
