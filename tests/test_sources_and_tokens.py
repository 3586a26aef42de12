import gzip
import json

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from corvane.functions import tokens as K, vectors as V
from corvane.operators import checks, probes, runs, scoring
from corvane.sources import readers


def test_json_lines_keep_bad_rows(spark, tmp_path):
    lines = [json.dumps({"text": "one"}), "{broken", json.dumps(["list"]), json.dumps({"text": 5}), json.dumps({"other": 1}), json.dumps({"text": "ü\n2"})]
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(json.dumps({"text": "first"}).encode() + b"\n\xff\n"))
    (tmp_path / "skip.txt").write_text("no")
    got = readers.json_lines(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.text for r in got] == ["first", None, "one", None, None, None, None, "ü\n2"]
    assert got[2].locator == "b.jsonl.zst:1"
    assert readers.dropping_json_lines(spark, str(tmp_path), "*.zst").count() == 3


def test_code_files_are_strict(spark, tmp_path):
    row = {"content": "x", "repo_name": "r", "path": "p.py", "license": "mit", "autogenerated": False}
    (tmp_path / "a.json.gz").write_bytes(gzip.compress((json.dumps(row) + "\n").encode()))
    assert readers.code_files(spark, str(tmp_path)).first().locator == "a.json.gz:1"
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b"{bad\n"))
    with pytest.raises(Exception):
        readers.code_files(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("content", [b"", b"12345", np.array([1], "<u4").tobytes(), np.array([1, 900], "<u4").tobytes(), b"\x93NUMPY" + b"\0" * 10])
def test_token_files(spark, tmp_path, content):
    (tmp_path / "good.bin").write_bytes(np.arange(12, dtype="<u4").tobytes())
    found = readers.token_files(spark, str(tmp_path / "good.bin"), 100).first()
    assert (found.tokens, found.max_id) == (12, 11)
    (tmp_path / "bad.bin").write_bytes(content)
    with pytest.raises(Exception):
        readers.token_files(spark, str(tmp_path / "bad.bin"), 100).collect()


def test_event_log_tolerates_only_a_torn_end(spark, tmp_path):
    good = [json.dumps({"event": "step", "step": i}) for i in range(4)]
    (tmp_path / "a").write_text("\n".join(good) + '\n{"event": "st')
    assert readers.event_log(spark, str(tmp_path / "a"), "event string, step long").count() == 4
    (tmp_path / "b").write_text("\n".join([good[0], "{torn", good[1]]))
    with pytest.raises(ValueError):
        readers.event_log(spark, str(tmp_path / "b"), "event string, step long")


def test_lines_are_numbered_over_all_splits_of_a_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"text": f"line {i}"}) + "\n" for i in range(5000)))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.jsonl").write_bytes(b'{"text": "x\xff"}\r\n{"text": "y"}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = readers.json_lines(spark, str(tmp_path), "*.jsonl").orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.text for r in got] == [f"line {i}" for i in range(5000)] + ["x\ufffd", "y"]
    assert [int(r.locator.split(":")[1]) for r in got] == [*range(1, 5001), 1, 2]


def test_prior_corpus_and_tokenizer(spark, tmp_path):
    rows = spark.createDataFrame([("f1",), ("f1",), ("f2",)], "fingerprint string")
    rows.write.parquet(str(tmp_path / "documents"))
    (tmp_path / "manifest.json").write_text(json.dumps({"status": "complete", "version": 1, "tokenizer": "t", "index": "0:3"}))
    with pytest.raises(ValueError):
        readers.prior_fingerprints(spark, str(tmp_path), "t")
    (tmp_path / "manifest.json").write_text(json.dumps({"status": "complete", "version": 1, "tokenizer": "t", "index": readers.index_digest(rows)}))
    assert readers.prior_fingerprints(spark, str(tmp_path), "t").count() == 2
    with pytest.raises(ValueError):
        readers.prior_fingerprints(spark, str(tmp_path), "other")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("hello world",), ("",)], "t string").select(readers.encoder(path)("t").alias("ids"), readers.round_trips(path)("t").alias("same")).collect()
    assert [len(r.ids) for r in df] == [2, 0] and all(r.same for r in df)


def test_masks_and_windows(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 0], 2), ([2, 5, 0], 1)], "ids array<int>, b int")
    got = [r.x for r in df.select(K.masked_labels(F.col("ids"), F.col("b"), F.lit(4)).alias("x")).collect()]
    assert got == [[-100, 3, 4, 0], [5, 0, -100, -100]]
    for n in (1, 2, 12, 13, 14, 17):
        ids = list(range(n))
        w = spark.createDataFrame([(ids,)], "ids array<int>").select(K.windows(F.col("ids"), 3).alias("w")).first().w or []
        assert [t for r in w for t in r.tokens[1:]] == ids[1:] and all(r.tokens[0] == r.start for r in w)
    ends = spark.range(3).select(K.evaluation_offset(F.col("id"), F.lit(9), F.lit(3)).alias("x")).collect()
    assert [r.x for r in ends] == np.linspace(0, 8, 3).astype(int).tolist()
    cut = spark.createDataFrame([([1, 2, 3],)], "ids array<int>").select(K.with_end(F.col("ids"), 9).alias("a"), K.with_end(F.col("ids"), 9, F.lit(2)).alias("b")).first()
    assert cut.a == [1, 2, 3, 9] and cut.b == [1, 9]
    with pytest.raises(Exception):
        spark.createDataFrame([([1, 7],)], "ids array<int>").select(K.in_vocabulary(F.col("ids"), 5)).collect()


def test_attention_agrees_with_numpy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 8))
    plain = V.attend(x, 4, 4)
    for h in range(4):
        q = x[:, 2 * h : 2 * h + 2]
        z = q @ q.T / np.sqrt(2)
        z[np.triu_indices(6, 1)] = -np.inf
        p = np.exp(z - z.max(1, keepdims=True))
        assert np.allclose(plain[:, 2 * h : 2 * h + 2], p / p.sum(1, keepdims=True) @ q)
    assert V.attend(x, 4, 2).shape == (6, 8)
    assert V.greedy(lambda ids: np.eye(5)[(ids[-1] + 1) % 5], [0], 2, 3, 10) == [0, 1, 2, 3]


def test_pairs_and_losses_refuse_bad_input(spark, tmp_path):
    a = spark.createDataFrame([(1, True), (2, False)], "id long, exact_match boolean")
    b = spark.createDataFrame([(1, False), (2, True)], "id long, exact_match boolean")
    assert {(r.id, r.change) for r in scoring.gains(scoring.paired(a, b, "id"), "id").collect()} == {(1, "lost"), (2, "gained")}
    with pytest.raises(Exception):
        scoring.paired(a, b.where("id = 1"), "id").collect()
    with pytest.raises(Exception):
        scoring.weighted_loss(spark.createDataFrame([(float("nan"),)], "nll double")).collect()
    measured = spark.createDataFrame([("m", 1.0, 10)], "k string, loss double, scored_tokens long")
    assert checks.control_faults(measured, measured, "k", 1e-6).isEmpty()
    assert not checks.control_faults(measured, measured.withColumn("loss", F.lit(1.1)), "k", 1e-6).isEmpty()
    with pytest.raises(ValueError):
        checks.distinct_paths("a", "a")
    (tmp_path / "train").mkdir()
    with pytest.raises(ValueError):
        checks.distinct_paths(f"{tmp_path}/train", f"file://{tmp_path}//train/.")


def test_instruction_checks_catch_mutations(spark):
    schema = "ids array<int>, prompt_tokens int, source_id string, fingerprint string, group_key string, split string"
    rows = [([1, 2, 0], 1, "a", "f1", "g1", "train"), ([3, 4, 0], 2, "b", "f2", "g2", "val")]
    good = spark.createDataFrame(rows, schema)
    assert checks.instruction_faults(good, 0, 10, 8).isEmpty()
    for i, value in ((0, [1, 2, 3]), (0, [99, 2, 0]), (1, 3), (3, "f2"), (4, "g2"), (0, [1] * 9 + [0])):
        bad = list(rows[0])
        bad[i] = value
        assert not checks.instruction_faults(spark.createDataFrame([tuple(bad), rows[1]], schema), 0, 10, 8).isEmpty()
    assert not checks.holdout_faults(good, good.where("split = 'val'")).isEmpty()
    assert checks.holdout_faults(good.where("split = 'val'"), good.where("split = 'train'")).isEmpty()


def test_probes_and_manifest(spark):
    p = probes.build(spark, probes.TRAIN_OFFSETS, "train")
    assert probes.faults(p).isEmpty()
    wrong = p.withColumn("response", F.when(F.col("id") == "train-1-0-1", "blue").otherwise(F.col("response")))
    assert [r.fault for r in probes.faults(wrong).collect()] == ["answer"]
    vague = spark.createDataFrame([("Ada has the red card. Ada has the blue card.", "Which card does Ada have?")], "c string, i string")
    assert vague.select(probes.solve(F.col("c"), F.col("i")).alias("x")).first().x is None
    manifest = spark.createDataFrame([("complete", 1, "t", 5)], "status string, version int, tokenizer string, vocabulary int")
    assert checks.manifest_faults(manifest, "t", 5).isEmpty() and not checks.manifest_faults(manifest, "u", 5).isEmpty()
    log = spark.createDataFrame([(1, 2.0, 1), (2, 4.0, 3), (3, 1.0, 1)], "step long, loss double, tokens long")
    assert [(r.block, r.mean_loss) for r in runs.training_means(log, 2).orderBy("block").collect()] == [(1, 3.5), (2, 1.0)]


def test_streams(spark, tmp_path):
    from corvane.streaming.logs import first_seen, windowed_means

    source = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{source}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    q = windowed_means(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "1 day").writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): (r.n, round(r.mean_value, 6)) for r in spark.table("means").collect()}
    assert got == {(r.start, r.event_type): (r.n, round(r.mean_value, 6)) for r in windowed_means(events, "1 day").collect()}
    rows = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "docs"))
    q = first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "docs"))).writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2


def test_every_token_of_a_text_has_its_vector(spark, tmp_path):
    from corvane.plans.queries import QUERIES

    docs = spark.createDataFrame([(1, "a b a", None), (2, None, "en"), (3, "", "de"), (4, "b", None)], "doc_id long, text string, lang string")
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "token long, vector array<double>")
    got = sorted((r.doc_id, r.pos, r.token, r.vector) for r in V.token_vectors(docs, "doc_id", F.split("text", " ", -1), table, 7).where("doc_id <> 3").collect())
    a, b = (spark.range(1).select(F.pmod(F.xxhash64(F.lit(x)), F.lit(7))).first()[0] for x in "ab")
    assert got == [(i, k, t, [float(t), 1.0]) for i, k, t in ((1, 0, a), (1, 1, b), (1, 2, a), (4, 0, b))]
    # the query keeps documents without a language
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [0.5, 1.0], i) for i in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(r.doc_id for r in QUERIES["embedding_lookup"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
