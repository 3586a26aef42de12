import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as P
from corvane.llm import mixing, packing, secrets, toxicity

from test_models import labelled
from test_near_dedup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, labels = labelled(spark, 400)
    rows = [(i, t, lang, f"s{i % 3}", n) for i, t, lang, _, n, *_ in rows]
    extra = [(1000 + i, rows[3 * i + 1][1] + " again" * (i % 2), "en", "s1", 5) for i in range(20)]
    extra += [(2000, 'the token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" is here', "en", None, 1), (2001, None, None, "s2", None), (2002, "", "en", "s2", 0), (2003, "long " * 5000, "en", "s0", 1)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows + extra + rows[:2], SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_each_stage_does_its_work_on_its_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inputs = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, inputs[-1], sf_dir)
        if i < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        inputs.append(P.settle(out, "test-stage"))
    clean, single, masked, mixed, packed = inputs[1:]
    verdicts = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in docs.collect() if not verdicts[r.doc_id])
    kept = {i for i, _, root, k in brute([(r.doc_id, r.text) for r in clean.collect()], 5) if k}
    assert Counter(r.doc_id for r in single.collect()) == Counter(kept)
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r.text for r in masked.collect()}
    assert set(before) == set(after) and after[2000] == 'the token = "[secret]" is here'
    changed = {r.doc_id for r in secrets.scan_documents(single).where("n_secrets > 0").collect()}
    assert {i for i in before if before[i] != after[i]} == changed
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(masked).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len((r.text or "").split())
    assert all(words[i] == t for i, (_, t) in taken.items())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    expected = Counter()
    for r in mixed.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            expected[r.doc_id, k, zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in packed.collect()) == expected


def test_run_equals_its_stages(spark, sf_dir):
    got = P.run(spark, sf_dir)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)
    assert P.queries()["pipeline"] is P.run and P.oracle_sql() == {}


def test_entry_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(P.__file__))
    for name in ("corvane", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "corvane" / "llm")
    command = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q); print(len(q), len(e.oracle_sql()))"
    for removed in ("", "corpus_pipeline.py"):
        if removed:
            os.remove(tmp_path / removed)
        done = subprocess.run([sys.executable, "-c", command], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
        assert done.returncode == 0, done.stderr
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') for n in q); print(len(q), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
