"""Registered queries over files: each writes what it needs into the shared folder with the sinks, and scans it back."""

from __future__ import annotations

import contextlib
import io
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions import text as X, tokens as K, vectors as V
from corvane.operators import checks, filters, probes, quota, sampling, scoring
from corvane.plans import corpus, holdout, instructions
from corvane.plans.queries import BUDGETS, Query, answers, bigrams, docs, outcomes, rounded
from corvane.sources import readers, sinks
from corvane.sources.readers import table
from corvane.sources.storage import settle, shared_dir

FILES: dict[str, Query] = {}
VOCABULARY = 1_000_000
#: A tokenizer file, and the digest of its content that the queries rely on.
TOKENIZER, PIN = "byte_bpe_50k.json", "cec27cb89f428497695f4e2a90118d636a594654897a44c0fb11b8f185521820"
#: Rows of the instruction set by split, and its limits.
COUNTS, LIMITS = {"train": 24, "val": 2, "holdout": 3}, {"categories": ("early", "late"), "most_answer": 60, "most_total": 400}


def query(f: Query) -> Query:
    FILES[f.__name__] = f
    return f


def folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def total(x) -> F.Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)


def shards(spark: SparkSession, d: str) -> str:
    """The documents as three gzip shards of JSON lines in order of their ids; some lines are broken, or hold no text."""
    k = F.col("doc_id") % 10
    line = F.when(k == 3, '{"text": ').when(k == 4, "[1, 2]").when(k == 5, '{"text": 7}').when(k == 6, '{"text": ""}').otherwise(F.to_json(F.struct("text")))
    rows = docs(spark, d).select((F.col("doc_id") % 3).alias("shard"), "doc_id", line.alias("value"))
    where = folder(spark, "lines")
    rows.repartition(3, "shard").sortWithinPartitions("shard", "doc_id").select("value", "shard").write.partitionBy("shard").option("compression", "gzip").text(where)
    return where


@query
def json_lines_scan(spark, d):
    rows = readers.json_lines(spark, shards(spark, d), "*.gz")
    return rows.select(F.shiftright("seq", 40).alias("file_no"), F.substring_index("locator", ":", -1).cast("long").alias("line_no"), X.digest(F.col("text")).alias("sha256"))


@query
def dropping_scan(spark, d):
    rows = readers.dropping_json_lines(spark, shards(spark, d), "*.gz")
    return rows.select(F.shiftright("seq", 40).alias("file_no"), F.substring_index("locator", ":", -1).cast("long").alias("line_no"), X.digest(F.col("text")).alias("sha256"))


def code(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files of code: texts in quotes, with names, licences and flags by their ids."""
    i = F.col("doc_id")
    licence = F.get(F.array(*(F.lit(x) for x in (*filters.LICENSES, "gpl-3.0"))), (i % 6).cast("int"))
    content = F.concat(F.lit('"""'), F.regexp_replace("text", '["\\\\\\\\\\x00]', ""), F.lit('"""'))
    return docs(spark, d).select(
        i.alias("seq"), content.alias("content"), F.when(i % 17 == 0, " ").otherwise(F.col("source")).alias("repo_name"),
        F.concat(F.lit("a/f"), i.cast("string"), F.when(i % 7 == 0, ".txt").otherwise(".py")).alias("path"), licence.alias("license"),
        F.when(i % 11 == 0, F.lit(None)).otherwise(i % 13 == 0).cast("boolean").alias("autogenerated"),
    )


@query
def code_scan(spark, d):
    where = folder(spark, "code")
    code(spark, d).drop("seq").write.option("compression", "gzip").option("ignoreNullFields", "false").json(where)
    return filters.code_eligible(readers.code_files(spark, where, "*.json.gz")).select("path", "license", X.digest(F.col("content")).alias("content_sha256"))


@query
def code_corpus(spark, d):
    prior = code(spark, d).where("seq % 5 = 0").select(X.fingerprint(F.col("content")).alias("fingerprint")).distinct()
    index = corpus.prepare_code(code(spark, d), prior, {"train": 5_000, "val": 200, "holdout": 200})
    return index.select("seq", "repo_name", "split", "start_token", "tokens", "truncated", "content_sha256")


@query
def instruction_scan(spark, d):
    rows = answers(spark, d)
    where = folder(spark, "instructions")
    made = rows.select("source_id", F.to_json(F.struct("instruction", "context", "response", F.lit("qa").alias("category"))).alias("value"))
    made.repartition(1).sortWithinPartitions("source_id").select("value").write.text(where)  # one file is the format
    got = readers.instructions(spark, where, "*.txt")
    return got.select("source_id", "category", X.digest(F.concat_ws("|", "instruction", "context", "response")).alias("sha256"))


@query
def plan_scan(spark, d):
    where = folder(spark, "plan")
    sinks.write_text(spark, where, '{"models": ["a", "b"],\n "steps": 40,\n "holdout": {"tokens": 11}}', overwrite=False)
    return readers.plan(spark, where).select(F.explode("models").alias("model"), "steps", F.col("holdout.tokens").alias("tokens"))


@query
def event_scan(spark, d):
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("event"), F.col("event_id").alias("step"), F.col("value").alias("loss"))).alias("value"))
    torn = spark.createDataFrame([(1 << 60, '{"event": "st')], "event_id long, value string")
    where = folder(spark, "events")
    rows.unionByName(torn).repartition(1).sortWithinPartitions("event_id").select("value").write.text(where)  # a log is one file
    got = readers.event_log(spark, where, "event string, step long, loss double")
    return got.groupBy("event").agg(F.count("*").alias("n"), F.max("step").alias("last_step"), F.round(F.sum("loss"), 4).alias("loss"))


@query
def event_append(spark, d):
    """One event for each region, appended to a log and echoed; a value that isn't finite is refused and leaves no line."""
    where, echo, refused = folder(spark, "log"), io.StringIO(), 0
    with contextlib.redirect_stdout(echo):
        for r in table(spark, d, "region").select("r_regionkey", "r_name").toLocalIterator():  # a handful of rows
            sinks.append_event(spark, where, {"event": r.r_name, "step": r.r_regionkey})
        try:
            sinks.append_event(spark, where, {"event": "loss", "value": float("nan")})
        except ValueError:
            refused = 1
    got = readers.event_log(spark, where, "event string, step long")
    return got.select("event", "step", F.lit(len(echo.getvalue().splitlines())).cast("long").alias("echoed"), F.lit(refused).cast("long").alias("refused"))


@query
def public_records(spark, d):
    """Documents with their texts, and the same records without them, written side by side."""
    private, public = (settle(x, "records") for x in sinks.private_and_public(docs(spark, d).select("doc_id", "lang", "text"), ["text"]))
    met = public.join(private.select("doc_id", X.digest(F.col("text")).alias("sha256")), "doc_id")
    return met.select("doc_id", "lang", F.lit(len(public.columns)).cast("long").alias("public_columns"), "sha256")


def raw_files(spark: SparkSession, d: str) -> str:
    """The documents as three raw uint32 files in order of their ids: a piece's token is its length, 127 at most; 0 ends a document."""
    ids = F.transform(X.pieces(F.col("text")), lambda p: F.concat(F.char(F.least(F.char_length(p), F.lit(127))), F.lit("\0\0\0")))
    rows = docs(spark, d).select((F.col("doc_id") % 3).alias("shard"), "doc_id", F.array_join(ids, "").alias("value"))
    where = folder(spark, "raw")
    rows.repartition(3, "shard").sortWithinPartitions("shard", "doc_id").select("value", "shard").write.partitionBy("shard").option("lineSep", "\0\0\0\0").text(where)
    return f"{where}/*/*.txt"


def shard_of(path: str) -> F.Column:
    return F.regexp_extract(path, r"shard=(\d+)", 1).cast("long").alias("shard")


@query
def token_file_scan(spark, d):
    return readers.token_files(spark, raw_files(spark, d), 128).select(shard_of("path"), "tokens", "max_id", "sha256")


@query
def file_hash_scan(spark, d):
    return readers.file_hashes(spark, raw_files(spark, d)).select(shard_of("path"), "length", "sha256")


@query
def round_trip(spark, d):
    """Whether each text comes back from the ids of the pinned tokenizer."""
    import public_tokenizers

    same = readers.round_trips(readers.pinned(public_tokenizers.path(TOKENIZER), PIN))
    return docs(spark, d).select("doc_id", same("text").alias("same"))


def prepared(spark: SparkSession, d: str) -> str:
    where = folder(spark, "corpus")
    corpus.prepare(docs(spark, d), where, BUDGETS, vocabulary=VOCABULARY)
    return where


def summed(spark: SparkSession, where: str) -> DataFrame:
    """By split: documents, tokens and their sum, documents that end with the end token, and the manifest's total."""
    facts = readers.finished(spark, where, "blank-separated")
    made = spark.createDataFrame([(s, t["tokens"]) for s, t in facts["totals"].items()], "split string, manifest_tokens long")
    tokens = spark.read.parquet(f"{where}/tokens")
    sums = tokens.groupBy("split").agg(F.count("*").alias("documents"), F.sum(F.size("ids")).alias("tokens"), F.sum(total(F.col("ids"))).alias("token_sum"), F.sum((F.element_at("ids", -1) == 0).cast("long")).alias("ends"))
    return sums.join(made, "split")


@query
def corpus_prepare(spark, d):
    return summed(spark, prepared(spark, d))


@query
def corpus_subset(spark, d):
    parent, child = prepared(spark, d), folder(spark, "subset")
    corpus.prepare_subset(parent, child, spark, 8_000)
    lineage = spark.read.parquet(f"{child}/documents").groupBy("split").agg(F.sum("parent_tokens").alias("parent_tokens"))
    return summed(spark, child).join(lineage, "split")


@query
def prior_scan(spark, d):
    return readers.prior_fingerprints(spark, prepared(spark, d), "blank-separated")


@query
def token_parts(spark, d):
    tokens = spark.read.parquet(f"{prepared(spark, d)}/tokens")
    parts = sinks.raw_parts(tokens, 3_000)
    return parts.select("split", "part", "tokens", F.sha2("content", 256).alias("sha256"))


@query
def corpus_holdout(spark, d):
    """Faults of a corpus's holdout; none, and the number of documents looked at."""
    where = prepared(spark, d)
    return spark.read.parquet(f"{where}/documents").agg(F.count("*").alias("documents")).crossJoin(F.broadcast(holdout.corpus_holdout(spark, where, "blank-separated").agg(F.count("*").alias("faults"))))  # one row each


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).withColumn("category", F.when(F.col("source_id") % 1000 < 3, "early").when(F.col("source_id") % 1000 < 7, "late").otherwise("other"))


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).where("source_id % 9 = 1").select("source_id")


def copied(spark: SparkSession, d: str) -> DataFrame:
    """The instruction rows, a fifth of them a second time under later ids."""
    rows = labelled(spark, d)
    return rows.unionByName(rows.where("source_id % 5 = 2").withColumn("source_id", F.col("source_id") + 10_000_000))


@query
def instruction_accounting(spark, d):
    told = instructions.accounted(instructions.keyed(copied(spark, d)), reviewed(spark, d), "Wh", **LIMITS)
    return filters.reject_counts(told, F.col("reason"))


@query
def instruction_set(spark, d):
    rows = instructions.prepare(copied(spark, d), reviewed(spark, d), folder(spark, "set"), COUNTS, "Wh", seed="3", **LIMITS)
    return rows.select("source_id", "split", "category", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.size("ids").cast("long").alias("tokens"), total(F.col("ids")).alias("token_sum"))


@query
def prompt_encode(spark, d):
    rows = instructions.encoded(answers(spark, d))
    return rows.select("source_id", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.size("ids").cast("long").alias("tokens"), total(F.slice("ids", F.lit(1), F.col("prompt_tokens"))).alias("prompt_sum"), F.element_at("ids", -1).cast("long").alias("last"))


@query
def forced_end(spark, d):
    ids = K.in_vocabulary(K.with_end(instructions.piece_lengths(F.col("text")), 0, F.lit(20)), VOCABULARY)
    return docs(spark, d).select("doc_id", F.size(ids).cast("long").alias("n"), total(ids).alias("token_sum"), F.element_at(ids, -1).cast("long").alias("last"))


# checks: each is given rows with planted faults and finds just those


def index(spark: SparkSession, d: str) -> DataFrame:
    return settle(corpus.single_stream(docs(spark, d), BUDGETS), "index")


@query
def manifest_check(spark, d):
    rows = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "incomplete").otherwise("complete").alias("status"), (F.col("doc_id") % 3).cast("int").alias("version"), F.lit("t").alias("tokenizer"), F.lit(9).alias("vocabulary"))
    return checks.manifest_faults(rows, "t", 9).select("doc_id")


@query
def file_check(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), X.digest(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("length"))
    expected = rows.select("path", F.when(F.col("path").endswith("7"), "x").otherwise(F.col("sha256")).alias("sha256"), F.floor(F.col("length") / 4).alias("tokens"))
    return checks.file_faults(rows.where("path not like '%9'"), expected).select("path")


@query
def index_check(spark, d):
    rows = index(spark, d)
    broken = rows.where("seq % 11 <> 3").unionByName(rows.where("seq % 50 = 0 and split = 'val'"))
    totals = spark.createDataFrame([(s, n) for s, n in BUDGETS.items()], "split string, tokens long")
    return checks.index_faults(broken, totals).groupBy("fault").agg(F.count("*").alias("n"))


@query
def end_check(spark, d):
    ids = instructions.piece_lengths(F.col("text"))
    rows = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "val").otherwise("train").alias("split"), F.when(F.col("doc_id") % 5 == 0, ids).otherwise(K.with_end(ids, 0)).alias("ids"))
    return checks.end_faults(rows, 0).select("doc_id")


@query
def reserved_check(spark, d):
    rows = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "val").otherwise("train").alias("split"))
    return checks.reserved_faults(rows, rows.where("doc_id % 8 <> 0 and doc_id % 3 <> 1")).select("doc_id")


@query
def instruction_check(spark, d):
    i = F.col("doc_id")
    rows = docs(spark, d).select(
        i.alias("source_id"), F.concat(F.when(i % 6 == 0, F.array(F.lit(2_000_000))).otherwise(F.array(F.lit(5))), F.when(i % 4 == 0, F.array(F.lit(3))).otherwise(F.array(F.lit(3), F.lit(0)))).alias("ids"),
        F.when(i % 10 == 0, 0).otherwise(1).alias("prompt_tokens"), F.floor(i / 3).cast("string").alias("group_key"), F.concat(F.lit("f"), F.floor(i / F.when(i % 100 < 4, 2).otherwise(1)).cast("string"), F.when(i % 100 < 4, "x").otherwise("")).alias("fingerprint"), F.when(i % 9 == 0, "val").otherwise("train").alias("split"),
    )
    return checks.instruction_faults(rows, 0, VOCABULARY, 50).groupBy("fault").agg(F.count("*").alias("n"))


@query
def holdout_check(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("source_id"), X.fingerprint(F.col("text")).alias("fingerprint"), F.col("source").alias("group_key"))
    return checks.holdout_faults(rows.where("source_id % 10 = 0"), rows.where("source_id % 10 <> 0")).groupBy("key").agg(F.count("*").alias("n"))


def measured(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("loss"), F.count("*").alias("scored_tokens"))


@query
def control_check(spark, d):
    bent = F.col("loss") + F.when(F.col("event_type") < "d", 0.5).otherwise(1e-9)
    return checks.control_faults(measured(spark, d), measured(spark, d).withColumn("loss", bent), "event_type", 1e-6).select("event_type")


@query
def coverage_check(spark, d):
    rows = docs(spark, d).select(F.col("lang").alias("split"), X.n_pieces(F.col("text")).alias("tokens"))
    scored = rows.groupBy("split").agg((F.sum("tokens") - F.when(F.col("split") < "en", 2).otherwise(1)).alias("scored_tokens"))
    return checks.coverage_faults(scored, rows).select("split", "expected", "scored_tokens")


@query
def tables_unchanged(spark, d):
    """The marks of a table before and after a plan that reads it."""
    before = settle(checks.table_mark(docs(spark, d)), "mark")
    doc_sum = index(spark, d).agg(F.count("*").alias("index_rows"))
    after = settle(checks.table_mark(docs(spark, d)), "mark")
    return before.join(after.withColumnsRenamed({"rows": "rows_after", "mark": "mark_after"}), F.col("mark").eqNullSafe(F.col("mark_after"))).crossJoin(F.broadcast(doc_sum)).select("rows", "rows_after", "index_rows")  # one row each


@query
def report_audit(spark, d):
    found = scoring.with_total(outcomes(spark, d), "category")
    report = found.withColumn("exact", F.col("exact") + F.when(F.col("category") == "total", 1).otherwise(0))
    return checks.audit_report(report, found, "category")


@query
def final_holdout(spark, d):
    losses = scoring.bigram_losses(bigrams(spark, d)).join(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), (F.col("conv_id") % 5 == 0).alias("held")), "doc_id")
    losses = settle(losses.select(F.when(F.col("held"), "holdout").otherwise("train").alias("split"), "doc_id", "nll"), "losses")
    rows = losses.groupBy("split").agg((F.count("*") + 1).alias("tokens"))
    control = scoring.weighted_loss(losses.where("split = 'train'"), "split")
    return rounded(holdout.audit(rows, losses, control, control.select("split", "loss", "scored_tokens")), "loss", "perplexity")


# scoring of outputs


@query
def generation_summary(spark, d):
    rows = answers(spark, d).withColumns({"category": F.col("source_id") % 3, "stopped": F.length("instruction") < 200})
    scored = scoring.answer_scores(rows, F.col("instruction"), F.col("response"))
    return rounded(scoring.summary(scored, "category"), "exact_rate", "mean_f1", "stop_rate", "mean_repeated", digits=9)


@query
def partner_errors(spark, d):
    """Outputs are the answers of each conversation's next turn; training answers are those of the same conversation."""
    rows = answers(spark, d).select(F.floor(F.col("source_id") / 1000).cast("long").alias("conv"), "source_id", "response")
    partner = rows.select("conv", (F.col("source_id") - 2).alias("source_id"), F.col("response").alias("predicted"))
    outputs = rows.join(partner, ["conv", "source_id"], "left").select("conv", (F.col("conv") % 4).alias("task"), "predicted", F.col("response").alias("reference"))
    train = rows.where("conv % 3 > 0").select("conv", F.col("response").alias("answer"))
    return scoring.partner_errors(outputs, train, "conv", "task")


@query
def zip_join(spark, d):
    a = answers(spark, d).select("source_id", F.length("instruction").cast("long").alias("asked"))
    raw = answers(spark, d).select(F.col("source_id").alias("ordinal"), "source_id", F.length("response").cast("long").alias("said"))
    return scoring.zipped(a.withColumn("ordinal", F.col("source_id")), raw, "ordinal", "source_id").select("source_id", "asked", "said")


@query
def budget_check(spark, d):
    """Splits of a corpus that hold less than asked for: what ``quota.require`` raises on."""
    rows = index(spark, d).groupBy("split").agg(F.sum("tokens").alias("have"))
    return rows.withColumn("wanted", quota.quota_of({"train": 20_000, "val": 151, "holdout": 150})).where("have <> wanted").select("split", "have", "wanted")


@query
def stratified_or_all(spark, d):
    rows = docs(spark, d).where("lang <> 'en'").select("doc_id", "lang", F.col("doc_id").cast("string").alias("key"))
    return sampling.all_or_stratified(rows, "lang", "key", 30, "5").select("doc_id", "lang")


@query
def attention_sums(spark, d):
    """Grouped attention of four query heads over two shared ones: every output value of every position, summed up."""
    x = table(spark, d, "embeddings").where("embedding is not null").select(F.floor(F.col("vec_id") / 16).cast("long").alias("sequence"), "vec_id", "embedding")
    xs = x.groupBy("sequence").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda r: r["embedding"]).alias("xs"))
    out = xs.mapInPandas(V.grouped_attention(4, 2), "sequence long, out array<array<double>>").select("sequence", F.posexplode("out").alias("pos", "y"))
    return rounded(out.select("sequence", F.col("pos").cast("long").alias("pos"), F.get("y", F.lit(0)).alias("first"), V.total(F.col("y")).alias("sum")), "first", "sum")


@query
def token_vectors(spark, d):
    """N1: the vector of every piece of every turn, summed by turn; a piece's token is its length."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.posexplode(X.pieces(F.col("text"))).alias("pos", "piece"))
    vectors = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    found = V.embedding_lookup(turns.withColumn("token", F.char_length("piece").cast("long")), vectors)
    return rounded(found.groupBy("turn_id").agg(F.count("*").alias("tokens"), F.sum(F.get("vector", F.lit(0)).cast("double")).alias("first"), F.sum(V.total(V.doubles(F.col("vector")))).alias("sum")), "first", "sum", digits=4)


@query
def padded_windows(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(K.padded_windows(instructions.piece_lengths(F.col("text")), 64, -1)).alias("window_id", "w"))
    own = F.filter("w", lambda v: v >= 0)
    return rows.select("doc_id", F.col("window_id").cast("long").alias("window_id"), F.size("w").cast("long").alias("width"), F.size(own).cast("long").alias("tokens"), total(own).alias("token_sum"))


@query
def epoch_windows(spark, d):
    """Each window of the documents' pieces once, by the order of an epoch: whether all are there, and how many draws are in range."""
    n = docs(spark, d).agg(F.sum(X.n_pieces(F.col("text"))).alias("n")).first().n // 64
    order, drawn = sampling.epoch_order(spark, n, 3), sampling.window_sample(spark, n, 500, 3)
    every = order.agg(F.count("*").alias("windows"), F.count_distinct("window_id").alias("distinct_windows"), F.max("window_id").alias("last"))
    return every.crossJoin(F.broadcast(drawn.agg(F.count_if((F.col("window_id") >= 0) & (F.col("window_id") < n)).alias("draws"))))  # one row each


@query
def probe_tasks(spark, d):
    """The copy and colour tasks under four conditions, with the answer that the rule finds."""
    out = None
    for task in probes.TASKS:
        rows = probes.task_conditions(probes.build_task(spark, task, probes.DEV_OFFSETS, "dev"), task)
        rows = rows.withColumn("answer", probes.solve_task(task, F.col("context"), F.col("instruction")))
        out = rows if out is None else out.unionByName(rows)
    return out.select("id", "base_id", "category", "condition", "instruction", "context", "response", "answer")
