"""Registered queries of the core engine. Each runs over whole tables; names match ``oracle.sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions import text as X, tokens as K, vectors as V
from corvane.operators import checks, dedup, filters, probes, quota, runs, sampling, scoring, splits
from corvane.plans import corpus, instructions
from corvane.sources.readers import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BUDGETS = {"train": 20_000, "val": 150, "holdout": 150}
SOURCE_BUDGETS = {"train": 5_000, "val": 100, "holdout": 100}
SOURCES = ["s0", "s1", "s2", "s3"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def source_of() -> Column:
    return F.concat(F.lit("s"), (F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 4).cast("string"))


# text and filters


@query
def doc_fingerprint(spark, d):
    return docs(spark, d).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@query
def content_digest(spark, d):
    return docs(spark, d).select("doc_id", X.digest(F.col("text")).alias("sha256"))


@query
def prompt_normal_digest(spark, d):
    return docs(spark, d).select("doc_id", X.digest(X.prompt_normal(F.col("text"))).alias("sha256"))


@query
def doc_alpha_ratio(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", X.n_chars(t).alias("chars"), X.n_letters(t).alias("letters"), X.n_visible(t).alias("visible"), F.round(X.alpha_ratio(t), 9).alias("ratio"))


@query
def doc_words(spark, d):
    w = X.words(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"), F.size(X.shingles(w)).cast("long").alias("shingles"))


@query
def doc_eligible(spark, d):
    return docs(spark, d).where(filters.eligible(F.col("text"))).select("doc_id")


@query
def doc_reject_reasons(spark, d):
    reason = filters.first_reason([("length", filters.long_enough(F.col("text"))), ("alphabet", filters.alphabetic(F.col("text")))])
    return filters.reject_counts(docs(spark, d), reason)


@query
def review_exclusion(spark, d):
    bad = table(spark, d, "labels").where("quality = 0")
    return filters.without(docs(spark, d), bad, "doc_id").select("doc_id", "source")


@query
def syntax_valid(spark, d):
    return docs(spark, d).select("doc_id", filters.parses("text").alias("parses"))


# splits and dedup


@query
def hash_split(spark, d):
    fp = X.fingerprint(F.col("text"))
    return docs(spark, d).select("doc_id", X.bucket(fp).alias("bucket"), splits.document_split(fp).alias("split"))


@query
def host_split(spark, d):
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    return table(spark, d, "pages").select("page_id", host.alias("host"), splits.repository_split(host).alias("split"))


@query
def exact_dedup(spark, d):
    # of each fingerprint the first document is all that is asked for: one aggregate, no join back
    return docs(spark, d).groupBy(X.fingerprint(F.col("text")).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fingerprint")


@query
def composite_dedup(spark, d):
    key = dedup.canonical_key(*(X.prompt_normal(F.col(c)) for c in ("instruction", "context", "response")))
    rows = instructions.rows(table(spark, d, "conversations")).select("source_id", key.alias("fingerprint"))
    return dedup.first_per_key(rows, "fingerprint", "source_id")


@query
def prior_exclusion(spark, d):
    prior = docs(spark, d).where("lang = 'fr'").select(X.fingerprint(F.col("text")).alias("fingerprint")).distinct()
    rows = docs(spark, d).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint")).join(prior, "fingerprint", "left_anti")
    return dedup.first_per_key(rows, "fingerprint", "doc_id").select("doc_id", "fingerprint")


@query
def split_leakage(spark, d):
    rows = docs(spark, d).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"), F.when(F.col("doc_id") % 10 < 8, "train").otherwise("val").alias("split"))
    return splits.leaks(rows, "fingerprint")


@query
def benchmark_overlap(spark, d):
    own = docs(spark, d).select("doc_id", F.explode(X.shingles(X.words(F.lower("text")), 8)).alias("g"))
    held = table(spark, d, "benchmark").select(F.explode(X.shingles(X.words(F.lower("text")), 8)).alias("g")).distinct()
    return own.join(held, "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


@query
def near_dup_pairs(spark, d):
    return dedup.similar_pairs(docs(spark, d), "doc_id", X.words(X.prompt_normal(F.col("text"))))


@query
def near_dup_groups(spark, d):
    links = dedup.similar_links(docs(spark, d), "doc_id", X.words(X.prompt_normal(F.col("text"))))
    return dedup.groups(docs(spark, d), "doc_id", links).select(F.col("id").alias("doc_id"), "root")


@query
def group_key_split(spark, d):
    rows = docs(spark, d).select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"), F.col("source").alias("root"))
    keys = dedup.group_keys(rows, "root", "fingerprint")
    return keys.select("root", "group_key", splits.group_split(F.col("group_key")).alias("split"))


@query
def instruction_groups(spark, d):
    return instructions.grouped(instructions.keyed(instructions.rows(table(spark, d, "conversations")))).select("source_id", "root")


@query
def bag_equality(spark, d):
    a = docs(spark, d).select("lang", "source")
    return scoring.bag_difference(a, a.where("lang <> 'es'"))


# quotas


@query
def corpus_quota_fill(spark, d):
    return corpus.single_stream(docs(spark, d), BUDGETS).select("seq", "split", "start_token", "tokens", "original_tokens", "truncated")


@query
def corpus_quota_by_source(spark, d):
    return corpus.by_source(docs(spark, d), source_of(), SOURCES, SOURCE_BUDGETS).select("source", "seq", "split", "start_token", "tokens", "original_tokens", "truncated")


@query
def corpus_offsets(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("seq"), F.col("lang").alias("split"), X.n_pieces(F.col("text")).alias("tokens"))
    return quota.offsets(rows, ["seq"]).select("seq", "split", "tokens", "start_token")


@query
def subset_refill(spark, d):
    index = corpus.single_stream(docs(spark, d), BUDGETS)
    return quota.subset(index, 8_000).select("seq", "split", "start_token", "tokens", "truncated", "parent_start_token", "parent_tokens")


@query
def offset_continuity(spark, d):
    index = corpus.single_stream(docs(spark, d), BUDGETS)
    return quota.gaps(index.where("seq % 7 <> 3"))


@query
def legacy_fill(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("seq"), X.n_pieces(F.col("text")).alias("n_tokens"))
    return quota.legacy_fill(rows, 9_000, 3_000).select("seq", "split", "tokens")


@query
def split_stats(spark, d):
    rows = corpus.visible(docs(spark, d))
    return rows.groupBy("split").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.count_distinct("fingerprint").alias("fingerprints"))


@query
def source_counters(spark, d):
    t = F.col("text")
    good = filters.eligible(t)
    rows = docs(spark, d).select("source", good.alias("good"), X.n_pieces(t).alias("n"), splits.document_split(X.fingerprint(t)).alias("split"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    part = lambda s: F.col("good") & (F.col("split") == s)
    return rows.groupBy("source").agg(
        F.count("*").alias("visited"), one(~F.col("good")).alias("filtered"), *(one(part(s)).alias(f"{s}_documents") for s in BUDGETS),
        *(F.sum(F.when(part(s), F.col("n") + 1).otherwise(0)).cast("long").alias(f"{s}_tokens") for s in BUDGETS),
    )


@query
def stratified_select(spark, d):
    rows = docs(spark, d).select("doc_id", "lang", X.fingerprint(F.concat_ws("#", "text", F.col("doc_id").cast("string"))).alias("fingerprint"))
    return sampling.round_robin(rows, "lang", "fingerprint", 50, "7").select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


# instructions, masks, windows


def turns(spark: SparkSession, d: str) -> DataFrame:
    return instructions.keyed(instructions.rows(table(spark, d, "conversations")))


@query
def prompt_format(spark, d):
    return instructions.rows(table(spark, d, "conversations")).select("source_id", K.prompt(F.col("instruction"), F.col("context")).alias("prompt"))


@query
def instruction_rejects(spark, d):
    rows = turns(spark, d).withColumn("category", F.when(F.col("context") != "", "context").otherwise("closed"))
    return filters.reject_counts(rows, filters.first_reason(filters.instruction_rules("Wh", F.col("prompt_tokens"), F.col("answer_tokens"), 60, 200, ("context",))))


@query
def length_stats(spark, d):
    return turns(spark, d).agg(F.sum(F.col("prompt_tokens") + F.col("answer_tokens")).alias("total_tokens"), F.sum("answer_tokens").alias("answer_tokens"), F.max(F.col("prompt_tokens") + F.col("answer_tokens")).alias("longest"), F.count("*").alias("n"))


@query
def answer_length_histogram(spark, d):
    return turns(spark, d).groupBy(F.col("context") != "").agg(F.count("*").alias("n"), F.min("prompt_tokens").alias("least_prompt"), F.max("prompt_tokens").alias("most_prompt"), F.sum("answer_tokens").alias("answer_tokens")).toDF("with_context", "n", "least_prompt", "most_prompt", "answer_tokens")


def ids(column: str) -> Column:
    """Stand-in ids: the length of each piece."""
    return F.transform(X.pieces(F.col(column)), lambda w: F.char_length(w))


@query
def response_mask(spark, d):
    rows = instructions.rows(table(spark, d, "conversations")).select("source_id", ids("instruction").alias("p"), ids("response").alias("r"))
    rows = rows.where(F.size("p") > 0).select("source_id", K.with_end(F.concat("p", "r"), 0).alias("ids"), F.size("p").alias("b"))
    width = rows.agg(F.max(F.size("ids") - 1).alias("width"))  # one row
    made = rows.crossJoin(F.broadcast(width)).select("source_id", K.masked_labels(F.col("ids"), F.col("b"), F.col("width")).alias("labels"), K.padded_inputs(F.col("ids"), F.col("width"), 0).alias("inputs"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    return made.select("source_id", F.size("labels").cast("long").alias("width"), F.size(F.filter("labels", lambda v: v != -100)).cast("long").alias("supervised"), total(F.filter("labels", lambda v: v != -100)).alias("label_sum"), total(F.col("inputs")).alias("input_sum"))


@query
def token_windows(spark, d):
    w = docs(spark, d).select("doc_id", F.explode(K.windows(ids("text"), 64)).alias("w"))
    return w.select("doc_id", "w.window_id", "w.start", F.size("w.tokens").cast("long").alias("size"), F.aggregate("w.tokens", F.lit(0).cast("long"), lambda a, v: a + v).alias("token_sum"))


@query
def next_token_shift(spark, d):
    x = ids("text")
    return docs(spark, d).select("doc_id", F.size(K.inputs(x)).cast("long").alias("n"), F.aggregate(F.zip_with(K.inputs(x), K.targets(x), lambda a, b: (a * b).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v).alias("product_sum"))


@query
def batch_counts(spark, d):
    return docs(spark, d).select("doc_id", K.n_batches(X.n_pieces(F.col("text")), 32, 4).alias("batches"))


@query
def eval_offsets(spark, d):
    n = docs(spark, d).agg(F.count("*").alias("n"))
    return n.select("n", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")).select(F.col("i").cast("long").alias("i"), K.evaluation_offset(F.col("i"), F.col("n"), F.lit(16)).alias("window_id"))


@query
def lr_schedule(spark, d):
    e = table(spark, d, "events").select(F.col("event_id"))
    return rounded(e.select("event_id", K.learning_rate(F.col("event_id"), 3e-4, 0.1, 100, 200_000).alias("rate")), "rate", digits=10)


@query
def coverage_tokens(spark, d):
    return table(spark, d, "events").select("event_id", K.tokens_seen(F.col("event_id"), 100_000, 16, 8).alias("tokens"))


# scoring


def answers(spark: SparkSession, d: str) -> DataFrame:
    """User turns as predictions of the answers that follow them."""
    return instructions.rows(table(spark, d, "conversations"))


@query
def exact_match(spark, d):
    return answers(spark, d).select("source_id", (X.answer_normal(F.col("instruction")) == X.answer_normal(F.col("response"))).alias("exact"), X.digest(X.answer_normal(F.col("response"))).alias("answer_sha256"))


@query
def token_f1(spark, d):
    return answers(spark, d).select("source_id", F.round(X.token_f1(X.prompt_normal(F.col("instruction")), X.prompt_normal(F.col("response"))), 9).alias("f1"))


@query
def repeated_4gram(spark, d):
    return docs(spark, d).select("doc_id", F.round(X.repeated_fraction(X.words(F.col("text"))), 9).alias("repeated"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("lang").alias("category"), (F.col("quality") == 1).alias("exact_match"), (F.col("toxic") == 0).alias("stopped"), F.col("source"))


@query
def category_histogram(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))


@query
def category_scores(spark, d):
    o = outcomes(spark, d)
    return rounded(o.groupBy("category").agg(F.count("*").alias("examples"), F.sum(F.col("exact_match").cast("long")).alias("exact"), F.avg(F.col("exact_match").cast("double")).alias("rate"), F.avg(F.col("stopped").cast("double")).alias("stop_rate")), "rate", "stop_rate", digits=9)


@query
def category_total_rollup(spark, d):
    return scoring.with_total(outcomes(spark, d), "category")


@query
def score_cube(spark, d):
    o = outcomes(spark, d).withColumn("part", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    phases = o.withColumn("phase", F.lit("final")).unionByName(o.withColumn("exact_match", F.col("stopped")).withColumn("phase", F.lit("initial")))
    return scoring.cube(phases, "category", "part", "phase")


@query
def paired_vs_control(spark, d):
    o = outcomes(spark, d)
    return scoring.gains(scoring.paired(o.select("doc_id", "exact_match"), o.select("doc_id", F.col("stopped").alias("exact_match")), "doc_id"), "doc_id")


@query
def joint_context(spark, d):
    o = outcomes(spark, d).withColumn("context", F.floor(F.col("doc_id") / 2).cast("long"))
    return scoring.joint(o, "context").select("context", "queries", "all_right", "sound")


@query
def constant_answer(spark, d):
    o = outcomes(spark, d).withColumn("answer", F.col("exact_match").cast("string"))
    return scoring.constant_answer(o.where("doc_id % 3 > 0"), o.where("doc_id % 3 = 0"), "category", "answer").select("category", "examples", "right")


def bigrams(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, pos, prev, token`` of all conversation turns."""
    w = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), X.pieces(F.lower("text")).alias("w"))
    at = w.select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("pos"), F.size("w").alias("n")).where("n > 1")
    return at.select("doc_id", F.col("pos").cast("long").alias("pos"), F.get("w", F.col("pos") - 1).alias("prev"), F.get("w", F.col("pos")).alias("token"))


@query
def weighted_loss(spark, d):
    return rounded(scoring.weighted_loss(scoring.bigram_losses(bigrams(spark, d)), "doc_id"), "loss", "perplexity")


@query
def masked_accuracy(spark, d):
    e = table(spark, d, "events").select(F.col("event_type"), (F.col("event_id") % 5).alias("predicted"), F.when(F.col("event_id") % 3 == 0, -100).otherwise(F.col("user_id") % 5).alias("label"), F.col("value").alias("nll"))
    return rounded(scoring.masked_accuracy(e, "event_type"), "loss", "accuracy")


# runs


def log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("step"), F.col("event_type").alias("event"), F.col("value").alias("loss"), (F.col("user_id") % 100 + 1).alias("tokens"))


@query
def train_window_mean(spark, d):
    return rounded(runs.training_means(log(spark, d), 100), "mean_loss")


@query
def log_until(spark, d):
    return runs.until(log(spark, d), "click", 500).select("step", "loss")


@query
def final_state(spark, d):
    return runs.last_state(log(spark, d), 10_000)


@query
def median_trials(spark, d):
    e = table(spark, d, "events").select("event_type", "value", (F.col("user_id") * 2).alias("peak"))
    return rounded(runs.trial_medians(e, "event_type", "value", "peak"), "median_value")


@query
def run_comparison(spark, d):
    block = log(spark, d).withColumn("block", F.floor(F.col("step") / 1000).cast("long"))
    a, b = (block.where(F.col("step") % 2 == i).groupBy("block").agg(F.avg("loss").alias("loss"), F.count("*").alias("n")) for i in (0, 1))
    return rounded(runs.compare(a, b, "block", "loss", ["n"]), "before", "after", "ratio", "percent_change")


@query
def same_sizes(spark, d):
    return runs.same_size(docs(spark, d).groupBy("source").agg(F.count("*").alias("n")), "n")


@query
def plan_join(spark, d):
    models = docs(spark, d).select("lang").distinct().select(F.col("lang").alias("model"))
    bridge = docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n")).select(F.col("lang").alias("model"), "source", "n")
    old = outcomes(spark, d).groupBy("source").agg(F.sum(F.col("exact_match").cast("long")).alias("historical"))
    return models.join(bridge, "model").join(old, "source", "left").select("model", "source", "n", F.coalesce("historical", F.lit(-1)).cast("long").alias("historical"))


# probes


@query
def probe_generate(spark, d):
    return probes.build(spark, probes.TRAIN_OFFSETS, "train").unionByName(probes.build(spark, probes.DEV_OFFSETS, "dev"))


@query
def probe_transfer(spark, d):
    return probes.conditions(probes.build(spark, probes.DEV_OFFSETS, "dev")).select("id", "base_id", "condition", "instruction", "context", "response")


@query
def rule_oracle(spark, d):
    p = probes.conditions(probes.build(spark, probes.DEV_OFFSETS, "dev"))
    return p.select("id", probes.solve(F.col("context"), F.col("instruction")).alias("answer"), "response")


@query
def probe_faults(spark, d):
    return probes.faults(probes.build(spark, probes.TRAIN_OFFSETS, "train").where("id <> 'train-1-0-1'"))


@query
def answer_distribution(spark, d):
    a, b = probes.build(spark, probes.TRAIN_OFFSETS, "train"), probes.build(spark, probes.DEV_OFFSETS, "dev").where("id <> 'dev-2-3-1'")
    return checks.proportion_faults(a, b, "category", "response")


@query
def prompt_overlap(spark, d):
    a = answers(spark, d).select(X.digest(X.prompt_normal(F.col("instruction"))).alias("k"), "source_id")
    # the training prompts: the odd rows, and a seventh of the even ones, which are found
    train = a.where("source_id % 2 = 1 or source_id % 14 = 0").select("k").distinct()
    return a.where("source_id % 2 = 0").join(train, "k", "left_semi").select("source_id")


# vectors


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("embedding is not null")


@query
def rms_norm(spark, d):
    y = V.rms_norm(F.col("embedding"))
    return rounded(vectors(spark, d).select("vec_id", F.size("embedding").cast("long").alias("dims"), F.get(y, F.lit(0)).alias("first"), V.total(F.transform(y, lambda v: F.abs(v))).alias("absolute")), "first", "absolute")


@query
def rope_rotate(spark, d):
    y = V.rotate(F.col("embedding"), (F.col("vec_id") % 64).cast("double"))
    return rounded(vectors(spark, d).select("vec_id", F.get(y, F.lit(0)).alias("y0"), F.get(y, F.lit(1)).alias("y1"), F.get(y, F.lit(2)).alias("y2")), "y0", "y1", "y2")


@query
def swiglu(spark, d):
    y = V.swiglu(F.col("embedding"), F.reverse("embedding"))
    return rounded(vectors(spark, d).select("vec_id", V.total(y).alias("gated")), "gated")


@query
def softmax_xent(spark, d):
    return rounded(vectors(spark, d).select("vec_id", V.cross_entropy(F.col("embedding"), F.col("label") % 8).alias("loss"), V.argmax(F.col("embedding")).alias("top")), "loss")


@query
def causal_attention(spark, d):
    x = vectors(spark, d).select(F.floor(F.col("vec_id") / 16).cast("long").alias("sequence"), (F.col("vec_id") % 16).alias("pos"), "embedding", "label")
    return rounded(V.causal_attention(x, "sequence", "pos", "embedding", "label").select(F.col("s").alias("sequence"), F.col("q").alias("pos"), "attended", "n_keys"), "attended")


@query
def embedding_lookup(spark, d):
    tokens = docs(spark, d).select("doc_id", (F.col("doc_id") % 200).alias("token"))
    return V.embedding_lookup(tokens, vectors(spark, d).select(F.col("vec_id").alias("token"), "label")).select("doc_id", F.col("token").cast("long").alias("token"), F.col("label").cast("long").alias("label"))


# streaming form of the log means, run to completion on the batch table


@query
def streaming_means(spark, d):
    from corvane.streaming.logs import windowed_means

    return rounded(windowed_means(table(spark, d, "events"), "1 day"), "mean_value").select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", "mean_value")
