"""Corpus preparation end to end: scan, filter, fingerprint, dedup, split, count tokens, fill quotas, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions import text as X, tokens as K
from corvane.operators import checks, dedup, filters, quota, splits
from corvane.sources.readers import finished, index_digest
from corvane.sources.sinks import Corpus
from corvane.sources.storage import forget, settle


def visible(documents: DataFrame, source: Column | None = None, n_tokens: Column | None = None) -> DataFrame:
    """Eligible documents with ``source, seq, locator, fingerprint, split, n_tokens`` (end token included)."""
    good = documents.where(filters.eligible(F.col("text")))
    rows = good.select(
        (F.col("source") if source is None else source).alias("source"), F.col("doc_id").alias("seq"), F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("locator"),
        X.fingerprint(F.col("text")).alias("fingerprint"), ((X.n_pieces(F.col("text")) if n_tokens is None else n_tokens) + 1).cast("long").alias("n_tokens"),
    )
    return rows.withColumn("split", splits.document_split(F.col("fingerprint")))


def single_stream(documents: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """The index of one stream's corpus: first-wins dedup, quota fill per split, running offsets."""
    # the texts are read and normalised once; what follows works on narrow rows
    fresh = dedup.first_per_key(settle(visible(documents), "visible"), "fingerprint", "seq")
    return quota.offsets(quota.fill(fresh, budgets), ["seq"])


def by_source(documents: DataFrame, source: Column, names: list[str], budgets: dict[str, int]) -> DataFrame:
    """The index of several ordered sources, each with its own quotas."""
    return quota.offsets(quota.fill_sources(settle(visible(documents, source), "visible"), names, budgets), ["source", "seq"])


def source_counters(documents: DataFrame, source: Column, names: list[str], budgets: dict[str, int]) -> DataFrame:
    """One row per source of ``by_source``: its visited, filtered, duplicate and truncated documents, and the
    documents and tokens written to each split.

    A source is visited up to the document that fills its last quota. Duplicates are visited eligible documents whose
    fingerprint came before, in this source or in the visited part of an earlier one.
    """
    index = quota.fill_sources(settle(visible(documents, source), "visible"), names, budgets)
    count = lambda c, n=F.lit(1): F.sum(F.when(c, n).otherwise(0)).cast("long")
    part = lambda s: F.col("split") == s
    written = settle(
        index.groupBy("source").agg(
            F.max("seq").alias("stop"), count(F.col("truncated")).alias("truncated"),
            *(count(part(s)).alias(f"{s}_documents") for s in budgets), *(count(part(s), F.col("tokens")).alias(f"{s}_tokens") for s in budgets),
        ), "written",
    )
    rows = documents.select(source.alias("source"), F.col("doc_id").alias("seq"), F.coalesce(filters.eligible(F.col("text")), F.lit(False)).alias("good"), X.fingerprint(F.col("text")).alias("fingerprint"))
    seen = rows.join(written.select("source", "stop"), "source").where("seq <= stop")
    read = seen.groupBy("source").agg(F.count("*").alias("visited"), count(~F.col("good")).alias("filtered"))
    rank = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("source"))
    first = seen.where("good").groupBy("fingerprint").agg(F.min(F.struct(rank.alias("rank"), "source")).alias("at"))
    fresh = first.groupBy(F.col("at.source").alias("source")).agg(F.count("*").alias("fresh"))
    out = read.join(fresh, "source").join(written, "source")
    return out.select("source", "visited", "filtered", (F.col("visited") - F.col("filtered") - F.col("fresh")).alias("duplicates"), "truncated", *(f"{s}_{k}" for k in ("documents", "tokens") for s in budgets))


def prepare(documents: DataFrame, folder: str, budgets: dict[str, int], encode: Column | None = None, end: int = 0, tokenizer: str = "blank-separated", vocabulary: int = 1 << 20) -> DataFrame:
    """Write a corpus folder: document index, token arrays, raw parts, and a manifest with totals, digests and origin.

    ``encode`` gives the token ids of a text (the length of each blank-separated piece if not given); each document
    ends with ``end``, a cut one too. The manifest ends as complete, or as incomplete if anything fails.
    """
    spark = documents.sparkSession
    quota.validated(budgets)
    ids = F.transform(X.pieces(F.col("text")), lambda w: F.char_length(w)) if encode is None else encode
    with Corpus(spark, folder, tokenizer=tokenizer, vocabulary=vocabulary, budgets=budgets, end=end, documents=documents.inputFiles()[:100]) as out:
        rows = settle(visible(documents, n_tokens=F.size(ids)), "visible")
        index = settle(quota.require(quota.offsets(quota.fill(dedup.first_per_key(rows, "fingerprint", "seq"), budgets), ["seq"]), budgets), "index")
        out.write_index(index)
        # only documents of the index are encoded; the narrow side is joined by their ids
        texts = documents.select(F.col("doc_id").alias("seq"), "text").join(index.select("seq", "split", "start_token", "tokens"), "seq")
        out.write_tokens(texts.withColumn("ids", K.in_vocabulary(K.with_end(ids, end, F.col("tokens").cast("int")), vocabulary)))
        forget(rows, index)
        out.facts |= {"totals": out.totals(), "index": index_digest(spark.read.parquet(f"{folder}/documents"))}
    return spark.read.parquet(f"{folder}/documents")


def prepare_subset(parent: str, folder: str, spark: SparkSession, budget: int, tokenizer: str = "blank-separated", part: str = "train") -> DataFrame:
    """Write a corpus whose ``part`` is a prefix of the parent's; the other splits are copied, and both are verified.

    The cut document ends with the end token; each row keeps its place and length in the parent.
    """
    facts = finished(spark, parent, tokenizer)
    index, tokens = spark.read.parquet(f"{parent}/documents"), spark.read.parquet(f"{parent}/tokens")
    totals = spark.createDataFrame([(s, t["tokens"]) for s, t in facts["totals"].items()], "split string, tokens long")
    no(checks.index_faults(index, totals), "parent")
    if not 1 <= budget <= facts["budgets"][part]:
        raise quota.BudgetError(f"{budget} of {facts['budgets'][part]} tokens")
    budgets = facts["budgets"] | {part: budget}
    with Corpus(spark, folder, tokenizer=tokenizer, vocabulary=facts["vocabulary"], budgets=budgets, end=facts["end"], parent=parent, parent_index=facts["index"]) as out:
        small = settle(quota.require(quota.subset(index, budget, part), budgets), "subset")
        out.write_index(small)
        rows = tokens.join(small.select("split", "start_token", "tokens"), ["split", "start_token"])
        ids = F.when(F.size("ids") > F.col("tokens"), F.concat(F.slice("ids", F.lit(1), (F.col("tokens") - 1).cast("int")), F.array(F.lit(facts["end"])))).otherwise(F.col("ids"))
        out.write_tokens(rows.withColumn("ids", ids))
        child = spark.read.parquet(f"{folder}/documents")
        new = spark.createDataFrame(list(budgets.items()), "split string, tokens long")
        no(checks.index_faults(child, new), "subset")
        no(checks.reserved_faults(index, child.select(*index.columns), part), "reserved splits")
        no(checks.reserved_faults(tokens, spark.read.parquet(f"{folder}/tokens").select(*tokens.columns), part), "reserved tokens")
        no(checks.end_faults(spark.read.parquet(f"{folder}/tokens"), facts["end"]), "end tokens")
        forget(small)
        out.facts |= {"totals": out.totals(), "index": index_digest(child)}
    return child


def no(faults: DataFrame, where: str) -> None:
    """Raises if there are any faults."""
    found = faults.take(1)
    if found:
        raise ValueError(f"{where}: {found[0].asDict()}")


def prepare_code(files: DataFrame, prior: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """The code variant: eligibility with a parse, anti-join to a prior corpus before dedup, repository split."""
    good = filters.code_eligible(files).withColumn("fingerprint", X.fingerprint(F.col("content"))).withColumn("content_sha256", X.digest(F.col("content")))
    new = dedup.first_per_key(good.join(prior, "fingerprint", "left_anti"), "fingerprint", "seq")
    rows = new.withColumn("split", splits.repository_split(F.col("repo_name"))).withColumn("n_tokens", (X.n_pieces(F.col("content")) + 1).cast("long"))
    return quota.offsets(quota.fill(rows.drop("content"), budgets), ["seq"])
