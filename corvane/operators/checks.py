"""Integrity checks. Each returns its violations; an empty result passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators.quota import gaps
from corvane.operators.splits import leaks


def manifest_faults(manifest: DataFrame, tokenizer: str, vocabulary: int, version: int = 1) -> DataFrame:
    return manifest.where(~((F.col("status") == "complete") & (F.col("version") == version) & (F.col("tokenizer") == tokenizer) & (F.col("vocabulary") == vocabulary)))


def file_faults(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose size isn't four bytes a token, or whose hash differs."""
    both = expected.join(files.select(F.col("path"), "length", F.col("sha256").alias("found")), "path", "left")
    return both.where((F.coalesce("length", F.lit(-1)) != 4 * F.col("tokens")) | ~F.col("found").eqNullSafe(F.col("sha256")))


def index_faults(index: DataFrame, totals: DataFrame) -> DataFrame:
    """``fault, item``: gaps in offsets, repeated fingerprints, and totals that differ from the manifest's."""
    broken = gaps(index).select(F.lit("gap").alias("fault"), F.concat_ws(":", "split", F.col("start_token").cast("string")).alias("item"))
    twice = index.groupBy("fingerprint").count().where("count > 1").select(F.lit("repeated").alias("fault"), F.col("fingerprint").alias("item"))
    sums = index.groupBy("split").agg(F.sum("tokens").alias("have"))
    off = totals.join(sums, "split", "full_outer").where(~F.col("tokens").eqNullSafe(F.col("have"))).select(F.lit("total").alias("fault"), F.col("split").alias("item"))
    return broken.unionByName(twice).unionByName(off)


def end_faults(documents: DataFrame, end: int) -> DataFrame:
    """Train documents that don't end with the end token."""
    return documents.where((F.col("split") == "train") & ~F.element_at("ids", -1).eqNullSafe(end))


def reserved_faults(parent: DataFrame, child: DataFrame, part: str = "train") -> DataFrame:
    """Rows of the reserved splits that parent and child don't share."""
    a, b = (df.where(F.col("split") != part) for df in (parent, child))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def instruction_faults(rows: DataFrame, end: int, vocabulary: int, most: int) -> DataFrame:
    """``fault, item`` of encoded instruction rows with a ``split``."""
    n = F.size("ids")
    tests = {
        "length": ~n.between(2, most),
        "boundary": ~F.col("prompt_tokens").between(1, n - 1),
        "end": ~F.element_at("ids", -1).eqNullSafe(end),
        "range": (F.array_min("ids") < 0) | (F.array_max("ids") >= vocabulary),
    }
    names = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in tests.items())), lambda x: x.isNotNull())
    single = rows.select(F.explode(names).alias("fault"), F.col("source_id").cast("string").alias("item"))
    twice = rows.groupBy("fingerprint").count().where("count > 1").select(F.lit("repeated").alias("fault"), F.col("fingerprint").alias("item"))
    crossing = leaks(rows, "group_key").select(F.lit("group").alias("fault"), F.col("group_key").alias("item"))
    return single.unionByName(twice).unionByName(crossing)


def holdout_faults(holdout: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("group_key", "fingerprint", "source_id")) -> DataFrame:
    """Keys of the holdout that train or dev hold as well."""
    out = None
    for k in keys:
        own = holdout.select(F.lit(k).alias("key"), F.col(k).cast("string").alias("item")).join(seen.select(F.col(k).cast("string").alias("item")), "item", "left_semi")
        out = own if out is None else out.unionByName(own)
    return out


def control_faults(measured: DataFrame, expected: DataFrame, key: str, tolerance: float) -> DataFrame:
    both = measured.join(expected.select(key, F.col("loss").alias("expected_loss"), F.col("scored_tokens").alias("expected_tokens")), key, "full_outer")
    bad = F.isnan("loss") | (F.abs(F.col("loss") - F.col("expected_loss")) > tolerance) | (F.col("scored_tokens") != F.col("expected_tokens"))
    return both.where(F.coalesce(bad, F.lit(True)))


def coverage_faults(scored: DataFrame, index: DataFrame) -> DataFrame:
    """Splits whose scored targets aren't their tokens less one."""
    have = index.groupBy("split").agg((F.sum("tokens") - 1).alias("expected"))
    return have.join(scored, "split", "left").where(~F.col("scored_tokens").eqNullSafe(F.col("expected")))


def alias_faults(spark: SparkSession, totals: dict[str, dict]) -> DataFrame:
    """``fault, item``: splits whose content is another split's under a second name."""
    rows = spark.createDataFrame([(s, t["sha256"]) for s, t in totals.items()], "split string, sha256 string")
    return rows.groupBy("sha256").agg(F.count("*").alias("n"), F.min("split").alias("item")).where("n > 1").select(F.lit("alias").alias("fault"), "item")


def distinct_paths(train: str, val: str) -> None:
    """Raises if both paths name one file, however they are spelled."""
    spark = SparkSession.active()

    def status(path: str) -> str:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).resolvePath(where).toString()

    if train == val or status(train) == status(val):
        raise ValueError("train and dev are the same file")


def audit_report(report: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """``key, column``: figures of a published report that recomputing doesn't give."""
    names = [c for c in report.columns if c != key]
    both = report.join(recomputed.select(key, *(F.col(c).alias(f"__{c}") for c in names)), key, "full_outer")
    wrong = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in names)), lambda x: x.isNotNull())
    return both.select(key, F.explode(wrong).alias("column"))


def table_mark(df: DataFrame) -> DataFrame:
    """A row that changes if a table does: its count and the sum of its rows' hashes."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("mark"))


def proportion_faults(train: DataFrame, dev: DataFrame, task: str, answer: str) -> DataFrame:
    """Answers whose share differs between train and dev, by cross multiplication."""
    def counts(df: DataFrame, n: str) -> DataFrame:
        by = df.groupBy(task, answer).agg(F.count("*").alias(n))
        return by.join(df.groupBy(task).agg(F.count("*").alias(f"{n}_all")), task)

    both = counts(train, "t").join(counts(dev, "d"), [task, answer], "full_outer")
    return both.where(~(F.col("t") * F.col("d_all")).eqNullSafe(F.col("d") * F.col("t_all"))).select(task, answer)
