"""Scans: sharded JSON lines, code files, instruction files, token files, plans and event logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

DOCUMENT = "text string"
CODE = "content string, repo_name string, path string, license string, autogenerated boolean"
INSTRUCTION = "instruction string, context string, response string, category string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores where its files give fewer splits than there are cores; as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _numbered(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """``path, file, line_no, value``: the lines of all matching files, decompressed, numbered from 1.

    Files are read as streams, large plain ones in several splits; a first pass counts the lines of each split, which
    gives the number of its first line. Bytes that aren't UTF-8 are replaced.
    """
    found = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("lineSep", "\n").text(folder)
    own = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    starts = found.select(*own).groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rows = found.select(*own, F.make_valid_utf8(F.regexp_replace("value", "\r$", "")).alias("value"))
    line = (F.col("id") - F.col("first") + F.col("before") + 1).alias("line_no")
    return rows.join(starts, ["path", "block"]).select("path", F.element_at(F.split("path", "/"), -1).alias("file"), line, "value")


def tolerant(value: Column) -> Column:
    """The text of a JSON line; null for malformed lines, other values and missing or non-string text."""
    is_text = F.get_json_object(value, "$.text").isNotNull() & F.coalesce(F.schema_of_variant(F.try_parse_json(value)).contains("text: STRING"), F.lit(False))
    return F.when(is_text, F.get_json_object(value, "$.text"))


def json_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl.zst", source: str = "") -> DataFrame:
    """``source, seq, locator, text``: every line a document, bad ones with a null text; files in lexical order."""
    rows = _numbered(spark, folder, glob)
    locator = F.concat_ws(":", "file", F.col("line_no").cast("string"))
    order = rows.select("path").distinct().select("path", F.row_number().over(Window.orderBy("path")).alias("file_no"))  # one row per file
    return rows.join(order, "path").select(F.lit(source).alias("source"), (F.col("file_no") * F.lit(1 << 40) + F.col("line_no")).cast("long").alias("seq"), locator.alias("locator"), tolerant(F.col("value")).alias("text"))


def dropping_json_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl*") -> DataFrame:
    """The legacy scan: malformed lines and empty texts are left out."""
    return json_lines(spark, folder, glob).where("text is not null and text <> ''")


def code_files(spark: SparkSession, folder: str, glob: str = "*.json.gz") -> DataFrame:
    """Code documents with a locator; a malformed line fails the scan."""
    rows = _numbered(spark, folder, glob)
    parsed = F.from_json("value", CODE, {"mode": "FAILFAST"})
    return rows.select(parsed.alias("r"), F.concat_ws(":", "file", F.col("line_no").cast("string")).alias("locator")).select("r.*", "locator")


def instructions(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """Instruction rows with ``source_id``, the row number from 1."""
    return _numbered(spark, folder, glob).select(F.col("line_no").alias("source_id"), F.from_json("value", INSTRUCTION).alias("r")).select("source_id", "r.*")


def token_files(spark: SparkSession, path: str, vocabulary: int, least: int = 2) -> DataFrame:
    """``path, tokens, max_id, sha256`` of raw little-endian uint32 files; malformed files raise."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    for status in where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where):
        if status.isFile() and not status.getLen():  # Spark's file sources pass over empty files
            raise ValueError(f"{status.getPath()}: 0 bytes")
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                if content[:6] == b"\x93NUMPY":
                    raise ValueError(f"{name}: a NumPy container, not raw ids")
                if len(content) % 4 or len(content) < 4 * least:
                    raise ValueError(f"{name}: {len(content)} bytes")
                ids = np.frombuffer(content, "<u4")
                if int(ids.max()) >= vocabulary:
                    raise ValueError(f"{name}: id {int(ids.max())} outside the vocabulary")
                out.append((name, len(ids), int(ids.max()), hashlib.sha256(content).hexdigest()))
            yield pd.DataFrame(out, columns=["path", "tokens", "max_id", "sha256"])

    return files.mapInPandas(check, "path string, tokens long, max_id long, sha256 string")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of a JSON-lines log; a line that can't be read is tolerated only at the end."""
    rows = _numbered(spark, path, "*").select("line_no", "value", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    torn = rows.where("r._bad is not null and value <> ''").agg(F.min("line_no").alias("first_bad"), F.count("*").alias("bad")).first()
    last = rows.agg(F.max("line_no")).first()[0]
    if torn.bad > 1 or (torn.bad and torn.first_bad != last):
        raise ValueError(f"unreadable event in line {torn.first_bad} of {last}")
    return rows.where("r._bad is null and value <> ''").select("line_no", "r.*").drop("_bad")


def index_digest(index: DataFrame) -> str:
    """A digest of a document index that any change of a row changes: the sum of its rows' digests, as 15-digit numbers, and their count."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(index.columns))), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    got = index.agg(F.sum(row).cast("string"), F.count("*")).first()
    return f"{got[0]}:{got[1]}"


def finished(spark: SparkSession, folder: str, tokenizer: str) -> dict:
    """The manifest of a corpus that is complete, of this version and tokenizer, and whose index is the one it was written with."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
    if manifest.get("status") != "complete" or manifest.get("version") != 1 or manifest.get("tokenizer") != tokenizer:
        raise ValueError("the corpus can't be used")
    if manifest.get("index") != index_digest(spark.read.parquet(f"{folder}/documents")):
        raise ValueError("the corpus's index isn't the one of its manifest")
    return manifest


def prior_fingerprints(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """Distinct fingerprints of a finished corpus; its manifest must be complete and of the same tokenizer, its index unchanged."""
    finished(spark, folder, tokenizer)
    return spark.read.parquet(f"{folder}/documents").select("fingerprint").distinct()


def pinned(path: str, sha256: str) -> str:
    """The path of a tokenizer file whose content has this digest; raises if it hasn't."""
    import hashlib

    with open(path, "rb") as f:
        if hashlib.sha256(f.read()).hexdigest() != sha256:
            raise ValueError(f"{path} isn't the pinned file")
    return path


def encoder(path: str):
    """A pandas UDF that encodes texts with a tokenizer file; no truncation, no padding, no special tokens."""

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in texts:
            yield pd.Series([e.ids for e in tokenizer.encode_batch([t or "" for t in batch], add_special_tokens=False)])

    return encode


def round_trips(path: str):
    """A pandas UDF: whether decoding the encoded text gives the text back."""

    @F.pandas_udf("boolean")
    def same(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return pd.Series([tokenizer.decode(e.ids) == t for t, e in zip(texts, tokenizer.encode_batch(list(texts), add_special_tokens=False), strict=True)])

    return same
