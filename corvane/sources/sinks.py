"""Write-once outputs: document index, token files, manifest with a life cycle, event lines."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

INDEX = ["source", "seq", "locator", "fingerprint", "split", "start_token", "tokens", "original_tokens", "truncated", "parent_start_token", "parent_tokens", "repo_name", "path", "license", "content_sha256"]


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """Write to a temporary name, then rename over the old file: readers see the old file or the new one."""
    fs, final = _fs(spark, path)
    if not overwrite and fs.exists(final):
        raise FileExistsError(path)
    jvm = spark._jvm.org.apache.hadoop.fs
    temporary = jvm.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(temporary, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    rename = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    rename[0] = jvm.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(temporary), fs.makeQualified(final), rename)


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    """A small JSON file, a manifest for one, by way of the file system that holds it."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


class Corpus:
    """A corpus folder, written once. Its manifest says building, then complete, or incomplete after an error."""

    def __init__(self, spark: SparkSession, folder: str, **facts: Any) -> None:
        fs, where = _fs(spark, folder)
        if fs.exists(where):
            raise FileExistsError(folder)
        fs.mkdirs(where)
        self.spark, self.folder, self.facts = spark, folder, {"version": 1, **facts}

    def note(self, status: str, **more: Any) -> None:
        self.facts |= {"status": status, **more}
        write_text(self.spark, f"{self.folder}/manifest.json", json.dumps(self.facts, indent=1, sort_keys=True, allow_nan=False))

    def __enter__(self) -> Corpus:
        self.note("building")
        return self

    def __exit__(self, kind, error, trace) -> None:
        if error is not None:
            self.note("incomplete", error=kind.__name__)
        else:
            self.note("complete")

    def write_index(self, df: DataFrame) -> None:
        df.select(*[c for c in INDEX if c in df.columns]).write.mode("errorifexists").partitionBy("split").parquet(f"{self.folder}/documents")

    def write_tokens(self, df: DataFrame) -> None:
        """Token arrays ``split, start_token, ids``, by split and in order of ``start_token``; as raw parts beside them."""
        df.select("split", "start_token", "ids").repartitionByRange("split", "start_token").sortWithinPartitions("split", "start_token").write.mode("errorifexists").partitionBy("split").parquet(f"{self.folder}/tokens")
        raw_parts(self.spark.read.parquet(f"{self.folder}/tokens")).write.mode("errorifexists").partitionBy("split").parquet(f"{self.folder}/raw")

    def totals(self) -> dict[str, dict[str, Any]]:
        """Tokens, documents and a digest of each split's raw parts, in order, from what was written."""
        index = self.spark.read.parquet(f"{self.folder}/documents").groupBy("split").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
        digests = split_digests(self.spark.read.parquet(f"{self.folder}/raw"))
        return {r.split: {"tokens": r.tokens, "documents": r.documents, "sha256": r.sha256} for r in index.join(digests, "split").collect()}


#: Tokens of one raw part at most.
PART = 1 << 20


def raw_parts(df: DataFrame, size: int = PART) -> DataFrame:
    """``split, part, tokens, content``: the tokens of each split as little-endian uint32, ``size`` to a part.

    A document that crosses a border gives a slice to each part; a part is one row of ``4 * size`` bytes at most.
    """
    last = F.col("start_token") + F.size("ids") - 1
    cut = df.where(F.size("ids") > 0).withColumn("part", F.explode(F.sequence(F.floor(F.col("start_token") / size), F.floor(last / size))))
    low = F.greatest(F.col("part") * size - F.col("start_token"), F.lit(0))
    high = F.least((F.col("part") + 1) * size - F.col("start_token"), F.size("ids"))
    slices = cut.select("split", "part", (F.col("start_token") + low).alias("at"), F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("ids"))
    rows = slices.groupBy("split", "part").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            yield pd.DataFrame({"split": batch["split"], "part": batch["part"], "tokens": [len(x) for x in batch["ids"]], "content": [np.asarray(x, "<u4").tobytes() for x in batch["ids"]]})

    return rows.mapInPandas(pack, "split string, part long, tokens long, content binary")


def split_digests(raw: DataFrame) -> DataFrame:
    """``split, sha256``: the digest of the digests of a split's parts, in order; one short string a part."""
    parts = raw.select("split", "part", F.sha2("content", 256).alias("sha256"))
    return parts.groupBy("split").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda x: x["sha256"]), "\n"), 256).alias("sha256"))


def append_event(spark: SparkSession, folder: str, event: dict[str, Any]) -> None:
    """One event as a JSON line, printed as well; values that aren't finite are refused."""
    if any(isinstance(v, float) and not math.isfinite(v) for v in event.values()):
        raise ValueError("not finite")
    print(json.dumps(event, sort_keys=True, allow_nan=False), flush=True)
    spark.createDataFrame([(json.dumps(event, sort_keys=True, allow_nan=False),)], "value string").coalesce(1).write.mode("append").text(folder)


def private_and_public(records: DataFrame, private: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records with the private columns, and the same without them."""
    return records, records.drop(*private)


def instruction_rows(df: DataFrame) -> DataFrame:
    """The six fields that are written, and the split by which they are partitioned; raw text stays behind."""
    return df.select("ids", "prompt_tokens", "source_id", "category", "fingerprint", "group_key", *(["split"] if "split" in df.columns else []))
