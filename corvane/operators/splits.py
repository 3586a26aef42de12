"""Hash splits: independent of corpus size and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import text as X

# Buckets of 10 000 for train and dev; the rest is held out.
DOCUMENT, REPOSITORY, GROUP = (9_600, 200), (9_000, 500), (8_000, 1_000)


def split(key: Column, cuts: tuple[int, int] = DOCUMENT, salt: str = X.SALT) -> Column:
    b = X.bucket(key, salt)
    return F.when(b < cuts[0], "train").when(b < cuts[0] + cuts[1], "val").otherwise("holdout")


def document_split(fingerprint: Column) -> Column:
    return split(fingerprint, DOCUMENT)


def repository_split(name: Column) -> Column:
    return split(X.casefold(name), REPOSITORY)


def group_split(key: Column) -> Column:
    return split(key, GROUP)


def leaks(df: DataFrame, key: str, part: str = "split") -> DataFrame:
    """Keys that occur in more than one split; empty if the splits are disjoint."""
    return df.groupBy(key).agg(F.min(part).alias("first_split"), F.max(part).alias("last_split")).where("first_split <> last_split")
