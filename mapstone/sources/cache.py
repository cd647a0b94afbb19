"""Content-addressed cache of per-file facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Raised whenever extraction gives other facts for the same source.
EXTRACTOR_VERSION = 1


def facts_key(path: str, content: str) -> Column:
    """Digest of the extractor's version, the path and the source."""
    return F.sha1(F.concat_ws("\n", F.lit("mapstone-facts"), F.lit(str(EXTRACTOR_VERSION)), F.col(path), F.col(content)).cast("binary"))


def misses(files: DataFrame, kept: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files whose facts are not kept (kept: key)."""
    return files.withColumn("key", facts_key(path, content)).join(kept.select("key"), "key", "left_anti")


def hits(files: DataFrame, kept: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Kept facts of the files (kept: key and facts)."""
    return files.withColumn("key", facts_key(path, content)).drop(content).join(kept, "key")
