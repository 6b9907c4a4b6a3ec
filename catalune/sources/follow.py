"""Following a folder of library files: what changed since the last look is read again, the rest isn't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalune.operators.graphs import kept
from catalune.sources.libraries import files

SEEN = "path string, length long, modified timestamp, digest string"


def look(spark: SparkSession, root: str, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed files with content, paths that are gone, what is seen now).

    A file is read only if its time or size differs from what was seen; of those read, one whose content has the same
    digest is no change. ``seen`` is what the last look gave.
    """
    seen = spark.createDataFrame([], SEEN) if seen is None else seen
    listing = files(spark, root).select("path", "length", F.col("modificationTime").alias("modified"))
    same = listing.join(seen, ["path", "length", "modified"], "left_semi").select("path")
    content = files(spark, root).join(same, "path", "left_anti").select("path", "length", F.col("modificationTime").alias("modified"), "content")
    read = kept(content.withColumn("digest", F.sha2("content", 256)))
    changed = read.join(seen.select("path", "digest"), ["path", "digest"], "left_anti").select("path", "content")
    gone = seen.select("path").join(listing.select("path"), "path", "left_anti")
    still = seen.join(listing, ["path", "length", "modified"], "left_semi")
    return changed, gone, kept(still.unionByName(read.select(*still.columns)))
