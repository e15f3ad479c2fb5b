"""Loose files: web content and data folders as tables, and whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import first_of


def whole(spark: SparkSession, path: str) -> str | None:
    """A file's text, or None if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.text(path, wholetext=True).collect()[0][0]


def static_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, is_dir, data) of all files and folders under the given folders; an earlier folder's come first.

    Paths start with a slash at the folder. A folder that is not there has none.
    """
    tables = []
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(at):
            continue
        root = system.resolvePath(at).toString().rstrip("/")
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        bare = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
        path = F.substr(bare(F.col("path")), F.length(bare(F.lit(root))) + 1)
        files = rows.select(path.alias("path"), F.lit(False).alias("is_dir"), F.col("content").alias("data"))
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        parents = files.select(F.explode(above).alias("path")).where("path <> ''").distinct()
        tables.append(files.unionByName(parents.select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("binary").alias("data"))))
    return first_of(["path"], *tables) if tables else spark.createDataFrame([], "path string, is_dir boolean, data binary")
