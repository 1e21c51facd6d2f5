"""Readers of source trees, listings, evaluation sets and web pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.operators import filters

CORPUS = T.StructType([T.StructField("_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
QUERIES = T.StructType([T.StructField("_id", T.StringType()), T.StructField("text", T.StringType())])
QRELS = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("rel", T.IntegerType())])


def source_tree(spark: SparkSession, root: str, extensions: Sequence[str], ignore: Sequence[str] = (), tests: bool = True) -> DataFrame:
    """``path, mtime, size, content`` of the files below ``root``, their paths relative to it.

    The extensions reach the listing as a glob; ignored and test paths are filtered before contents are decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}").load(root)
    base = root.rstrip("/")
    path = F.regexp_replace("path", rf"^.*?\Q{base.split('://')[-1]}\E/", "")
    rows = files.select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content").where(~filters.is_ignored(F.col("path"), ignore, tests))
    if not tests:
        rows = rows.where(~filters.is_test_file(F.col("path")))
    return rows.withColumn("content", F.decode("content", "UTF-8"))


def listed(files: DataFrame, paths: Sequence[str] | None = None, after: str | None = None) -> DataFrame:
    """The files of an explicit list, or those after a cursor's path."""
    out = files if paths is None else files.where(F.col("path").isin(list(paths)))
    return out if after is None else out.where(F.col("path") > after)


def stale_reason(indexed: Column, same_path: Column, changes: Column, age_hours: Column, limit_hours: float = 24.0) -> Column:
    """Why an index has to be made anew: the first reason that holds, or null."""
    return F.when(~indexed, "no_index").when(~same_path, "path_mismatch").when(changes > 0, "files_changed").when(age_hours > limit_hours, "age_threshold").when(changes.isNull(), "check_failed")


def scan_order(files: DataFrame, centrality: DataFrame) -> DataFrame:
    """Files in the order of indexing: central ones first, then new ones, then by path."""
    return files.join(centrality, "path", "left").orderBy(F.coalesce("rank", F.lit(0.0)).desc(), F.col("mtime").desc(), "path")


def evaluation_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus and queries in JSON lines and relevance in tab-separated values, with a header."""
    return (
        spark.read.schema(CORPUS).json(f"{folder}/corpus.jsonl"), spark.read.schema(QUERIES).json(f"{folder}/queries.jsonl"),
        spark.read.schema(QRELS).option("sep", "\t").option("header", True).csv(f"{folder}/qrels"),
    )


def web_chunks(pages: DataFrame) -> DataFrame:
    """``page_id, line_start, line_end, label, content``: pages as Markdown, cut at headings."""
    md = pages.select("page_id", F.lit("page.md").alias("path"), text.markdown_column("html").alias("md"))
    return text.smart_chunks(md, "page_id", "path", "md")


def changed_files(diff: DataFrame, scope: str) -> DataFrame:
    """Changed paths of a scope (unstaged, staged, committed or all) that may be shown."""
    rows = diff if scope == "all" else diff.where(F.col("scope") == scope)
    return rows.where(~filters.is_secret_path(F.col("path"))).select("path").distinct()


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write Parquet, partitioned by columns such as project and generation; only partitions that are written are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
