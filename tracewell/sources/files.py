"""File scans and report sinks: running lines of pages, JSON golden sets, CSV and JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def source_key(owner: Column, content: Column, extension: str) -> Column:
    return F.concat(F.lit("brd-sources/"), owner.cast("string"), F.lit("/"), F.sha2(content, 256), F.lit(extension))


def repeated_lines(lines: DataFrame, least_pages: int = 3, share: float = 0.4) -> DataFrame:
    """Lines (doc_id, page, line) without running headers and footers: prints of lines on too many pages."""
    mark = F.lower(F.trim(F.regexp_replace(F.regexp_replace("line", r"\d+", "#"), r"\s+", " ")))
    printed = lines.withColumn("print", mark)
    pages = printed.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    on = printed.groupBy("doc_id", "print").agg(F.countDistinct("page").alias("on"))
    running = on.join(pages, "doc_id").where((F.col("pages") >= least_pages) & (F.col("on") >= share * F.col("pages")))
    return printed.join(running.select("doc_id", "print"), ["doc_id", "print"], "left_anti").drop("print")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of golden sets: question, expected chunk ids, language, type; none expected: abstain."""
    schema = "owner_id long, project string, cases array<struct<question string, expect_chunk_ids array<long>, lang string, type string>>"
    cases = spark.read.schema(schema).json(path, multiLine=True).select("owner_id", "project", F.posexplode("cases").alias("case_no", "c"))
    expected = F.coalesce("c.expect_chunk_ids", F.array().cast("array<long>"))
    return cases.select("owner_id", "project", "case_no", "c.question", "c.lang", "c.type", expected.alias("expected"), (F.size(expected) == 0).alias("should_abstain"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
