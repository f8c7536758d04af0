"""Readers with explicit schemas and header checks; sinks; keyed upsert and partition replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources.derived import replace_all, write_report

__all__ = ["cache_merge", "content_key", "count_lines", "delimited", "json_document", "jsonl", "jsonl_tolerant", "markdown_rows", "name_facts", "parquet", "pending", "replace_all", "replace_partition", "reports", "table", "text_lines", "upsert", "write_delimited", "write_jsonl", "write_report", "write_sorted_gzip", "write_text", "xml_pages"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Column-pruned parquet."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, seq): lines in file order; seq rises with the place, with gaps."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("seq"))


def delimited(spark: SparkSession, path: str, fields: list[str], sep: str = "\t") -> DataFrame:
    """TSV or CSV, all strings, with a header that must hold `fields`; a byte order mark is dropped."""
    df = spark.read.csv(path, sep=sep, header=True, escape='"', multiLine=sep == ",")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return df.select(*fields)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines (also .gz) that must fit the schema; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, counts by status): lines that do not parse are counted as broken, not fatal."""
    wide = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    raw = spark.read.text(path).where(F.trim("value") != "")
    seen = raw.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    good = seen.where("r._broken is null").select(*[F.col("r")[f.name].alias(f.name) for f in schema])
    counts = seen.groupBy(F.when(F.col("r._broken").isNull(), "loaded").otherwise("broken").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return good, counts


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def xml_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the article pages of a wiki dump (also .bz2): namespace 0, no redirects."""
    schema = "title string, ns long, redirect struct<_title: string>, revision struct<text: string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.where("ns = 0 and redirect is null").select("title", F.col("revision.text").alias("text"))


def markdown_rows(spark: SparkSession, path: str, cells: int = 5) -> DataFrame:
    """Rows of a markdown table whose first cell is in back-ticks, as an array of trimmed cells."""
    parts = F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|", -1)
    rows = spark.read.text(path).where(F.trim("value").startswith("|")).select(F.transform(parts, lambda c: F.trim(c)).alias("cells"))
    return rows.where((F.size("cells") == cells) & F.col("cells")[0].rlike("^`.+`$"))


def reports(spark: SparkSession, pattern: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(one row per JSON document that matches a path pattern, with its path; counts by status): unreadable ones are counted, not lost."""
    own = T.StructType(list(schema.fields)) if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    wide = T.StructType([*own.fields, T.StructField("_broken", T.StringType())])
    raw = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    seen = raw.select("path", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._broken").isNotNull()
    good = seen.where(~bad).select(*[F.col("r")[f.name].alias(f.name) for f in own], "path")
    return good, seen.groupBy(F.when(bad, "broken").otherwise("loaded").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def name_facts(path: F.Column) -> list[F.Column]:
    """Order, rows and drop percentage out of names such as o6_n200_ds50_std10.pkl; null where a part is missing."""
    part = lambda p: F.nullif(F.regexp_extract(path, p, 1), F.lit("")).cast("int")
    return [part(r"(?:^|/)o(\d+)_").alias("order"), part(r"_n(\d+)_").alias("rows"), part(r"_ds(\d+)").alias("drop"), part(r"_std(\d+)").alias("std")]


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").json(path, compression="gzip" if gzip else None)


def write_sorted_gzip(df: DataFrame, path: str, *order: str) -> None:
    """One file in a fixed order, the same bytes for the same rows. For lexicons, not for corpora."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").json(path, compression="gzip")


def replace_partition(df: DataFrame, path: str, key: str) -> None:
    """Only the partitions that `df` holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], prune: bool = False) -> DataFrame:
    """Incoming rows, and old rows whose key is not among them unless `prune`. Null keys equal each other."""
    if prune:
        return new
    own = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys])
    match = None
    for k in keys:
        one = old[k].eqNullSafe(own[f"_n_{k}"])
        match = one if match is None else match & one
    return new.unionByName(old.join(own, match, "left_anti").select(*new.columns))


def content_key(*columns: str) -> F.Column:
    """sha256 of the canonical JSON of some columns: the key of a cache of results."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def pending(todo: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose result is not cached yet."""
    return todo.join(cache.select(key), key, "left_anti")


def cache_merge(old: DataFrame, new: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """Later records update earlier ones."""
    return old.unionByName(new).groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))
