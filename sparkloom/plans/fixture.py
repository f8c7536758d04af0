"""Evaluation lines out of the documents table and two corrupted readings of each.

The lines hold every text whole, wrapped at spaces. In SQL, edit distances are taken after the characters of a pair are renumbered, as
DuckDB's distance counts bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.tables import table


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(page, line_no, lang, source, ref) of every line of every text: longer ones are wrapped at spaces to 80 characters at most.

    A run of more than 80 characters without a space is cut at 80. Nothing goes but the space at a wrap; empty lines hold nothing.
    """
    parts = F.flatten(F.transform(F.split("text", "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(r"(?s)(.{1,80}(?= |\z)|.{1,80}) ?"), F.lit(1))))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page"), "lang", "source", F.posexplode(parts).alias("line_no", "ref"))
    return docs.where("ref <> ''").withColumn("line_no", F.col("line_no").cast("long"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """lines() and the readings a and b: some rows substituted, some with inserted, some with deleted characters."""
    h = F.md5(F.concat_ws(":", "page", "line_no"))
    x, y = F.substring(h, 1, 1), F.substring(h, 2, 1)
    ref = F.col("ref")
    put = lambda find, new: F.replace(ref, F.lit(find), F.lit(new))
    a = F.when(x < "8", F.translate(ref, "aeiou", "bcdfg")).when(x < "c", put("e", "ee")).otherwise(ref)
    b = F.when(y < "6", put("th", "")).when(y < "a", put(" ", "")).otherwise(ref)
    return lines(spark, d).withColumn("a", a).withColumn("b", b)


def by_characters(sql: str) -> str:
    """SQL with every edit distance of two texts taken by characters instead of bytes."""
    return _DISTANCE.sub(lambda m: _distance(m[1], m[2]), sql)


_DISTANCE = re.compile(r"levenshtein\((\w+), (\w+|replace\(\w+, ' ', ''\))\)")


def _distance(x: str, y: str) -> str:
    """Edit distance by characters: those of a pair are numbered from 1, at most 127 of them, so that each is one byte."""
    known = f"array_to_string(list_distinct(string_split({x} || {y}, '')), '')"
    numbers = "array_to_string(list_transform(range(1, 128), lambda i: chr(i::INT)), '')"
    return f"levenshtein(translate({x}, {known}, {numbers}), translate({y}, {known}, {numbers}))"


WRAP = r"(?s)(.{1,80})(?: |\z)|(.{1,80})"
LINES_SQL = rf"""lines AS (
  SELECT page, lang, source, (i - 1)::BIGINT AS line_no, ls[i] AS ref
  FROM (SELECT doc_id AS page, lang, source, flatten(list_transform(string_split(text, chr(10)), lambda s: list_transform(list_zip(regexp_extract_all(s, '{WRAP}', 1), regexp_extract_all(s, '{WRAP}', 2)), lambda p: coalesce(p[1], '') || coalesce(p[2], '')))) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(i)
  WHERE ls[i] <> ''
)"""
READINGS_SQL = (
    LINES_SQL
    + r""", keyed AS (SELECT *, md5(concat_ws(':', page, line_no)) AS h FROM lines), rd AS (
  SELECT page, line_no, lang, source, ref,
    CASE WHEN substr(h, 1, 1) < '8' THEN translate(ref, 'aeiou', 'bcdfg') WHEN substr(h, 1, 1) < 'c' THEN replace(ref, 'e', 'ee') ELSE ref END AS a,
    CASE WHEN substr(h, 2, 1) < '6' THEN replace(ref, 'th', '') WHEN substr(h, 2, 1) < 'a' THEN replace(ref, ' ', '') ELSE ref END AS b
  FROM keyed
)"""
)
