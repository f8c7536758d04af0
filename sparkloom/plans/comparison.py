"""Queries of the report of two readings, over every line of every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import line_scores as L
from sparkloom.functions import spans as N
from sparkloom.operators import comparison as O
from sparkloom.operators import forms as R
from sparkloom.plans.fixture import READINGS_SQL, by_characters, readings
from sparkloom.sources.tables import table

#: What stands for rare characters, murda among them, the line opener and look-alikes in texts that are not in the script.
RARE, OPENER, PAIRS = ["x", "q", "z", "j", "ß", "É"], "D", (("e", "c"), ("o", "f"))
GROUPS = {"rare": RARE, "murda": ["z", "É"]}


def _scored(spark, d, lists: bool = False) -> DataFrame:
    rows = readings(spark, d).select(F.concat_ws("-", "page", "line_no").alias("id"), F.col("source").alias("cluster"), "ref", "a", "b")
    return O.scored(rows, RARE, GROUPS, OPENER, lists)


#: Columns of the counts that need no alignment, so that SQL can follow them.
COUNTED = ("lines", "clusters", "least_lines", "median_lines", "most_lines", "reference_chars", "lines_without_rare", "chars_without_rare", "exact_a", "exact_b", "lines_a_better", "lines_b_better", "lines_tie", "clusters_a_better", "clusters_b_better", "clusters_tie", "openers", "false_start_a", "false_start_b")


def compare_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.counts(_scored(spark, d)).select(*COUNTED)


def compare_openers(spark: SparkSession, d: str) -> DataFrame:
    return O.counts(_scored(spark, d)).select("openers", "opener_both", "opener_only_a", "opener_only_b", "opener_neither", "opener_p", "lines_p", "clusters_p")


def compare_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Nine ratios, each with intervals over 10,000 joint resamples of lines and of clusters."""
    return O.metrics(_scored(spark, d), list(GROUPS))


def compare_codepoints(spark: SparkSession, d: str) -> DataFrame:
    return O.codepoints(_scored(spark, d, lists=True), RARE)


def compare_lookalikes(spark: SparkSession, d: str) -> DataFrame:
    return O.lookalikes(readings(spark, d), PAIRS)


def plain_errors(spark: SparkSession, d: str) -> DataFrame:
    """Edits beside rare characters, by language."""
    rows = readings(spark, d).select("lang", L.plain_edits(F.col("ref"), F.col("a"), RARE).alias("n"))
    return rows.groupBy("lang").agg(F.sum("n").alias("plain_edits"), F.count_if(F.col("n") > 0).alias("lines"))


def rare_run(spark: SparkSession, d: str) -> DataFrame:
    return O.rare_run(readings(spark, d).select("ref", F.col("a").alias("hyp")), RARE, OPENER, PAIRS)


#: What stands for the spelling forms: single letters, and n before ch or ct.
RULES = {"single": {"é": "acute", "ç": "cedilla", "ü": "umlaut"}, "nasal": "n", "followers": ("ch", "ct")}


def _lines(spark, d) -> DataFrame:
    return readings(spark, d).select(F.concat_ws("-", "page", "line_no").alias("id"), F.col("source").alias("cluster"), "lang", "ref", "a", "b")


def form_report(spark: SparkSession, d: str) -> DataFrame:
    return R.run_report(_lines(spark, d), "ref", "a", **RULES)


def form_table(spark: SparkSession, d: str) -> DataFrame:
    return R.by_form(_lines(spark, d), "ref", "a", ("nya", "acute", "cedilla", "umlaut"), **RULES)


def form_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """As form_table, what needs no alignment: occurrences in the lines and in the reading."""
    return form_table(spark, d).select("form", "in_reference", "emitted")


def form_comparison(spark: SparkSession, d: str) -> DataFrame:
    return R.compared(_lines(spark, d), **RULES)


def inserted_marks(spark: SparkSession, d: str) -> DataFrame:
    """Letters e and b that a reading has and the line lacks, by language."""
    return R.inserted_marks(_lines(spark, d), ["lang"], "ref", "a", ["e"], ["b"])


def character_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """How often each accented Latin letter stands in the texts, absent ones included."""
    return N.catalogue(table(spark, d, "documents"), "text", 0xC0, 0xFF).select("ch", "code", "n")


QUERIES = {f.__name__: f for f in (form_report, form_table, form_occurrences, form_comparison, inserted_marks, character_catalogue, compare_counts, compare_openers, compare_metrics, compare_codepoints, compare_lookalikes, plain_errors, rare_run)}
_READ = "WITH " + READINGS_SQL
_EDITS = by_characters("levenshtein(ref, a) AS x, levenshtein(ref, b) AS y")
ORACLE_SQL = {
    "character_catalogue": "WITH k AS (SELECT chr(c::INT) AS ch, 'U+' || lpad(upper(to_hex(c)), 4, '0') AS code FROM range(192, 256) t(c)), f AS (SELECT unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT ch, count(*) AS n FROM f GROUP BY ch) SELECT ch, code, coalesce(n, 0) AS n FROM k LEFT JOIN n USING (ch)",
    "form_occurrences": _READ + """, f AS (SELECT * FROM (VALUES ('acute', 'é'), ('cedilla', 'ç'), ('umlaut', 'ü')) t(form, ch)), n AS (SELECT form, sum(length(ref) - length(replace(ref, ch, ''))) AS r, sum(length(a) - length(replace(a, ch, ''))) AS h FROM rd, f GROUP BY form
UNION ALL SELECT 'nya', sum(len(regexp_extract_all(ref, 'nch|nct'))), sum(len(regexp_extract_all(a, 'nch|nct'))) FROM rd) SELECT form, r::BIGINT AS in_reference, h::BIGINT AS emitted FROM n""",
    "compare_counts": _READ + f""", e AS (SELECT *, {_EDITS}, regexp_matches(ref, '[{"".join(RARE)}]') AS rare FROM rd), c AS (SELECT source, count(*) AS n, sum(x) AS x, sum(y) AS y FROM e GROUP BY source),
k AS (SELECT count(*) AS clusters, min(n) AS least_lines, median(n) AS median_lines, max(n) AS most_lines, count(*) FILTER (x < y) AS clusters_a_better, count(*) FILTER (x > y) AS clusters_b_better, count(*) FILTER (x = y) AS clusters_tie FROM c)
SELECT count(*) AS lines, any_value(clusters) AS clusters, any_value(least_lines) AS least_lines, any_value(median_lines) AS median_lines, any_value(most_lines) AS most_lines, sum(length(ref))::BIGINT AS reference_chars, count(*) FILTER (NOT rare) AS lines_without_rare,
  coalesce(sum(length(ref)) FILTER (NOT rare), 0)::BIGINT AS chars_without_rare, round(avg((ref = a)::INT), 9) AS exact_a, round(avg((ref = b)::INT), 9) AS exact_b, count(*) FILTER (x < y) AS lines_a_better, count(*) FILTER (x > y) AS lines_b_better, count(*) FILTER (x = y) AS lines_tie,
  any_value(clusters_a_better) AS clusters_a_better, any_value(clusters_b_better) AS clusters_b_better, any_value(clusters_tie) AS clusters_tie, count(*) FILTER (starts_with(ref, '{OPENER}')) AS openers,
  count(*) FILTER (NOT starts_with(ref, '{OPENER}') AND starts_with(ltrim(a), '{OPENER}')) AS false_start_a, count(*) FILTER (NOT starts_with(ref, '{OPENER}') AND starts_with(ltrim(b), '{OPENER}')) AS false_start_b
FROM e, k""",
}
