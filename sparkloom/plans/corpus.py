"""Corpus queries over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import corpus as O
from sparkloom.plans.fixture import LINES_SQL, lines
from sparkloom.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def corpus_clean_words(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select("doc_id", X.clean_words(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n"), X.n_valid(F.col("w")).alias("valid"), F.md5(F.array_join(F.transform("w", lambda x: F.coalesce(x, F.lit("|"))), " ")).alias("digest"))


def corpus_paragraph_filter(spark: SparkSession, d: str) -> DataFrame:
    p = O.paragraphs(_docs(spark, d))
    return p.groupBy("doc").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(X.n_valid(F.col("words"))).alias("words"))


def corpus_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.md5_mod100(F.col("doc_id").cast("string")).alias("bucket"), X.split_of(F.col("doc_id")).alias("split"))


def corpus_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    seen = O.dedup_first(lines(spark, d), "ref", ["page", "line_no"])
    return seen.groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.count_if("first").alias("kept"), F.count_if(~F.col("first")).alias("duplicates"))


def corpus_split_leakage(spark: SparkSession, d: str) -> DataFrame:
    return O.leakage(lines(spark, d).select("ref", X.split_of(F.col("page")).alias("split")), "split", "ref")


def corpus_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return O.histogram_shares(O.length_histogram(lines(spark, d), "ref", 0))


def corpus_char_distribution(spark: SparkSession, d: str) -> DataFrame:
    return O.char_counts(_docs(spark, d), "text")


def _vocab(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.array_distinct(F.split("text", "", -1))).alias("ch")).where("ch <> ''").distinct()


def corpus_rare_chars(spark: SparkSession, d: str) -> DataFrame:
    return O.rare_chars(lines(spark, d), "ref", _vocab(spark, d), 0.01)


def corpus_deficits(spark: SparkSession, d: str) -> DataFrame:
    return O.deficits(lines(spark, d), "ref", _vocab(spark, d), 100)


def corpus_inject(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).withColumn("key", F.concat_ws("-", "page", "line_no"))
    return O.inject(rows, "ref", "key", _vocab(spark, d), 20)


def corpus_chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return O.chunk_lines(O.paragraphs(_docs(spark, d)))


def corpus_funnel(spark: SparkSession, d: str) -> DataFrame:
    seen = O.dedup_first(lines(spark, d), "ref", ["page", "line_no"])
    return O.funnel(O.paragraphs(_docs(spark, d)), seen)


def group_split_greedy(spark: SparkSession, d: str) -> DataFrame:
    groups = _docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return O.group_split(groups, "source", "n", 120, 120)


def ordered_sample(spark: SparkSession, d: str) -> DataFrame:
    return O.ordered_sample(_docs(spark, d).select("doc_id", "lang"), "doc_id", 50)


def syllable_counts(spark: SparkSession, d: str) -> DataFrame:
    """Units of texts by the syllable rule; out of the script each character with its marks is one."""
    units = _docs(spark, d).select("lang", F.explode(X.logical_syllables(F.col("text"))).alias("u"))
    return units.groupBy("lang").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("u").alias("kinds"))


def round_trip_rates(spark: SparkSession, d: str) -> DataFrame:
    back = F.replace(F.lower("ref"), F.lit("ha"), F.lit("a"))
    r = lines(spark, d).select("lang", X.roundtrip_cer(F.col("ref"), back).alias("cer"))
    return r.groupBy("lang").agg(F.count_if(F.col("cer") <= 0.05).alias("passed"), F.count(F.lit(1)).alias("lines"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.markup_to_text(F.col("html")).alias("text"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"))


QUERIES = {f.__name__: f for f in (corpus_clean_words, corpus_paragraph_filter, corpus_hash_split, corpus_dedup_first, corpus_split_leakage, corpus_length_histogram, corpus_char_distribution, corpus_rare_chars, corpus_deficits, corpus_inject, corpus_chunk_lines, corpus_funnel, group_split_greedy, ordered_sample, syllable_counts, round_trip_rates, html_to_text, sentence_counts)}
L = "WITH " + LINES_SQL
CLEAN = r"""list_transform(list_filter(string_split_regex(translate(text, 'åÅêÊôÔèÈ-–—/;!?"''“”‘’«»', 'aAeEoOéÉ    ,..'), '[\s\x0B\x1C-\x1F\x{85}\x{2028}\x{2029}\p{Zs}]+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_full_match(w, '[(]*[A-Z]{2,}[,.:)]*') THEN NULL WHEN regexp_full_match(lower(w), '[(]*[a-zé0-9]+[,.:)]*') THEN lower(w) END)"""
MOD = "((((('0x' || substr(md5(k), 1, 16))::UBIGINT % 100) * 16 + ('0x' || substr(md5(k), 17, 16))::UBIGINT % 100) % 100))::INT"
SPLIT = "CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'val' ELSE 'test' END"
PARS = f"pars AS (SELECT doc, {CLEAN} AS w FROM (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text FROM documents)), ok AS (SELECT doc, w, len(list_filter(w, lambda x: x IS NOT NULL)) AS n FROM pars WHERE len(list_filter(w, lambda x: x IS NOT NULL)) >= 5)"
VOCAB = "vocab AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark)"
FIRST = "seen AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY page, line_no) = 1 AS first FROM lines)"
ORACLE_SQL = {
    "corpus_clean_words": f"SELECT doc_id, len(w)::INT AS n, len(list_filter(w, lambda x: x IS NOT NULL))::INT AS valid, md5(array_to_string(list_transform(w, lambda x: coalesce(x, '|')), ' ')) AS digest FROM (SELECT doc_id, {CLEAN} AS w FROM documents)",
    "corpus_paragraph_filter": f"WITH {PARS} SELECT doc, count(*) AS paragraphs, sum(n)::BIGINT AS words FROM ok GROUP BY doc",
    "corpus_hash_split": f"SELECT doc_id, b AS bucket, {SPLIT} AS split FROM (SELECT doc_id, {MOD} AS b FROM (SELECT doc_id, doc_id::VARCHAR AS k FROM documents))",
    "corpus_dedup_first": L + f", {FIRST} SELECT lang, count(*) AS lines, count(*) FILTER (first) AS kept, count(*) FILTER (NOT first) AS duplicates FROM seen GROUP BY lang",
    "corpus_split_leakage": L + f", s AS (SELECT ref, {SPLIT} AS split FROM (SELECT ref, {MOD} AS b FROM (SELECT ref, page::VARCHAR AS k FROM lines))) SELECT ((SELECT count(*) FROM (SELECT ref FROM s WHERE split = 'train' INTERSECT SELECT ref FROM s WHERE split = 'val')) + (SELECT count(*) FROM (SELECT ref FROM s WHERE split = 'train' INTERSECT SELECT ref FROM s WHERE split = 'test')) + (SELECT count(*) FROM (SELECT ref FROM s WHERE split = 'val' INTERSECT SELECT ref FROM s WHERE split = 'test')))::BIGINT AS leaked",
    "corpus_length_histogram": L + ", h AS (SELECT b AS bucket, count(ref) AS lines FROM range(0, 80, 10) t(b) LEFT JOIN lines ON least(length(ref), 79) // 10 * 10 = b GROUP BY b) SELECT bucket, lines, round(lines / nullif(sum(lines) OVER (), 0)::DOUBLE, 9) AS share, round(lines * 100.0::DOUBLE / nullif(max(lines) OVER (), 0), 2) AS width FROM h",
    "corpus_char_distribution": "SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch",
    "corpus_rare_chars": L + f", {VOCAB}, f AS (SELECT ch, count(*) AS df FROM (SELECT unnest(list_distinct(string_split(ref, ''))) AS ch FROM lines) GROUP BY ch) SELECT ch, coalesce(df, 0) AS df FROM vocab LEFT JOIN f USING (ch) WHERE ch <> '' AND coalesce(df, 0) < (SELECT greatest(1, count(*)) FROM lines) * 0.01",
    "corpus_deficits": L + f", {VOCAB}, f AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(ref, '')) AS ch FROM lines) GROUP BY ch) SELECT ch, coalesce(n, 0) AS n, 100 - coalesce(n, 0) AS missing FROM vocab LEFT JOIN f USING (ch) WHERE ch <> '' AND coalesce(n, 0) < 100",
    "corpus_funnel": L + f", {FIRST}, {PARS} SELECT (SELECT count(DISTINCT doc) FROM ok) AS articles, (SELECT count(*) FROM ok) AS paragraphs, (SELECT sum(n) FROM ok)::BIGINT AS words, (SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM ok)) AS vocab, count(*) AS lines, count(*) FILTER (NOT first) AS duplicates, count(*) FILTER (first) AS kept FROM seen",
    "group_split_greedy": """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), o AS (SELECT *, md5('7:' || source) AS h FROM g),
a AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 120 AS test FROM o),
b AS (SELECT *, coalesce(sum(CASE WHEN test THEN 0 ELSE n END) OVER (ORDER BY h, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 120 AS val FROM a)
SELECT source, n, CASE WHEN test THEN 'test' WHEN val THEN 'val' ELSE 'train' END AS split FROM b""",
    "ordered_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 50",
    "round_trip_rates": "",
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
