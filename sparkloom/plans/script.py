"""Queries of script conversion, tokenizer tables and syllable readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import diffs as D
from sparkloom.functions import script as S
from sparkloom.functions import text as X
from sparkloom.operators import tokenizer as O
from sparkloom.operators.dictionary import cut
from sparkloom.plans.fixture import LINES_SQL, READINGS_SQL, lines, readings
from sparkloom.sources.tables import table


def _written(spark, d):
    latin = F.regexp_replace(F.lower("ref"), "[^a-z ]", "")
    return lines(spark, d).select("page", "line_no", latin.alias("latin")).withColumn("script", S.script_of("latin"))


def _syllables(spark, d):
    """Syllable counts of the written lines: no syllable reaches beyond a space, so each different word is written once."""
    latin = F.regexp_replace(F.lower("ref"), "[^a-z ]", "")
    return O.syllable_counts(O.written_words(lines(spark, d).select(latin.alias("latin")), "latin", S.script_once), "script", "times")


def script_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Latin lines written in the script and read again; edits per character without glottal h."""
    r = _written(spark, d).withColumn("cer", X.roundtrip_cer(F.col("latin"), F.translate(S.latin_of("script"), "ê", "e")))
    return r.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("cer") <= 0.05).alias("passed"), F.count_if(X.is_well_formed(F.col("script"))).alias("well_formed"), F.max(X.longest_chain(F.col("script"))).alias("deepest"))


def script_syllables(spark: SparkSession, d: str) -> DataFrame:
    return _syllables(spark, d)


def tokenizer_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return O.vocabulary(lines(spark, d), "ref")


def tokenizer_encoded(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).withColumn("key", F.concat_ws("-", "page", "line_no"))
    out = O.encoded(rows, "key", "ref", O.vocabulary(rows, "ref"))
    return out.select("key", F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("digest"))


def reorder_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The reorder table of the written lines, with canonical orders of the taling signs as votes."""
    counts = cut(_syllables(spark, d))  # read four times
    order = X.canonical_permutation(F.col("syllable"), F.array(F.lit("ꦺ"), F.lit("ꦻ")))
    votes = counts.select("syllable", order.alias("perm"), F.lit(2).alias("votes")).unionByName(counts.select("syllable", F.sequence(F.lit(0), F.length("syllable") - 1).alias("perm"), F.lit(1).alias("votes")))
    table_ = O.reorder_table(counts, O.before_base(counts, O.consensus(votes)))
    return table_.select("pattern", "visual", F.array_join(F.transform("perm", lambda i: i.cast("string")), ",").alias("perm"), "n", "kept")


def syllable_segments(spark: SparkSession, d: str) -> DataFrame:
    r = readings(spark, d).withColumn("seg", D.syllable_diff("ref", "b"))
    whole = F.array_join(F.transform(F.filter("seg", lambda s: s["s"] != "del"), lambda s: s["t"]), "") == F.col("b")
    # `whole` beside the explode would be computed anew for each segment
    return r.withColumn("whole", whole).select("whole", F.explode("seg.s").alias("status")).groupBy("whole", "status").agg(F.count(F.lit(1)).alias("n"))


def segments_rebuild_text(spark: SparkSession, d: str) -> DataFrame:
    seg = D.syllable_diff("ref", "b")
    text = F.array_join(F.transform(F.filter(seg, lambda s: s["s"] != "del"), lambda s: s["t"]), "")
    return readings(spark, d).groupBy("lang").agg(F.count_if(text == F.col("b")).alias("same"))


def chrf_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return D.corpus_chrf(readings(spark, d), "lang", "ref", "a")


def rare_line_stats(spark: SparkSession, d: str) -> DataFrame:
    s = readings(spark, d).select("lang", D.rare_line_counts(F.col("ref"), F.col("a"), ["k", "v", "b"]).alias("s"))
    return s.groupBy("lang").agg(*[F.sum(f"s.{c}").alias(c) for c in ("ref", "hits", "emitted", "touched")])


def rare_reference_counts(spark: SparkSession, d: str) -> DataFrame:
    """As rare_line_stats, what needs no alignment: every character of the line and of the reading is in one step of it."""
    rare = ["k", "v", "b"]
    return readings(spark, d).groupBy("lang").agg(F.sum(D.occurrences(F.col("ref"), rare)).alias("ref"), F.sum(D.occurrences(F.col("a"), rare)).alias("emitted"))


def greedy_spans(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "events").select("user_id", "event_id", (F.length("event_type") % 4).alias("token"))
    return D.greedy_spans(frames, "user_id", "event_id", "token")


def spelling_standard(spark: SparkSession, d: str) -> DataFrame:
    w = _written(spark, d).select("page", "line_no", "script", X.standardize(F.col("script")).alias("standard"))
    return w.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("script") != F.col("standard")).alias("changed"), F.count_if(X.is_well_formed(F.col("standard"))).alias("well_formed"))


QUERIES = {f.__name__: f for f in (script_round_trip, script_syllables, tokenizer_vocabulary, tokenizer_encoded, reorder_patterns, syllable_segments, segments_rebuild_text, chrf_by_lang, rare_line_stats, rare_reference_counts, greedy_spans, spelling_standard)}
W = "WITH " + LINES_SQL
VOCAB = "v AS (SELECT ch, n, row_number() OVER (ORDER BY ch)::INT AS id FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(ref, '')) AS ch FROM lines) WHERE ch <> '' GROUP BY ch))"
ORACLE_SQL = {
    "tokenizer_vocabulary": W + f", {VOCAB} SELECT ch, n, id FROM v",
    "tokenizer_encoded": W + f", {VOCAB}, c AS (SELECT page || '-' || line_no AS key, unnest(string_split(ref, '')) AS ch, unnest(range(1, length(ref) + 1)) AS i FROM lines) SELECT key, md5(string_agg(id::VARCHAR, ',' ORDER BY i)) AS digest FROM c JOIN v USING (ch) GROUP BY key",
    "segments_rebuild_text": "WITH " + READINGS_SQL + " SELECT lang, count(*) AS same FROM rd GROUP BY lang",
    "chrf_by_lang": "WITH " + READINGS_SQL + """, t AS (SELECT lang, page, line_no, replace(ref, ' ', '') AS r, replace(a, ' ', '') AS h FROM rd),
g AS (SELECT lang, page, line_no, n, s, gram, count(*) AS c FROM (SELECT lang, page, line_no, n, 'r' AS s, substr(r, i, n) AS gram FROM t, range(1, 7) q(n), unnest(range(1, length(r) - n + 2)) z(i) UNION ALL SELECT lang, page, line_no, n, 'h', substr(h, i, n) FROM t, range(1, 7) q(n), unnest(range(1, length(h) - n + 2)) z(i)) GROUP BY ALL),
p AS (SELECT lang, n, sum(least(coalesce(cr, 0), coalesce(ch, 0))) AS cmn, sum(coalesce(cr, 0)) AS ref, sum(coalesce(ch, 0)) AS hyp FROM (SELECT lang, page, line_no, n, gram, sum(c) FILTER (s = 'r') AS cr, sum(c) FILTER (s = 'h') AS ch FROM g GROUP BY ALL) GROUP BY ALL),
m AS (SELECT lang, avg(cmn / hyp) AS p, avg(cmn / ref) AS r FROM p WHERE ref > 0 AND hyp > 0 GROUP BY lang)
SELECT lang, (SELECT count(*) FROM rd WHERE rd.lang = m.lang) AS lines, round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM m""",
    "rare_reference_counts": "WITH " + READINGS_SQL + " SELECT lang, sum(length(ref) - length(translate(ref, 'kvb', '')))::BIGINT AS ref, sum(length(a) - length(translate(a, 'kvb', '')))::BIGINT AS emitted FROM rd GROUP BY lang",
    "greedy_spans": "WITH f AS (SELECT user_id, event_id, length(event_type) % 4 AS token FROM events), m AS (SELECT *, CASE WHEN token IS DISTINCT FROM lag(token) OVER w THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM m) SELECT user_id, min(token)::INT AS token, min(event_id) AS first, max(event_id) AS last FROM i GROUP BY user_id, k HAVING min(token) <> 0",
}
