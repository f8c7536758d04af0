"""Evaluation queries: error rates, paired counts, sign test, bootstrap intervals, alignment counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import alignment as A
from sparkloom.functions import metrics as M
from sparkloom.functions import stats as S
from sparkloom.operators import comparison as C
from sparkloom.operators import evaluation as O
from sparkloom.plans.fixture import READINGS_SQL, readings

R9 = lambda c: F.round(c, 9)
SUMMARY_SQL = "count(*) AS lines, round(sum(levenshtein(ref, a)) / greatest(1, sum(length(ref))), 9) AS cer, round(sum(levenshtein(ref, a)) / greatest(1, sum(greatest(length(ref), length(a)))), 9) AS ned, round(sum(levenshtein(ref, replace(a, ' ', ''))) / greatest(1, sum(length(ref))), 9) AS cer_no_space, round(avg((ref = a)::INT), 9) AS exact"


def eval_summary_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return O.summary_sets(readings(spark, d), ["lang"], "ref", "a")


def eval_summary_by_lang_source(spark: SparkSession, d: str) -> DataFrame:
    return O.summary_sets(readings(spark, d), ["lang", "source"], "ref", "a")


def eval_worst_lines(spark: SparkSession, d: str) -> DataFrame:
    return O.worst(readings(spark, d), "ref", "a", ["page", "line_no"])


def eval_gate_parts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.regexp_extract("source", r"(\d+)$", 1).cast("int") < 10, "print").otherwise("hand")
    return O.parts(readings(spark, d).withColumn("kind", kind), "kind", "page", "ref", "a")


def gate_report(spark: SparkSession, d: str) -> DataFrame:
    return O.gates(readings(spark, d), "ref", {"G1": ("a", 0.02), "G2": ("b", 0.12)})


def method_scores(spark: SparkSession, d: str) -> DataFrame:
    return O.method_scores(readings(spark, d), "page", "lang", "ref", {"first": "a", "second": "b"}, "first")


def paired_counts_lines(spark: SparkSession, d: str) -> DataFrame:
    return O.paired_lines(readings(spark, d), ["lang"], "ref", "a", "b")


def paired_counts_clusters(spark: SparkSession, d: str) -> DataFrame:
    return O.paired_clusters(readings(spark, d), "page", "ref", "a", "b")


def sign_test_pairs(spark: SparkSession, d: str) -> DataFrame:
    counts = O.paired_lines(readings(spark, d), ["lang"], "ref", "a", "b")
    return counts.select("lang", "a_better", "b_better", R9(S.sign_test("a_better", "b_better")).alias("p"))


def _sums(spark, d):
    n = F.length("ref").cast("long")
    return readings(spark, d).select("page", "source", "line_no", M.line_edits("ref", "a").alias("ea"), n.alias("na"), M.line_edits("ref", "b").alias("eb"), n.alias("nb"))


SUMS = ("ea", "na", "eb", "nb")


def bootstrap_ci_cluster(spark: SparkSession, d: str, reps: int = 10_000) -> DataFrame:
    return S.interval(S.bootstrap_multinomial(_sums(spark, d), "source", SUMS, reps))


def bootstrap_ci_stepwise(spark: SparkSession, d: str, reps: int = 10_000) -> DataFrame:
    return S.interval_stepwise(S.bootstrap_multinomial(_sums(spark, d), "source", SUMS, reps))


def bootstrap_ci_row(spark: SparkSession, d: str, reps: int = 10_000) -> DataFrame:
    """Interval of the difference by resampled lines: a matrix of weights per task, one row of sums per resample leaves it."""
    rows = _sums(spark, d).withColumn("unit", F.concat_ws("-", "page", "line_no"))
    sums = C.resampled(rows, "unit", "source", list(dict.fromkeys(SUMS)), reps).where("kind = 'lines'")
    diff = F.try_divide("ea", F.nullif("na", F.lit(0.0))) - F.try_divide("eb", F.nullif("nb", F.lit(0.0)))
    return S.interval(sums.select(diff.alias("diff")).where("diff is not null"))


def paired_integrity_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = readings(spark, d).select(F.concat_ws("-", "page", "line_no").alias("id"), "page", "ref", "a", "b")
    lines = rows.select("id", "ref")
    preds = rows.where("page % 7 <> 0").select("id", F.lit("a").alias("pipeline"), F.col("a").alias("text"), R9(M.line_cer("ref", "a")).alias("cer")).unionByName(rows.select("id", F.lit("b").alias("pipeline"), F.col("b").alias("text"), R9(M.line_cer("ref", "b") + F.when(F.col("page") % 11 == 0, 0.5).otherwise(0.0)).alias("cer")))
    preds = preds.unionByName(preds.where("pipeline = 'b' and id like '1-%'")).unionByName(spark.sql("SELECT 'ghost' AS id, 'a' AS pipeline, 'x' AS text, 0.0D AS cer"))
    return O.integrity_violations(lines, preds, "a", "b").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def confusion_chars(spark: SparkSession, d: str) -> DataFrame:
    return O.confusion(readings(spark, d), "ref", "a")


def align_recall_precision(spark: SparkSession, d: str) -> DataFrame:
    return O.recall_precision(readings(spark, d), "ref", "a")


def align_edit_identity(spark: SparkSession, d: str) -> DataFrame:
    ops = readings(spark, d).select("page", "line_no", M.edits("ref", "b").alias("distance"), A.n_edits(A.alignment(F.col("ref"), F.col("b"))).cast("long").alias("steps"))
    return ops.groupBy((F.col("distance") == F.col("steps")).alias("same")).agg(F.count(F.lit(1)).alias("lines"))


def gap_pairing(spark: SparkSession, d: str) -> DataFrame:
    return O.gap_pairing(readings(spark, d), ["lang"], "ref", "a")


def top_misreads(spark: SparkSession, d: str) -> DataFrame:
    return O.top_misreads(readings(spark, d), "ref", "a", 3)


def explorer_scores(spark: SparkSession, d: str) -> DataFrame:
    return O.explorer(readings(spark, d), 0, 40)


def beam_delta(spark: SparkSession, d: str) -> DataFrame:
    return O.delta_signs(readings(spark, d), ["lang"], "ref", "a", "b")


def dose_response(spark: SparkSession, d: str) -> DataFrame:
    return O.dose(readings(spark, d), "line_no", 5, "ref", "a", "b")


QUERIES = {f.__name__: f for f in (eval_summary_by_lang, eval_summary_by_lang_source, eval_worst_lines, eval_gate_parts, gate_report, method_scores, paired_counts_lines, paired_counts_clusters, sign_test_pairs, bootstrap_ci_cluster, bootstrap_ci_stepwise, bootstrap_ci_row, paired_integrity_violations, confusion_chars, align_recall_precision, align_edit_identity, gap_pairing, top_misreads, explorer_scores, beam_delta, dose_response)}
W = "WITH " + READINGS_SQL
PAIRS = "count(*) AS units, count(*) FILTER (x < y) AS a_better, count(*) FILTER (x > y) AS b_better, count(*) FILTER (x = y) AS ties"
PER_LINE = W + ", e AS (SELECT page, line_no, lang, source, levenshtein(ref, a) AS x, levenshtein(ref, b) AS y, length(ref) AS n FROM rd)"
DRAWS = """, u AS (SELECT source, sum(x) AS ea, sum(n) AS na, sum(y) AS eb, sum(n) AS nb FROM e GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS slot, count(*) OVER () AS n FROM u),
k AS (SELECT rep, ('0x' || substr(md5(concat_ws(':', rep, k)), 25, 8))::BIGINT % n AS slot FROM range(1, 10001) r(rep), (SELECT DISTINCT n FROM p), unnest(range(0, n)) t(k)),
diffs AS (SELECT rep, sum(ea)::DOUBLE / nullif(sum(na), 0) - sum(eb)::DOUBLE / nullif(sum(nb), 0) AS diff FROM k JOIN p USING (slot) GROUP BY rep)"""
ORACLE_SQL = {
    "eval_summary_by_lang": W + f" SELECT lang, {SUMMARY_SQL} FROM rd GROUP BY GROUPING SETS ((lang), ())",
    "eval_summary_by_lang_source": W + f" SELECT lang, source, {SUMMARY_SQL} FROM rd GROUP BY GROUPING SETS ((lang), (source), ())",
    "eval_worst_lines": W + ", t AS (SELECT page, line_no, ref, a AS hyp, levenshtein(ref, a) / greatest(1, length(ref)) AS q FROM rd ORDER BY q DESC, page, line_no LIMIT 20) SELECT page, line_no, ref, hyp, round(q, 9) AS cer FROM t WHERE ref <> hyp",
    "eval_gate_parts": W + " SELECT CASE WHEN regexp_extract(source, '(\\d+)$', 1)::INT < 10 THEN 'print' ELSE 'hand' END AS kind, round(sum(levenshtein(ref, a)) / greatest(1, sum(length(ref))), 9) AS cer, count(*) AS lines, count(DISTINCT page) AS pages, sum(length(ref))::BIGINT AS chars FROM rd GROUP BY 1",
    "gate_report": W + ", g AS (SELECT 'G1' AS code, round(sum(levenshtein(ref, a)) / greatest(1, sum(length(ref))), 9) AS value, 0.02::DOUBLE AS target FROM rd UNION ALL SELECT 'G2', round(sum(levenshtein(ref, b)) / greatest(1, sum(length(ref))), 9), 0.12::DOUBLE FROM rd) SELECT *, value < target AS passed FROM g",
    "method_scores": W + """, m AS (SELECT 'first' AS method, * FROM (SELECT page, lang, ref, a AS hyp FROM rd) UNION ALL SELECT 'second', * FROM (SELECT page, lang, ref, b AS hyp FROM rd)),
s AS (SELECT method, lang, count(*) AS lines, count(DISTINCT page) AS pages, sum(length(ref))::BIGINT AS chars, round(sum(levenshtein(ref, hyp)) / greatest(1, sum(length(ref))), 9) AS cer, round(sum(levenshtein(ref, hyp)) / greatest(1, sum(greatest(length(ref), length(hyp)))), 9) AS ned, round(avg((ref = hyp)::INT), 9) AS exact, round(avg((levenshtein(ref, hyp) >= length(ref))::INT), 9) AS collapsed FROM m GROUP BY method, lang)
SELECT s.*, round(s.cer - f.cer, 9) AS delta FROM s JOIN s f ON f.lang = s.lang AND f.method = 'first'""",
    "paired_counts_lines": PER_LINE + f" SELECT lang, {PAIRS} FROM e GROUP BY lang",
    "paired_counts_clusters": PER_LINE + f", c AS (SELECT page, sum(x) AS x, sum(y) AS y FROM e GROUP BY page) SELECT {PAIRS} FROM c",
    "sign_test_pairs": PER_LINE + """, c AS (SELECT lang, count(*) FILTER (x < y) AS a_better, count(*) FILTER (x > y) AS b_better FROM e GROUP BY lang)
SELECT lang, a_better, b_better, CASE WHEN a_better + b_better = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(a_better + b_better + 1) - lgamma(i + 1) - lgamma(a_better + b_better - i + 1) - (a_better + b_better) * ln(2))) FROM unnest(range(0, least(a_better, b_better) + 1)) t(i))), 9) END AS p FROM c""",
    "bootstrap_ci_cluster": PER_LINE + DRAWS + " SELECT round(quantile_cont(diff, 0.025), 9) AS low, round(quantile_cont(diff, 0.975), 9) AS high, round(coalesce(stddev_samp(diff), 0), 9) AS se, count(diff) AS valid FROM diffs",
    "bootstrap_ci_stepwise": PER_LINE + DRAWS + ", o AS (SELECT list(diff ORDER BY diff) AS v FROM diffs WHERE diff IS NOT NULL) SELECT round(v[floor(0.025 * (len(v) - 1))::INT + 1], 9) AS low, round(v[floor(0.975 * (len(v) - 1))::INT + 1], 9) AS high FROM o",
    "paired_integrity_violations": W + """, r AS (SELECT concat_ws('-', page, line_no) AS id, * FROM rd),
p0 AS (SELECT id, 'a' AS pipeline, round(levenshtein(ref, a) / greatest(1, length(ref)), 9) AS cer, a AS text FROM r WHERE page % 7 <> 0 UNION ALL SELECT id, 'b', round(levenshtein(ref, b) / greatest(1, length(ref)) + CASE WHEN page % 11 = 0 THEN 0.5 ELSE 0 END, 9), b FROM r),
p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE pipeline = 'b' AND id LIKE '1-%' UNION ALL SELECT 'ghost', 'a', 0.0, 'x'),
v AS (SELECT 'duplicate prediction' AS problem, id FROM (SELECT id, pipeline FROM p GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'duplicate line', id FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'unknown line', id FROM (SELECT DISTINCT id, pipeline FROM p) WHERE id NOT IN (SELECT id FROM r)
UNION ALL SELECT 'missing prediction', id FROM (SELECT id, x FROM r, (VALUES ('a'), ('b')) t(x)) q WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = q.id AND pipeline = q.x)
UNION ALL SELECT 'stored rate differs', p.id FROM p JOIN r USING (id) WHERE abs(cer - levenshtein(ref, text) / greatest(1, length(ref))) > 1e-6)
SELECT problem, count(*) AS n FROM v GROUP BY problem""",
    "explorer_scores": W + " SELECT page, line_no, lang, round(levenshtein(ref, a) / greatest(1, length(ref)), 9) AS a_cer, round(levenshtein(ref, b) / greatest(1, length(ref)), 9) AS b_cer, CASE WHEN ref = a THEN 'exact' WHEN ref = b THEN 'exact' ELSE 'wrong' END AS tag FROM rd WHERE strpos(ref, ',') > 0 ORDER BY a_cer - b_cer DESC, page, line_no LIMIT 40",
    "beam_delta": PER_LINE + " SELECT lang, count(*) FILTER (y < x) AS better, count(*) FILTER (y > x) AS worse, count(*) FILTER (y = x) AS same FROM e GROUP BY lang",
    "dose_response": PER_LINE + " SELECT least(line_no, 5) AS dose, count(*) AS lines, round(sum(x) / sum(n)::DOUBLE - sum(y) / sum(n)::DOUBLE, 9) AS diff, round(sum(x)::DOUBLE / nullif(sum(y), 0), 9) AS odds FROM e GROUP BY 1",
    "align_edit_identity": W + " SELECT true AS same, count(*) AS lines FROM rd",
}
