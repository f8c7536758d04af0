"""Queries of the matrix of methods: readings of several sources, declared pairs and stages compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import matrix as O
from sparkloom.plans.fixture import READINGS_SQL, readings
from sparkloom.sources.tables import table

KINDS = ["print", "hand"]
#: Declared pairs (label, method, method that it is compared with) and stages (stage, methods, runs).
PAIRS = [("one", "first", "second"), ("new", "late", "first"), ("part", "partial", "second"), ("gone", "first", "absent")]
STAGES = [("base", "first", "second", "1", "2"), ("tuned", "late", "second", "3", "none"), ("cut", "partial", "first", "1", "2")]


def _lines(spark, d):
    kind = F.when(F.regexp_extract("source", r"(\d+)$", 1).cast("int") < 10, "print").otherwise("hand")
    return readings(spark, d).select(F.concat_ws("-", "page", "line_no").alias("line"), "page", kind.alias("kind"), "ref", "a", "b")


def _methods(spark, d):
    """Readings a, b and an early `late` by one source; a later `late` and a method that leaves out a third of the pages by another."""
    rows = _lines(spark, d)
    said = lambda **by: F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("text")) for m, c in by.items()]))
    other = rows.select("line", "page", said(late="b", partial="b")).where("method <> 'partial' or page % 3 <> 0")
    return O.united([rows.select("line", said(first="a", second="b", late="a")), other])


def methods_united(spark: SparkSession, d: str) -> DataFrame:
    """Lines and characters of each method out of all sources."""
    return _methods(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


def matrix_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rates and differences of the declared pairs, by kind."""
    rows = _lines(spark, d)
    return O.pair_rates(rows, O.scored(rows, _methods(spark, d)), PAIRS, KINDS)


def matrix_report(spark: SparkSession, d: str) -> DataFrame:
    """As matrix_pairs, with intervals of 10,000 resamples of the pages."""
    rows = _lines(spark, d)
    return O.pair_report(rows, O.scored(rows, _methods(spark, d)), PAIRS, KINDS)


def matrix_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages that both methods read whole, with the last value that each run logged."""
    rows = _lines(spark, d)
    logs = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "click", F.col("value")).alias("val"))
    return O.stage_rates(rows, O.scored(rows, _methods(spark, d)), STAGES, logs, KINDS)


QUERIES = {f.__name__: f for f in (methods_united, matrix_pairs, matrix_report, matrix_stages)}
UNITED = f"""WITH {READINGS_SQL}, r AS (SELECT page || '-' || line_no AS line, page, CASE WHEN regexp_extract(source, '(\\d+)$', 1)::INT < 10 THEN 'print' ELSE 'hand' END AS kind, ref, a, b FROM rd),
src AS (SELECT 0 AS s, 'first' AS method, line, a AS text FROM r UNION ALL SELECT 0, 'second', line, b FROM r UNION ALL SELECT 0, 'late', line, a FROM r UNION ALL SELECT 1, 'late', line, b FROM r UNION ALL SELECT 1, 'partial', line, b FROM r WHERE page % 3 <> 0),
u AS (SELECT method, line, text FROM src QUALIFY s = max(s) OVER (PARTITION BY method))"""


def _pairs_sql(pairs: list[tuple[str, str, str]]) -> str:
    declared = ", ".join(f"('{label}', '{a}', '{b}')" for label, a, b in pairs)
    shown = lambda c, name: f"CASE WHEN status = 'ok' THEN {c} END AS {name}"
    rates = ", ".join(shown(f"round({v}, 9)", n) for o, names in (("n", ("cer_a", "cer_b", "delta")), ("m", ("ned_a", "ned_b", "ned_delta"))) for v, n in zip((f"x.e / nullif(x.{o}, 0)", f"y.e / nullif(y.{o}, 0)", f"x.e / nullif(x.{o}, 0) - y.e / nullif(y.{o}, 0)"), names, strict=True))
    return f"""{UNITED}, e AS (SELECT method, page, kind, length(ref) AS n, greatest(length(ref), length(text)) AS m, levenshtein(ref, text) AS x FROM r JOIN u USING (line)),
ks AS (SELECT unnest(['print', 'hand', 'all']) AS kd), t AS (SELECT method, kd, count(*) AS lines, sum(n)::DOUBLE AS n, sum(m)::DOUBLE AS m, sum(x)::DOUBLE AS e FROM e JOIN ks ON kd IN (kind, 'all') GROUP BY ALL),
w AS (SELECT kd, count(r.line) AS lines, count(DISTINCT page) AS pages FROM ks LEFT JOIN r ON kd IN (kind, 'all') GROUP BY kd), p(label, a, b) AS (VALUES {declared}),
q AS (SELECT p.*, CASE WHEN x.lines IS NULL OR y.lines IS NULL THEN 'missing' WHEN x.lines < w.lines OR y.lines < w.lines THEN 'incomplete' ELSE 'ok' END AS status FROM p JOIN w ON w.kd = 'all' LEFT JOIN t x ON x.method = a AND x.kd = 'all' LEFT JOIN t y ON y.method = b AND y.kd = 'all'),
g AS (SELECT label, a, b, w.kd AS kind, status, {shown('w.lines', 'lines')}, {shown('w.pages', 'pages')}, {rates} FROM q CROSS JOIN w LEFT JOIN t x ON x.method = a AND x.kd = w.kd LEFT JOIN t y ON y.method = b AND y.kd = w.kd)"""


ORACLE_SQL = {
    "methods_united": f"{UNITED} SELECT method, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM u GROUP BY method",
    "matrix_pairs": f"{_pairs_sql(PAIRS)} SELECT * FROM g",
    "matrix_stages": f"""{_pairs_sql([s[:3] for s in STAGES])}, v AS (SELECT user_id::VARCHAR AS run, arg_max(value, event_id) AS val FROM events WHERE event_type = 'click' AND value IS NOT NULL GROUP BY 1),
s(stage, place, ra, rb) AS (VALUES {", ".join(f"('{s}', {i}, '{x}', '{y}')" for i, (s, _, _, x, y) in enumerate(STAGES))})
SELECT stage, place, g.* EXCLUDE (label, status), va.val AS val_a, vb.val AS val_b FROM g JOIN s ON stage = label LEFT JOIN v va ON va.run = ra LEFT JOIN v vb ON vb.run = rb WHERE status = 'ok'""",
}
