"""Queries of the small relational operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import composites as O
from sparkloom.sources.tables import table


def gate_problems(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("o_orderstatus") != "O", F.concat(F.lit("status "), F.col("o_orderstatus"))), (F.col("o_totalprice") > 300000, "price"), (F.col("o_orderpriority").startswith("5"), "priority")]
    return O.first_problem(table(spark, d, "orders"), "o_orderkey", rules)


def switch_violations(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("track"), (F.col("p_size") % 3).alias("track_prob"), (F.col("p_size") % 4).alias("track_max"), F.when(F.col("p_size") > 25, F.col("p_size") > 40).alias("slant"), F.when(F.col("p_size") > 45, 1).alias("slant_prob"))
    return O.switch_violations(runs, "p_partkey", {"track": ("track", ["track_prob", "track_max"]), "slant": ("slant", ["slant_prob"])})


def source_inputs(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    lines = n.select(F.col("n_nationkey").cast("long").alias("k"))
    preds = c.where("c_custkey < 20 or c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).otherwise("").alias("t"))
    return O.source_inputs(lines, "k", {"label": (n.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("t")), "t"), "model": (preds, "t")})


def reference_dump(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_shipdate")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_quantity")
    return O.with_reference(rows, refs, ["k", "n"], "l_shipdate").groupBy(F.col("reference").isNull().alias("missing")).agg(F.count(F.lit(1)).alias("n"), F.max("reference").alias("latest"))


def checkpoint_pairs(spark: SparkSession, d: str) -> DataFrame:
    return O.unordered_pairs(table(spark, d, "nation"), "n_name", "n_regionkey")


def sum_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return O.sum_by(table(spark, d, "orders").withColumn("one", F.lit(1)), "o_orderpriority", "one")


def counted_down(spark: SparkSession, d: str) -> DataFrame:
    return O.counted_down(table(spark, d, "documents"), "source")


def joined_texts(spark: SparkSession, d: str) -> DataFrame:
    return O.joined_texts(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


def value_spread(spark: SparkSession, d: str) -> DataFrame:
    return O.spread(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


def distinct_lists(spark: SparkSession, d: str) -> DataFrame:
    return O.distinct_list(table(spark, d, "documents"), "source", "lang")


def either_total(spark: SparkSession, d: str) -> DataFrame:
    return O.either_total(table(spark, d, "documents"), F.col("lang") == "en", F.col("n_chars") > 2000)


def inserted_after(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_name", "n_nationkey")
    more = table(spark, d, "region").select(F.concat(F.lit("new "), F.col("r_name")).alias("n_name"), F.col("r_regionkey").alias("n_nationkey"))
    return O.inserted_after(n, "n_name", "n_nationkey", more, n.where("n_nationkey = 7").first()["n_name"])


def long_metrics(spark: SparkSession, d: str) -> DataFrame:
    return O.long_metrics(table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.avg("l_discount"), 9).alias("x"), F.round(F.avg("l_tax"), 9).alias("y")), "l_linestatus", {"greedy": "x", "beam": "y"})


def method_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    kind = O.method_kind(F.when(F.col("p_size") % 3 != 0, F.col("p_size")), F.col("p_size") % 5, F.lit(2), F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    return p.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def step_evidence(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.avg("o_totalprice"), 3).alias("v"))
    return O.step_evidence(m, "o_orderpriority", "month", "v")


def best_report(spark: SparkSession, d: str) -> DataFrame:
    return O.best_report(table(spark, d, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand"], "p_size", "p_partkey")


def environment_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return O.fingerprint(table(spark, d, "nation"), "n_regionkey", "n_nationkey", "n_name")


def boundary_counts(spark: SparkSession, d: str) -> DataFrame:
    units = F.filter(F.split("text", "", -1), lambda c: c != "")
    return table(spark, d, "documents").select("doc_id", O.boundary_count(units).cast("long").alias("boundaries"))


def marked_texts(spark: SparkSession, d: str) -> DataFrame:
    return O.marked_texts(table(spark, d, "documents").select("doc_id", "text"), "text", "e", "éè").select("doc_id", F.col("marked").cast("long").alias("marked"), F.col("plain").cast("long").alias("plain"))


def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    return O.repeated(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_nationkey") % 4).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("turns"))


def training_schedule(spark: SparkSession, d: str) -> DataFrame:
    return O.schedule(table(spark, d, "documents"), "lang", "doc_id", 32, 3)


def gloss_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", O.gloss_text(F.array("p_type", "p_name")).alias("gloss"))


def signed_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", O.signed_points((F.col("l_discount") - F.col("l_tax"))).alias("points"))


QUERIES = {f.__name__: f for f in (gate_problems, switch_violations, source_inputs, reference_dump, checkpoint_pairs, sum_by_kind, counted_down, joined_texts, value_spread, distinct_lists, either_total, inserted_after, long_metrics, method_kinds, step_evidence, best_report, environment_fingerprints, boundary_counts, marked_texts, repeated_rows, training_schedule, gloss_texts, signed_points)}
ORACLE_SQL = {
    "gate_problems": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'status ' || o_orderstatus WHEN o_totalprice > 300000 THEN 'price' WHEN starts_with(o_orderpriority, '5') THEN 'priority' ELSE '' END AS problem FROM orders",
    "switch_violations": """WITH r AS (SELECT p_partkey, p_size % 2 = 0 AS t, p_size % 3 AS a, p_size % 4 AS b, coalesce(CASE WHEN p_size > 25 THEN p_size > 40 END, false) AS s, CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS c FROM part)
SELECT p_partkey, 'track declared, option off' AS problem FROM r WHERE t AND (a = 0 OR b = 0) UNION ALL SELECT p_partkey, 'track not declared, option on' FROM r WHERE NOT t AND (a <> 0 OR b <> 0)
UNION ALL SELECT p_partkey, 'slant declared, option off' FROM r WHERE s AND c = 0 UNION ALL SELECT p_partkey, 'slant not declared, option on' FROM r WHERE NOT s AND c <> 0""",
    "source_inputs": "SELECT n_nationkey::BIGINT AS k, 'label' AS source, n_name AS input FROM nation UNION ALL SELECT n_nationkey::BIGINT, 'model', c_name FROM nation JOIN customer ON c_custkey = n_nationkey WHERE (c_custkey < 20 OR c_acctbal > 0) AND c_custkey % 4 <> 0",
    "reference_dump": "WITH f AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS r FROM lineitem WHERE l_quantity > 30 GROUP BY ALL) SELECT r IS NULL AS missing, count(*) AS n, max(r) AS latest FROM lineitem LEFT JOIN f USING (l_orderkey, l_linenumber) GROUP BY 1",
    "checkpoint_pairs": "SELECT a.n_regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name",
    "sum_by_kind": "SELECT o_orderpriority, count(*)::BIGINT AS total FROM orders GROUP BY 1",
    "counted_down": "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)",
    "joined_texts": "SELECT conv_id, md5(t) AS digest, length(t) AS n FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS t FROM conversations GROUP BY 1)",
    "value_spread": "SELECT l_returnflag, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1",
    "distinct_lists": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS all FROM documents GROUP BY 1",
    "either_total": "SELECT count(*) FILTER (lang = 'en') AS a, count(*) FILTER (n_chars > 2000) AS b, count(*) FILTER (lang = 'en' OR n_chars > 2000) AS either FROM documents",
    "inserted_after": "SELECT n_name, row_number() OVER (ORDER BY g, o, n_name) AS place FROM (SELECT n_name, CASE WHEN n_nationkey <= 7 THEN 0 ELSE 2 END AS g, n_nationkey AS o FROM nation UNION ALL SELECT 'new ' || r_name, 1, r_regionkey FROM region)",
    "long_metrics": "WITH m AS (SELECT l_linestatus, round(avg(l_discount), 9) AS x, round(avg(l_tax), 9) AS y FROM lineitem GROUP BY 1) SELECT l_linestatus, 'greedy' AS name, x AS value FROM m UNION ALL SELECT l_linestatus, 'beam', y FROM m",
    "method_kinds": "SELECT CASE WHEN p_size % 3 <> 0 THEN CASE WHEN p_size % 5 = 2 THEN 'full' ELSE 'invalid' END WHEN p_size % 2 = 0 THEN 'partial' ELSE 'invalid' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "step_evidence": """WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 3) AS v FROM orders GROUP BY ALL), s AS (SELECT *, v - lag(v) OVER (PARTITION BY o_orderpriority ORDER BY month) AS d FROM m)
SELECT o_orderpriority, count(d) AS steps, arg_min(v, month) AS first, arg_max(v, month) AS last, round(arg_max(v, month) - arg_min(v, month), 4) AS change, arg_max(month, (d, month)) FILTER (d IS NOT NULL) AS steepest, round(max(d), 4) AS rise FROM s GROUP BY 1 HAVING count(d) > 0""",
    "best_report": "SELECT p_brand, p_size, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1",
    "environment_fingerprints": "SELECT n_regionkey, substr(sha256(string_agg(DISTINCT n_nationkey || '=' || n_name, chr(10) ORDER BY n_nationkey || '=' || n_name)), 1, 16) AS fingerprint FROM nation GROUP BY 1",
    "boundary_counts": "SELECT doc_id, len(list_filter(range(1, len(c)), lambda i: c[i] <> ' ' AND c[i + 1] <> ' ')) AS boundaries FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)",
    "marked_texts": "WITH n AS (SELECT doc_id, length(t) - length(translate(t, 'éè', '')) AS marked, length(t) - length(translate(t, 'e', '')) AS plain FROM (SELECT doc_id, lower(text) AS t FROM documents)) SELECT doc_id, marked, plain FROM n WHERE marked >= 10 AND marked >= 0.3 * greatest(1, marked + plain)",
    "repeated_rows": "SELECT s_nationkey, count(*) * (s_nationkey % 4) AS n, s_nationkey % 4 AS turns FROM supplier WHERE s_nationkey % 4 > 0 GROUP BY s_nationkey",
    "training_schedule": "SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || doc_id), doc_id) - 1) // 32 AS batch FROM documents",
    "gloss_texts": r"SELECT p_partkey, ' ' || trim(regexp_replace(lower(p_type || ' ' || p_name), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS gloss FROM part",
}
