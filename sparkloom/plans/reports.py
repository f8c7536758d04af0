"""Queries of validation, selection and usage operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import metrics as M
from sparkloom.operators import lineage as G
from sparkloom.operators import reports as O
from sparkloom.plans.fixture import READINGS_SQL, readings
from sparkloom.sources.tables import table


def label_violations(spark: SparkSession, d: str) -> DataFrame:
    """How many keys and whole texts have each problem."""
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 50 == 0, "").otherwise((F.col("doc_id") / 3).cast("int").cast("string")).alias("key"), F.when(F.col("doc_id") % 40 == 1, "").otherwise(F.col("text")).alias("text"))
    return O.label_violations(rows, "key", "text", "ꦀ-꧟ -~\\n").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def slant_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_discount") * 4).alias("v"), "l_quantity")
    return O.in_ranges(rows, "v", list(O.SLANTS)).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


def line_tags(spark: SparkSession, d: str) -> DataFrame:
    t = O.tags(short=F.length("ref") < 40, comma=F.col("ref").contains(","), exact=F.col("ref") == F.col("a"))
    return readings(spark, d).select(F.array_join(t, "+").alias("tags")).groupBy("tags").agg(F.count(F.lit(1)).alias("n"))


def matrix_violations(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_size", (F.col("p_size") / 40).alias("v"), (F.col("p_size") / 50).alias("lo"), F.when(F.col("p_partkey") % 4 == 0, 0.1).otherwise(2.0).alias("hi"))
    known = p.where("p_brand <> 'Brand#7'").select("p_brand").distinct()
    return O.interval_violations(p, ["p_brand", "p_size"], "lo", "v", "hi", known).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def review_import(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    reviews = c.where("c_custkey % 2 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, "benar").otherwise("koreksi").alias("status"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).otherwise("").alias("text"))
    return O.review_import(c.select("c_custkey", F.col("c_name").alias("draft")), reviews, "c_custkey")


def pending_conditions(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "nation").select("n_nationkey")
    grid = table(spark, d, "region").select("r_regionkey")
    cache = lines.crossJoin(grid).where("(n_nationkey + r_regionkey) % 3 = 0")
    return O.pending_conditions(lines, grid, cache, ["n_nationkey", "r_regionkey"])


def nearest_valid(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 0, F.col("n_nationkey") - 1 - F.col("n_nationkey") % 2).alias("parent"))
    valid = n.where("n_nationkey % 4 = 1 or n_nationkey = 0").select(F.col("n_nationkey").alias("_valid"))
    return O.nearest_valid(G.ancestry(n, "n_nationkey", "parent").where("status = 'ok'"), valid, "node", "ancestor", "distance")


def homoglyph_table(spark: SparkSession, d: str) -> DataFrame:
    """Look-alike substitutions of all readings, those with inserted characters too."""
    return O.homoglyphs_read(readings(spark, d), "ref", "a", [("a", "b"), ("e", "c"), ("x", "y")])


def subpopulation_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = readings(spark, d).select("lang", "ref", M.edits("ref", "a").alias("e"), F.length("ref").alias("n"))
    return O.subpopulation(rows, "lang", F.col("ref").contains(","), "e", "n")


def best_setting(spark: SparkSession, d: str) -> DataFrame:
    return O.best_setting(table(spark, d, "part").where("p_size > 2"), "p_retailprice", "p_partkey", ["p_brand"])


def run_usage(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") * 10).cast("long").alias("step"), (F.col("event_type") == "view").alias("start"))
    seg = G.segments(log, "user_id", ["ts", "event_id"], "step", "start", 400).select("user_id", "first", "last", F.lit(16).alias("batch"), F.lit(20000).alias("pool"))
    return O.usage(seg, "user_id", "batch", "pool")


def warm_mean(spark: SparkSession, d: str) -> DataFrame:
    return O.warm_mean(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


def estimate_full(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select("p_brand", "p_size", "p_retailprice")
    grid = m.select("p_brand").distinct().crossJoin(spark.range(1, 60, 10).select(F.col("id").cast("int").alias("p_size"), (F.col("id") % 7).alias("times")))
    return O.estimate_full(m, grid, "p_brand", "p_size", "p_retailprice")


def cumulative_configs(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region as parts that are switched on one after another."""
    per = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("ops"))
    steps = per.select("n_regionkey", "ops", F.explode(F.sequence(F.lit(0), F.size("ops"))).alias("step"))
    return steps.select("n_regionkey", F.col("step").cast("long").alias("step"), O.cumulative_config(F.col("ops"), F.col("step")).alias("config"))


def last_validation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("val"))
    return O.last_value(e, "user_id", "val", "event_id")


def stale_cards(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 > 0, F.col("n_regionkey").cast("string")).alias("run"))
    current = O.official(table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("run"), (F.col("r_regionkey") > 1).alias("flag")), "flag", "run", "9")
    return O.stale(n, current, "run", "run")


def name_entries(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised words of all languages and all letters, and whether they also stand in lower case."""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))).alias("at", "word"))
    return O.name_entries(words.withColumn("spelling", F.reverse("word")), "word", "spelling", "[kvb]", "doc_id").select("name", "ordinary")


def wiki_text(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("== Java ==\n=== Noun ===\n# a [[link|shown]] of {{t|{{u}}}}'''"), F.col("r_name"), F.lit("'''\n#* not this\n# [[two]]<ref>x</ref>\n== Other ==\n# three"))
    return O.wiki_senses(table(spark, d, "region").select("r_name", body.alias("src")), "r_name", "src")


QUERIES = {f.__name__: f for f in (label_violations, slant_groups, line_tags, matrix_violations, review_import, pending_conditions, nearest_valid, homoglyph_table, subpopulation_rates, best_setting, run_usage, warm_mean, estimate_full, cumulative_configs, last_validation, stale_cards, name_entries, wiki_text)}
RD = "WITH " + READINGS_SQL
SEGMENTS_SQL = """log AS (SELECT event_id, user_id, ts, trunc(value * 10)::BIGINT AS step, event_type = 'view' AS start FROM events), s AS (SELECT *, count(*) FILTER (start) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM log),
e AS (SELECT user_id, segment, min(step) FILTER (start) AS first, max(step) AS last FROM s WHERE segment > 0 GROUP BY ALL),
l AS (SELECT user_id, first, least(last, 400, coalesce(min(first) OVER (PARTITION BY user_id ORDER BY segment ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 9223372036854775807)) AS last FROM e)"""
ORACLE_SQL = {
    "label_violations": "WITH r AS (SELECT CASE WHEN doc_id % 50 = 0 THEN '' ELSE (doc_id // 3)::VARCHAR END AS k, CASE WHEN doc_id % 40 = 1 THEN '' ELSE text END AS t FROM documents), p AS (SELECT 'blank key' AS problem FROM r WHERE k = '' UNION ALL SELECT 'repeated key' FROM r WHERE k <> '' AND k IN (SELECT k FROM r GROUP BY k HAVING count(*) > 1) UNION ALL SELECT 'empty text' FROM r WHERE coalesce(t, '') = '' UNION ALL SELECT 'unknown characters' FROM r WHERE regexp_matches(t, '[^\\x{A980}-\\x{A9DF} -~\\n]')) SELECT problem, count(*) AS n FROM p GROUP BY 1",
    "slant_groups": "SELECT CASE WHEN l_discount * 4 < 0.1 THEN 'upright' WHEN l_discount * 4 < 0.3 THEN 'slanted' ELSE 'steep' END AS grp, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1",
    "line_tags": RD + " SELECT array_to_string(list_filter([CASE WHEN length(ref) < 40 THEN 'short' END, CASE WHEN contains(ref, ',') THEN 'comma' END, CASE WHEN ref = a THEN 'exact' END], lambda x: x IS NOT NULL), '+') AS tags, count(*) AS n FROM rd GROUP BY 1",
    "matrix_violations": "WITH p AS (SELECT p_brand, p_size, p_size / 40 AS v, p_size / 50 AS lo, CASE WHEN p_partkey % 4 = 0 THEN 0.1 ELSE 2.0 END AS hi, count(*) OVER (PARTITION BY p_brand, p_size) AS c FROM part), q AS (SELECT 'repeated' AS problem FROM p WHERE c > 1 UNION ALL SELECT 'out of range' FROM p WHERE v NOT BETWEEN 0 AND 1 UNION ALL SELECT 'interval' FROM p WHERE lo > hi OR v NOT BETWEEN lo AND hi UNION ALL SELECT 'unknown' FROM p WHERE p_brand = 'Brand#7') SELECT problem, count(*) AS n FROM q GROUP BY 1",
    "review_import": "WITH v AS (SELECT c_custkey * 2 AS k, CASE WHEN c_custkey % 3 = 0 THEN 'benar' ELSE 'koreksi' END AS status, CASE WHEN c_custkey % 10 <> 0 THEN c_name ELSE '' END AS text FROM customer WHERE c_custkey % 2 = 0) SELECT CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN status = 'benar' THEN 'confirmed' WHEN status = 'koreksi' AND text <> '' THEN 'corrected' WHEN status IS NULL THEN 'open' ELSE 'excluded' END AS outcome, count(*) AS n FROM customer FULL JOIN v ON c_custkey = k GROUP BY 1",
    "pending_conditions": "SELECT n_nationkey, r_regionkey FROM nation, region WHERE (n_nationkey + r_regionkey) % 3 <> 0",
    "nearest_valid": "WITH RECURSIVE n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey > 0 THEN n_nationkey - 1 - n_nationkey % 2 END AS p FROM nation), c AS (SELECT k AS node, k AS ancestor, 0 AS distance FROM n UNION ALL SELECT c.node, n.p, c.distance + 1 FROM c JOIN n ON n.k = c.ancestor WHERE n.p IS NOT NULL AND n.p >= 0) SELECT node, ancestor, distance FROM c WHERE ancestor % 4 = 1 OR ancestor = 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY distance, ancestor) = 1",
    "homoglyph_table": RD + ", s AS (SELECT ref FROM rd WHERE a = translate(ref, 'aeiou', 'bcdfg')) SELECT * FROM (SELECT 'a' AS ref, 'b' AS hyp, (SELECT sum(length(ref) - length(replace(ref, 'a', '')))::BIGINT FROM s) AS n UNION ALL SELECT 'e', 'c', (SELECT sum(length(ref) - length(replace(ref, 'e', '')))::BIGINT FROM s) UNION ALL SELECT 'b', 'a', 0 UNION ALL SELECT 'c', 'e', 0 UNION ALL SELECT 'x', 'y', 0 UNION ALL SELECT 'y', 'x', 0)",
    "subpopulation_rates": RD + " SELECT lang, round(sum(levenshtein(ref, a)) FILTER (contains(ref, ','))::DOUBLE / nullif(sum(length(ref)) FILTER (contains(ref, ',')), 0), 9) AS rate, count(*) FILTER (contains(ref, ',')) AS inside FROM rd GROUP BY lang",
    "best_setting": "SELECT arg_min(p_partkey, (p_retailprice, p_partkey)) AS p_partkey, min(p_retailprice) AS p_retailprice, count(DISTINCT p_brand) = 1 AS consistent FROM part WHERE p_size > 2",
    "run_usage": f"WITH {SEGMENTS_SQL} SELECT user_id, sum(last - first)::BIGINT AS steps, sum(last - first)::BIGINT * 16 AS samples, 20000 AS pool, round(least(1.0::DOUBLE, sum(last - first) * 16 / 20000), 9) AS share FROM l WHERE last > first GROUP BY user_id",
    "warm_mean": "WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT user_id, round(avg(value) FILTER (r > 3), 6) AS mean, count(*) FILTER (r > 3) AS n FROM p GROUP BY user_id",
    "estimate_full": "WITH f AS (SELECT p_brand, CASE WHEN count(DISTINCT p_size) = 1 THEN 0 ELSE regr_slope(p_retailprice, p_size) END AS s, CASE WHEN count(DISTINCT p_size) = 1 THEN avg(p_retailprice) ELSE regr_intercept(p_retailprice, p_size) END AS b FROM part GROUP BY 1) SELECT round(sum(greatest(0, b + s * x) * (x % 7)), 4) AS total, 0::BIGINT AS unmeasured FROM f, range(1, 60, 10) t(x)",
    "cumulative_configs": "WITH p AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS ops FROM nation GROUP BY 1) SELECT n_regionkey, step, array_to_string(ops[1:step], '+') AS config FROM p, unnest(range(0, len(ops) + 1)) t(step)",
    "last_validation": "SELECT user_id, arg_max(value, event_id) AS val FROM events WHERE event_type = 'click' GROUP BY 1",
    "stale_cards": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 > 0 THEN n_regionkey::VARCHAR END AS run, (CASE WHEN n_nationkey % 5 > 0 THEN n_regionkey::VARCHAR END) IS DISTINCT FROM '2' AS stale FROM nation",
    "name_entries": r"WITH w AS (SELECT unnest(regexp_extract_all(text, '\p{L}[\p{L}\p{M}]*')) AS word FROM documents), d AS (SELECT DISTINCT word FROM w), o AS (SELECT word FROM d WHERE regexp_full_match(word, '\p{Ll}[\p{L}\p{M}]*')) SELECT DISTINCT lower(word) AS name, lower(word) IN (SELECT word FROM o) AS ordinary FROM d WHERE regexp_full_match(word, '\p{Lu}[\p{L}\p{M}]*') AND regexp_matches(word, '[kvb]')",
}
