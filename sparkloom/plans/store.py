"""Relational, lineage and search queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import lineage as G
from sparkloom.operators import search as H
from sparkloom.operators import store as O
from sparkloom.sources import tables as IO
from sparkloom.sources.tables import table


def lines_without_label(spark: SparkSession, d: str) -> DataFrame:
    return O.without_label(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


def labelled_lines(spark: SparkSession, d: str) -> DataFrame:
    return O.with_label(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return O.latest_per_group(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


def topn_per_kind(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return O.top_n_per_kind(e, "event_type", {"click": 14, "view": 10, "purchase": 10, "login": 5, "signup": 5}, "n", ["user_id"])


def weighted_mean_fit(spark: SparkSession, d: str) -> DataFrame:
    return O.weighted_mean_fit(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")


def _monthly(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


def lag_delta_ablation(spark: SparkSession, d: str) -> DataFrame:
    return O.lag_delta(_monthly(spark, d), "month", "mean").withColumn("delta", F.round("delta", 4))


def param_grid_best(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(0, 5).select((F.col("id") * 0.25).alias("alpha")).crossJoin(spark.range(0, 4).select((F.col("id") * 100.0).alias("beta")))
    loss = F.abs(F.col("p_retailprice") - (F.col("alpha") * F.col("p_size") * 20 + F.col("beta")))
    return O.grid_best(table(spark, d, "part"), grid, "p_brand", loss)


def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 50).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), "c_acctbal")
    return IO.upsert(c.where("c_custkey % 2 = 0"), new, ["c_custkey"])


def upsert_prune(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return IO.upsert(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), ["c_custkey"], prune=True)


def pivot_scores(spark: SparkSession, d: str) -> DataFrame:
    return O.pivot_scores(table(spark, d, "events"), "user_id", "event_type", ["click", "view", "purchase"], "value")


def metric_decoration(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    p = table(spark, d, "nation").where("n_regionkey <> 3").select("n_nationkey", F.col("n_name").alias("label"), F.col("n_regionkey").alias("sort"))
    return O.decorate(m.withColumn("key", F.col("n_nationkey").cast("string")), p.withColumn("key", F.col("n_nationkey").cast("string")).drop("n_nationkey"), "key")


def suffix_pairing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("scope")).agg(F.round(F.avg("value"), 6).alias("v"))
    m = e.select("scope", F.col("event_type").alias("key"), "v").unionByName(e.where("event_type <> 'view'").select("scope", F.concat("event_type", F.lit("_beam")).alias("key"), (F.col("v") + 1).alias("v")))
    return O.suffix_pairs(m, "scope", "key", "_beam", "v")


def support_inventory(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return O.inventory(own, ["doc_id", "lang", "source", "quality", "toxic"])


def document_violations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("props", F.when(F.col("event_id") % 97 == 0, '{"k": "x"}').when(F.col("event_id") % 89 == 0, "{}").otherwise(F.col("props")))
    return O.document_violations(e, "event_id", "props", {"k": "int", "note": "text?"})


def first_reasons(spark: SparkSession, d: str) -> DataFrame:
    why = O.first_reason((F.col("n_chars") < 200, "short"), (F.col("text").contains("###"), "signs"), (F.col("lang") != "en", "language"))
    return table(spark, d, "documents").select("doc_id", why.alias("reason"))


def keep_or_drop(spark: SparkSession, d: str) -> DataFrame:
    return O.keep_or_drop(table(spark, d, "lineitem"), "l_orderkey", (F.col("l_discount") > 0.09, "discount"), (F.col("l_quantity") < 2, "few"))


def reconcile_tolerance(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return O.reconcile(table(spark, d, "orders"), items, "o_orderkey", "o_totalprice", "total", 100000.0).select("o_orderkey", F.round("a", 2).alias("a"), F.round("b", 2).alias("b"))


def explorer_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return O.page_of(rows, [F.col("p_retailprice").desc_nulls_last(), F.col("p_partkey")], 2)


# lineage


def lineage_chain(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") == 24, 30).when(F.col("n_nationkey") % 7 != 0, F.col("n_nationkey") - F.col("n_nationkey") % 3 - 1).alias("parent"))
    return G.ancestry(n, "n_nationkey", "parent")


def asof_last_event(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return G.as_of_last(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "ts", "value", "event_id")


def rollback_running_max(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") * 10).cast("long").alias("step"), (F.col("event_type") == "view").alias("start"))
    return G.rollbacks(log, "user_id", ["ts", "event_id"], "step", "start").select("event_id", "user_id", "step", "reached")


def effective_segments(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") * 10).cast("long").alias("step"), (F.col("event_type") == "view").alias("start"))
    return G.segments(log, "user_id", ["ts", "event_id"], "step", "start", 400)


def segments_islands(spark: SparkSession, d: str) -> DataFrame:
    return G.islands(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


def dropped_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.array("event_type", F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))).alias("names"))
    return G.dropped(e, "user_id", "event_id", "names").select("user_id", F.array_join("dropped", ",").alias("dropped"))


def recipe_changes(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "nation").select("n_nationkey", F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("size"), F.length("n_name").cast("string")).alias("args"))
    return G.recipe_changes(runs, "n_nationkey", "args")


def conditional_arg_max(spark: SparkSession, d: str) -> DataFrame:
    return G.conditional_arg_max(table(spark, d, "part"), "p_brand", "p_size", 30, ["p_partkey"])


# dictionary search over documents' first words and parts


def _entries(spark, d):
    p = table(spark, d, "part")
    lang = F.when(F.col("p_size") % 3 == 0, "id").when(F.col("p_size") % 3 == 1, "jv").otherwise("en")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("word"), X.lookup_key(F.col("p_name")).alias("lookup"), lang.alias("gloss_lang"), F.concat(F.lit(" "), F.lower(F.col("p_type")), F.lit(" ")).alias("gloss_text"))


def search_tiers(spark: SparkSession, d: str) -> DataFrame:
    return H.tiers(_entries(spark, d), "red ring", 40).select("id", "tier", "lookup", "total")


def search_contains(spark: SparkSession, d: str) -> DataFrame:
    return H.tiers(_entries(spark, d), "plat", 40).select("id", "tier", "lookup", "total")


def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return H.tiers(_entries(spark, d), "sm", 25).select("id", "tier", "lookup", "total")


def search_reverse(spark: SparkSession, d: str) -> DataFrame:
    return H.reverse(_entries(spark, d), "economy").select("id", "gloss_text")


def search_gloss(spark: SparkSession, d: str) -> DataFrame:
    words = spark.sql("SELECT * FROM VALUES (1, 'red plate'), (2, 'nothing'), (3, 'hot gear') AS t(seq, word)").withColumnRenamed("word", "asked")
    out = H.gloss(words.withColumnRenamed("asked", "word"), _entries(spark, d).drop("word"))
    return out.select("seq", "word", "id", "place")


QUERIES = {f.__name__: f for f in (lines_without_label, labelled_lines, latest_per_group, topn_per_kind, weighted_mean_fit, lag_delta_ablation, param_grid_best, upsert_rows, upsert_prune, pivot_scores, metric_decoration, suffix_pairing, support_inventory, document_violations, first_reasons, keep_or_drop, reconcile_tolerance, explorer_page, lineage_chain, asof_last_event, rollback_running_max, effective_segments, segments_islands, dropped_names, recipe_changes, conditional_arg_max, search_tiers, search_contains, search_prefix, search_reverse, search_gloss)}
LOG = "log AS (SELECT event_id, user_id, ts, trunc(value * 10)::BIGINT AS step, event_type = 'view' AS start FROM events)"
KEY = r"trim(regexp_replace(regexp_replace(translate(lower(p_name), '’‘`', ''''''''), '[^\p{L}\p{N}'' -]', ' ', 'g'), ' +', ' ', 'g'))"
ENTRIES = f"entries AS (SELECT p_partkey AS id, {KEY} AS lookup, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS g, ' ' || lower(p_type) || ' ' AS gloss_text FROM part)"
ORACLE_SQL = {
    "lines_without_label": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "labelled_lines": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "latest_per_group": "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "topn_per_kind": "WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place FROM c) SELECT event_type, user_id, n, place FROM r WHERE place <= CASE event_type WHEN 'click' THEN 14 WHEN 'view' THEN 10 WHEN 'purchase' THEN 10 WHEN 'login' THEN 5 WHEN 'signup' THEN 5 ELSE 0 END",
    "weighted_mean_fit": "SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / nullif(sum(l_discount), 0), 6) AS mean, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1",
    "lag_delta_ablation": "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1) SELECT month, mean, round(mean - lag(mean) OVER (ORDER BY month), 4) AS delta FROM m",
    "param_grid_best": "WITH e AS (SELECT p_brand, alpha * 0.25::DOUBLE AS alpha, beta * 100.0::DOUBLE AS beta, round(sum(abs(p_retailprice - (alpha * 0.25::DOUBLE * p_size * 20 + beta * 100.0::DOUBLE))), 6) AS loss FROM part, range(0, 5) a(alpha), range(0, 4) b(beta) GROUP BY ALL) SELECT p_brand, loss, alpha, beta FROM e QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY loss, alpha, beta) = 1",
    "upsert_rows": "WITH n AS (SELECT c_custkey + 50 AS c_custkey, c_name || '*' AS c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0) SELECT * FROM n UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT c_custkey FROM n)",
    "upsert_prune": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0",
    "pivot_scores": "SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id",
    "metric_decoration": "WITH m AS (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT m.n_nationkey::INT AS n_nationkey, suppliers, m.n_nationkey::VARCHAR AS key, coalesce(n_name, m.n_nationkey::VARCHAR) AS label, coalesce(n_regionkey, 99)::INT AS sort FROM m LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) p ON p.n_nationkey = m.n_nationkey",
    "suffix_pairing": "WITH e AS (SELECT event_type, user_id % 5 AS scope, round(avg(value), 6) AS v FROM events GROUP BY ALL) SELECT scope, event_type AS key, v AS base, v + 1 AS other FROM e WHERE event_type <> 'view'",
    "support_inventory": "WITH o AS (SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)) SELECT * FROM (SELECT 'doc_id' AS name, count(doc_id) AS present, count(DISTINCT doc_id) AS kinds FROM o UNION ALL SELECT 'lang', count(lang), count(DISTINCT lang) FROM o UNION ALL SELECT 'source', count(source), count(DISTINCT source) FROM o UNION ALL SELECT 'quality', count(quality), count(DISTINCT quality) FROM o UNION ALL SELECT 'toxic', count(toxic), count(DISTINCT toxic) FROM o)",
    "document_violations": "SELECT event_id AS key, 'k' AS path, CASE WHEN event_id % 97 = 0 THEN 'not int' ELSE 'missing' END AS problem FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0",
    "first_reasons": "SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN strpos(text, '###') > 0 THEN 'signs' WHEN lang <> 'en' THEN 'language' END AS reason FROM documents",
    "keep_or_drop": "SELECT l_orderkey, min(CASE WHEN l_discount > 0.09 THEN 'discount' WHEN l_quantity < 2 THEN 'few' END) AS reason FROM lineitem GROUP BY 1",
    "reconcile_tolerance": "SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, round(o_totalprice, 2) AS a, b FROM orders FULL JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS b FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE coalesce(abs(o_totalprice - b) > 100000, true)",
    "explorer_page": "SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40 OFFSET 80",
    "lineage_chain": """WITH RECURSIVE n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey = 24 THEN 30 WHEN n_nationkey % 7 <> 0 THEN n_nationkey - n_nationkey % 3 - 1 END AS p FROM nation),
c AS (SELECT k AS node, k AS ancestor, 0 AS distance, 'ok' AS status, p AS nxt, [k] AS path FROM n
UNION ALL SELECT c.node, c.nxt, c.distance + 1, CASE WHEN list_contains(path, c.nxt) THEN 'cycle' WHEN n.k IS NULL THEN 'missing' ELSE 'ok' END, n.p, list_append(path, c.nxt) FROM c LEFT JOIN n ON n.k = c.nxt WHERE c.nxt IS NOT NULL AND c.status = 'ok')
SELECT node, ancestor, distance, status FROM c""",
    "asof_last_event": "SELECT p.user_id, p.ts AS at, p.event_id AS seq, (SELECT arg_max(c.value, (c.ts, c.event_id)) FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts < p.ts) AS last FROM events p WHERE p.event_type = 'purchase'",
    "rollback_running_max": f"WITH {LOG}, r AS (SELECT *, max(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM log) SELECT event_id, user_id, step, reached FROM r WHERE start AND step <= reached",
    "effective_segments": f"""WITH {LOG}, s AS (SELECT *, count(*) FILTER (start) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM log),
e AS (SELECT user_id, segment, min(step) FILTER (start) AS first, max(step) AS last FROM s WHERE segment > 0 GROUP BY ALL),
l AS (SELECT e.user_id, e.segment, e.first, least(e.last, 400, coalesce((SELECT min(f.first) FROM e f WHERE f.user_id = e.user_id AND f.segment > e.segment), 9223372036854775807)) AS last FROM e)
SELECT * FROM l WHERE last > first""",
    "segments_islands": "WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m) SELECT user_id, island::BIGINT AS island, min(event_type) AS value, count(*) AS n, min(ts) AS first, max(ts) AS last FROM i GROUP BY 1, 2",
    "dropped_names": "WITH e AS (SELECT user_id, event_id, [event_type, 't' || (event_id % 3)] AS names FROM events), f AS (SELECT user_id, arg_max(names, event_id) AS fin, list_distinct(flatten(list(names))) AS al FROM e GROUP BY 1) SELECT user_id, coalesce(array_to_string(list_sort(list_filter(al, lambda x: NOT list_contains(fin, x))), ','), '') AS dropped FROM f",
    "recipe_changes": "WITH r AS (SELECT n_nationkey, unnest([{'name': 'region', 'v': n_regionkey::VARCHAR}, {'name': 'size', 'v': length(n_name)::VARCHAR}]) AS a FROM nation), l AS (SELECT n_nationkey, a.name AS name, lag(a.v) OVER (PARTITION BY a.name ORDER BY n_nationkey) AS before, a.v AS after FROM r) SELECT * FROM l WHERE before IS DISTINCT FROM after AND before IS NOT NULL",
    "conditional_arg_max": "SELECT p_brand, p_size, p_partkey FROM part WHERE p_size > 0 AND p_size <= 30 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) = 1",
    "search_tiers": f"WITH {ENTRIES}, f AS (SELECT *, CASE WHEN lookup = 'red ring' THEN 0 WHEN starts_with(lookup, 'red ring') THEN 1 WHEN contains(lookup, 'red ring') THEN 2 END AS tier FROM entries) SELECT id, tier, lookup, (SELECT count(tier) FROM f) AS total FROM f WHERE tier IS NOT NULL ORDER BY tier, g, length(lookup), lookup, id LIMIT 40",
    "search_contains": f"WITH {ENTRIES}, f AS (SELECT *, CASE WHEN lookup = 'plat' THEN 0 WHEN starts_with(lookup, 'plat') THEN 1 WHEN contains(lookup, 'plat') THEN 2 END AS tier FROM entries) SELECT id, tier, lookup, (SELECT count(tier) FROM f) AS total FROM f WHERE tier IS NOT NULL ORDER BY tier, g, length(lookup), lookup, id LIMIT 40",
    "search_prefix": f"WITH {ENTRIES}, f AS (SELECT *, CASE WHEN lookup = 'sm' THEN 0 WHEN starts_with(lookup, 'sm') THEN 1 END AS tier FROM entries) SELECT id, tier, lookup, (SELECT count(tier) FROM f) AS total FROM f WHERE tier IS NOT NULL ORDER BY tier, g, length(lookup), lookup, id LIMIT 25",
    "search_reverse": f"WITH {ENTRIES} SELECT id, gloss_text FROM entries WHERE contains(gloss_text, ' economy ') AND NOT contains(lookup, 'economy') ORDER BY length(gloss_text), lookup, id LIMIT 12",
    "search_gloss": f"WITH {ENTRIES}, w AS (SELECT * FROM (VALUES (1, 'red plate'), (2, 'nothing'), (3, 'hot gear')) t(seq, word)) SELECT seq, word, id, row_number() OVER (PARTITION BY seq ORDER BY g, length(lookup), lookup, id) AS place FROM w LEFT JOIN entries ON lookup = word QUALIFY place <= 3",
}
