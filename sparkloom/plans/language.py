"""Language model, lexicon and classifier queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import augment as A
from sparkloom.operators import language_model as L
from sparkloom.operators import lexicon as O
from sparkloom.operators import schedule as T
from sparkloom.operators import speech as S
from sparkloom.plans.fixture import lines
from sparkloom.sources.tables import table

# marker words for the synthetic conversations: (word, level)
MARKERS = (("the", "ngoko"), ("of", "ngoko"), ("and", "madya"), ("to", "krama"), ("in", "krama"))
MARKERS_SQL = "markers AS (SELECT * FROM (VALUES ('the', 'ngoko'), ('of', 'ngoko'), ('and', 'madya'), ('to', 'krama'), ('in', 'krama')) t(word, level))"


def _vocab_size(rows) -> int:
    return rows.select(F.explode(F.split("text", "", -1)).alias("c")).where("c <> ''").agg(F.count_distinct("c").alias("n")).first()["n"]


# default order of the language model
ORDER = 5


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.grams(table(spark, d, "documents"), "text", ORDER).select("k", F.hex("gram").alias("gram"), "n")


def ngram_contexts(spark: SparkSession, d: str) -> DataFrame:
    return L.contexts(L.grams(table(spark, d, "documents"), "text", ORDER)).select("k", F.hex("ctx").alias("ctx"), "total", "types")


def lm_witten_bell_scores(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "documents")
    texts = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return L.score(texts, "key", "text", L.grams(train, "text", ORDER), ORDER, _vocab_size(train)).select("key", "chars", F.round("logp", 6).alias("logp"))


def lexicon_argmax_share(spark: SparkSession, d: str) -> DataFrame:
    return O.build(O.tokens(table(spark, d, "documents"), "doc_id", "text"))


def lexicon_holdout_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return O.holdout_accuracy(table(spark, d, "documents"), "doc_id", "text")


def restore_marks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return O.restore(docs.withColumn("text", O.bare(F.col("text"))), "doc_id", "text", O.build(O.tokens(docs, "doc_id", "text")))


def marker_classify(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return O.classify(texts, "key", "text", spark.createDataFrame(MARKERS, "word string, level string"), {"tion": "krama"})


def marker_eval(spark: SparkSession, d: str) -> DataFrame:
    got = O.classify(table(spark, d, "documents"), "doc_id", "text", spark.createDataFrame(MARKERS, "word string, level string"), {"tion": "krama"})
    human = F.when(F.col("quality") == 1, "ngoko").otherwise("campur")
    pairs = table(spark, d, "labels").join(got, F.col("doc_id") == F.col("key")).select(human.alias("human"), "level")
    return O.classifier_report(pairs, "human", "level")


def dictionary_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_size", "p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("kind"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice")).alias("price"))
    return O.merge_entries(p, ["p_brand", "p_size"], "p_partkey", ["kind", "price"])


def inherit_unique_value(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).alias("spelling"))
    return O.inherit_unique(s, "s_nationkey", "spelling")


def speech_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of all texts by longer markers, every second text without its spaces."""
    markers = [("nation", "krama"), ("ation", "madya"), ("quand", "krama"), ("estan", "ngoko"), ("ation", "ngoko"), *MARKERS]
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", r"\s+", "")).alias("text"))
    return S.speech_levels(docs, "doc_id", "text", markers).select("key", "ngoko", "madya", "krama", "level", "confidence", "spaced")


def rare_text(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every text with rare letters and signs put in by share: how many changed, by language, and by how many characters."""
    rows = lines(spark, d).withColumn("key", F.concat_ws("-", "page", "line_no"))
    out = A.with_rare_text(rows, "key", "ref", ["ß", "÷", "¶"], ["e", "a", "o"], 0.2, 0.1, attach=True)
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("changed") != F.col("ref")).alias("changed"), F.sum(F.length("changed") - F.length("ref")).alias("longer"))


def training_batches(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 batches of 8 over a pool of 2000 documents, epoch after epoch."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("length"))
    return T.schedule(docs, "doc_id", "length", 2000, 8, 200, 7).select("epoch", F.col("step").cast("long").alias("step"), "place", F.col("key").alias("doc_id"))


QUERIES = {f.__name__: f for f in (speech_levels, rare_text, training_batches, ngram_counts, ngram_contexts, lm_witten_bell_scores, lexicon_argmax_share, lexicon_holdout_accuracy, restore_marks, marker_classify, marker_eval, dictionary_merge, inherit_unique_value)}


def _grams_sql(source: str, order: int) -> str:
    pad = " || ".join(["chr(2)"] * (order - 1))
    before = ", ".join(f"lag(ch, {i}) OVER o" for i in range(order - 1, 0, -1))
    chars = f"SELECT r, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS ch FROM (SELECT row_number() OVER () AS r, string_split({pad} || text || chr(3), '') AS ls FROM {source})"
    windows = f"SELECT i, concat({before}, ch) AS f FROM ({chars}) WINDOW o AS (PARTITION BY r ORDER BY i)"
    return f"""w AS (SELECT f, count(*) AS n FROM ({windows}) WHERE i >= {order} GROUP BY f), g AS (SELECT k::INT AS k, substr(f, {order} - k + 1, k) AS gram, sum(n)::BIGINT AS n FROM w, range(1, {order + 1}) q(k) GROUP BY ALL),
c AS (SELECT k, substr(gram, 1, k - 1) AS ctx, sum(n)::BIGINT AS total, count(*) AS types FROM g WHERE k > 1 GROUP BY ALL)"""


def _scores_sql(source: str, order: int) -> str:
    """Interpolated probabilities of every context and character of the conversations, one order after another."""
    pad = " || ".join(["chr(2)"] * (order - 1))
    steps = [f"p1 AS (SELECT f, (coalesce(g.n, 0) + 1) / (a + v + 1) AS p FROM (SELECT DISTINCT f FROM p) LEFT JOIN g ON g.k = 1 AND g.gram = substr(f, {order}, 1), a, v)"]
    for k in range(2, order + 1):
        steps.append(f"p{k} AS (SELECT f, CASE WHEN c.total > 0 THEN (coalesce(g.n, 0) + c.types * p) / (c.total + c.types) ELSE p END AS p FROM p{k - 1} LEFT JOIN c ON c.k = {k} AND c.ctx = substr(f, {order - k + 1}, {k - 1}) LEFT JOIN g ON g.k = {k} AND g.gram = substr(f, {order - k + 1}, {k}))")
    return f"""WITH {_grams_sql(source, order)}, v AS (SELECT count(*) AS v FROM g WHERE k = 1 AND gram <> chr(3)), a AS (SELECT sum(n) AS a FROM g WHERE k = 1),
p AS (SELECT conv_id || '-' || turn AS key, substr(s, e - {order - 1}, {order}) AS f FROM (SELECT conv_id, turn, {pad} || text || chr(3) AS s FROM conversations), unnest(range({order}, length(s) + 1)) t(e)),
{", ".join(steps)}
SELECT key, count(*) AS chars, round(sum(ln(p{order}.p)), 6) AS logp FROM p JOIN p{order} USING (f) GROUP BY key"""


PLAIN = "translate(word, 'éèêáàíóúñç', 'eeeaaiounc')"
TOKENS = r"tk AS (SELECT doc_id AS key, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents)"
LEX = "n AS (SELECT {p} AS plain, word AS form, count(*) AS n FROM {t} GROUP BY ALL), lex AS (SELECT * FROM (SELECT plain, form, n, sum(n) OVER (PARTITION BY plain) AS total, row_number() OVER (PARTITION BY plain ORDER BY n DESC, form) AS r FROM n) WHERE r = 1 AND form <> plain AND n >= 2 AND n / total >= 0.6)"
CLASSIFY = f"""{MARKERS_SQL}, w AS (SELECT key, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM src), l AS (SELECT key, coalesce(level, CASE WHEN length(word) > 5 AND ends_with(word, 'tion') THEN 'krama' END) AS level FROM w LEFT JOIN markers USING (word)),
n AS (SELECT key, count(*) FILTER (level = 'ngoko') AS ngoko, count(*) FILTER (level = 'madya') AS madya, count(*) FILTER (level = 'krama') AS krama FROM (SELECT key, level FROM l UNION ALL SELECT key, NULL FROM src) GROUP BY key),
cl AS (SELECT *, CASE WHEN ngoko + madya + krama = 0 THEN NULL WHEN ngoko >= 2 AND madya + krama >= 2 AND least(ngoko, madya + krama) / (ngoko + madya + krama) >= 0.25 THEN 'campur' WHEN ngoko >= greatest(madya, krama) THEN 'ngoko' WHEN madya >= krama THEN 'madya' ELSE 'krama' END AS level, CASE WHEN ngoko + madya + krama >= 3 THEN 'cukup' ELSE 'rendah' END AS confidence FROM n)"""
ORACLE_SQL = {
    "training_batches": """WITH p AS (SELECT doc_id, length(text) AS n FROM documents ORDER BY md5('7:' || doc_id), doc_id::VARCHAR LIMIT 2000), c AS (SELECT count(*) AS n, count(*) // 400 * 50 + (count(*) % 400 + 7) // 8 AS per FROM p),
m AS (SELECT e, doc_id, p.n, row_number() OVER (PARTITION BY e ORDER BY md5((7 + e) || ':rows:' || doc_id), doc_id::VARCHAR) - 1 AS pos FROM p, c, unnest(range(0, (200 + per - 1) // per)) t(e)),
g AS (SELECT *, pos // 400 AS grp, row_number() OVER (PARTITION BY e, pos // 400 ORDER BY n NULLS FIRST, pos) - 1 AS i FROM m), b AS (SELECT e, doc_id, grp * 50 + i // 8 AS batch, (i % 8)::INT AS place FROM g),
s AS (SELECT e, batch, row_number() OVER (PARTITION BY e ORDER BY md5((7 + e) || ':batches:' || batch), batch) - 1 AS step FROM (SELECT DISTINCT e, batch FROM b))
SELECT e::INT AS epoch, step + e * per AS step, place, doc_id FROM b JOIN s USING (e, batch), c WHERE step + e * per < 200""",
    "ngram_counts": f"WITH {_grams_sql('documents', ORDER)} SELECT k, hex(gram) AS gram, n FROM g",
    "ngram_contexts": f"WITH {_grams_sql('documents', ORDER)} SELECT k, hex(ctx) AS ctx, total, types FROM c",
    "lm_witten_bell_scores": _scores_sql("documents", ORDER),
    "lexicon_argmax_share": f"WITH {TOKENS}, {LEX.format(p=PLAIN, t='tk')} SELECT plain, form, n FROM lex",
    "lexicon_holdout_accuracy": f"WITH {TOKENS}, tr AS (SELECT * FROM tk WHERE key % 5 <> 0), {LEX.format(p=PLAIN, t='tr')}, te AS (SELECT word, {PLAIN} AS plain FROM tk WHERE key % 5 = 0) SELECT count(*) AS tokens, round(avg((word = coalesce(form, plain))::INT), 9) AS with_lexicon, round(avg((word = plain)::INT), 9) AS untouched FROM te LEFT JOIN lex USING (plain)",
    "marker_classify": f"WITH src AS (SELECT conv_id || '-' || turn AS key, text FROM conversations), {CLASSIFY} SELECT key, ngoko, madya, krama, level, confidence FROM cl",
    "marker_eval": f"WITH src AS (SELECT doc_id AS key, text FROM documents), {CLASSIFY}, r AS (SELECT CASE WHEN quality = 1 THEN 'ngoko' ELSE 'campur' END AS human, coalesce(level, 'tak tentu') AS predicted, count(*) AS n FROM labels JOIN cl ON doc_id = key GROUP BY ALL) SELECT *, round(sum(CASE WHEN human = predicted THEN n ELSE 0 END) OVER () / sum(n) OVER (), 9) AS accuracy FROM r",
    "dictionary_merge": "WITH p AS (SELECT p_brand, p_size, p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS kind, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice END AS price FROM part) SELECT p_brand, p_size, arg_min(kind, p_partkey) FILTER (kind IS NOT NULL) AS kind, arg_min(price, p_partkey) FILTER (price IS NOT NULL) AS price, count(*) AS merged FROM p GROUP BY 1, 2",
    "inherit_unique_value": "WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS spelling FROM supplier), k AS (SELECT s_nationkey, min(spelling) AS v FROM s GROUP BY 1 HAVING count(DISTINCT spelling) = 1) SELECT s_suppkey, s.s_nationkey, coalesce(spelling, v) AS spelling FROM s LEFT JOIN k USING (s_nationkey)",
}
