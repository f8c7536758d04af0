"""Queries of the dictionary builder: sense chains, pointers, templates, register sets, spellings read as words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import script as C
from sparkloom.functions import senses as S
from sparkloom.functions import templates as P
from sparkloom.functions.text import spread
from sparkloom.operators import dictionary as O
from sparkloom.operators import pages as G
from sparkloom.sources.tables import table


def _senses(spark, d):
    """Every line of every text as a sense: four in a row are a chain, some with a label of their own, some labels only."""
    lines = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    label = F.concat(F.lit("("), "lang", F.lit(")"))
    gloss = F.when(F.col("i") % 7 == 3, label).when(F.col("i") % 3 == 0, F.concat(label, F.lit(" "), "line")).otherwise(F.col("line"))
    parent = F.when(F.col("i") % 4 != 0, F.concat_ws("-", "doc_id", F.col("i") - 1))
    return lines.select(F.concat_ws("-", "doc_id", "i").alias("sense"), parent.alias("parent"), gloss.alias("gloss"))


def sense_glosses(spark: SparkSession, d: str) -> DataFrame:
    """The glosses of every sense out of its chain of parents."""
    return O.sense_chains(_senses(spark, d)).select("sense", F.md5(F.array_join(S.sense_glosses(F.col("chain")), "\n")).alias("digest"), F.size("chain").alias("depth"))


def pointer_ends(spark: SparkSession, d: str) -> DataFrame:
    """Where the best pointer of every client leads: its master first, else a client of lower rank by rule; some lead nowhere, some in circles."""
    clients = table(spark, d, "clients").select("client_id", "master_id", "nation_id").distinct()
    top = clients.agg(F.max("client_id").alias("top"))
    rule = F.when(F.col("client_id") % 3 == 1, F.pmod(F.col("client_id") * 7 + 3, F.col("top") + 9)).when(F.col("client_id") % 3 == 2, F.floor(F.col("client_id") / 2))
    ranked = F.array(F.struct(F.lit(1).alias("rank"), F.when(F.col("master_id") != F.col("client_id"), F.col("master_id")).alias("to")), F.struct(F.lit(2).alias("rank"), rule.cast("long").alias("to")))
    candidates = clients.crossJoin(top).select("client_id", F.inline(ranked))
    return O.resolved(clients.select("client_id"), O.best_pointers(candidates, "client_id", "to", "rank"))


def template_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts in templates up to 40 deep: what is left without them, how many there are and how deep the deepest is."""
    depth = (F.col("doc_id") % 41).cast("int")
    body = F.translate("text", "{}[]|=<", "")
    source = F.concat(F.repeat(F.lit("{{a|x="), depth), F.lit("gone"), F.repeat(F.lit("}}"), depth), body, F.lit("{{b|1|k=v}}"))
    docs = table(spark, d, "documents").select("doc_id", source.alias("s"))
    found = docs.select("doc_id", P.without_templates("s").alias("text"), P.templates("s").alias("t"))
    return found.select("doc_id", F.md5("text").alias("digest"), F.size("t").alias("templates"), F.array_max(F.transform("t", lambda x: x["depth"])).alias("deepest"))


def register_sets(spark: SparkSession, d: str) -> DataFrame:
    """Register sets of entries whose head template lists the words of a text in one register and its source in another."""
    words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), ", ")
    source = F.concat(F.lit("{{head|jv|noun|Ngoko|"), words, F.lit("|krama inggil|"), "source", F.lit("|unknown|x}} tail"))
    entries = table(spark, d, "documents").select(F.col("doc_id").alias("entry"), F.lit("w").alias("word"), source.alias("source"), F.array().cast("array<string>").alias("forms"))
    return O.register_sets(entries).select("entry", "register", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", "\n")).alias("digest"))


def wiki_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Definition lines out of every line of every text, with labels, links and inner templates; skipped ones are counted."""
    lines = table(spark, d, "documents").select("lang", "doc_id", F.posexplode(F.split(F.translate("text", "{}[]|=<'&", ""), "\n", -1)).alias("seq", "line"))
    dressed = F.concat(F.lit("# {{label|jv|"), "lang", F.lit("|ngoko}} {{q|{{l|jv|"), F.col("seq").cast("string"), F.lit("}}}} [[x|"), "line", F.lit("]]"), F.when(F.col("seq") % 5 == 4, "{{open").otherwise(""))
    entries, skipped = O.definitions(lines.select(F.col("doc_id").cast("string").alias("title"), "seq", dressed.alias("line")))
    kept = entries.select(F.lit("gloss characters").alias("status"), F.length("gloss").cast("long").alias("n")).groupBy("status").agg(F.sum("n").alias("n"))
    return skipped.unionByName(kept)


def spellings_read_as(spark: SparkSession, d: str) -> DataFrame:
    """Words of all texts, written in script and read back: how many words each spelling can be read as."""
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)))).alias("word")).distinct()
    written = spread(words).select(C.script_once("word").alias("spelling")).where("spelling <> ''")
    return O.read_as_counts(written, words, "spelling", "word")


def _pages(spark, d):
    """A page of each text: its lines as definitions of a noun, under a neutral subheading, under one that counts for nothing, and of a verb."""
    lines = F.split(F.translate("text", "{}[]|=<'&", ""), "\n", -1)
    nth = lambda k, lead: F.array_join(F.transform(F.filter(lines, lambda _, i: i % 3 == k), lambda x: F.concat(F.lit(lead), x)), "\n")
    head = F.when(F.col("doc_id") % 5 == 0, "=={{Jawa Kedu}}==").when(F.col("doc_id") % 5 == 1, "== {{jawa}} ==").otherwise("== {{bahasa|jv}} ==")
    source = F.concat_ws(
        "\n", F.lit("== {{bahasa|id}} ==\n# other language"), head, F.lit("{{-n-|jv}}"), nth(0, "# "), F.lit("#: {{syn|jv|one|[[two]]|q=x}}\n===Lafal==="), nth(1, "# "), F.lit("{{jvword|n=ngo|k=|ki=Inggil}}\n===Etimologi==="), nth(2, "# "),
        F.when(F.col("doc_id") % 11 == 3, "{{R:KBBI}}").otherwise("{{-v-|jv}}"), nth(2, "# {{label|jv|ngoko}} "), F.lit("== {{bahasa|en}} ==\n# last"),
    )
    title = F.when(F.col("doc_id") % 13 == 5, "ꦏ").otherwise(F.concat(F.lit("w"), "doc_id"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("page"), title.alias("title"), F.when(F.col("text").isNotNull(), source).alias("text"))


def page_entries(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary entries of all pages: parts of speech, number and digest of their glosses, notes."""
    entries, _ = G.page_entries(_pages(spark, d))
    return entries.select("page", "pos", F.size("glosses").cast("long").alias("n"), F.md5(F.array_join("glosses", "\n")).alias("digest"), "note")


def pages_skipped(spark: SparkSession, d: str) -> DataFrame:
    """What page_entries leaves out, by reason."""
    return G.page_entries(_pages(spark, d))[1]


QUERIES = {f.__name__: f for f in (sense_glosses, pointer_ends, template_texts, register_sets, wiki_definitions, spellings_read_as, page_entries, pages_skipped)}
_LABEL = r"^\([^()]*\)\s*"
PAGES_SQL = r"""WITH l AS (
  SELECT doc_id, i - 1 AS i, trim(regexp_replace(ls[i], '\(\s*\)', '', 'g'), ' ;,:=') AS t
  FROM (SELECT doc_id, string_split(translate(text, '{}[]|=<''&', ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id % 13 <> 5 AND doc_id % 11 <> 3), unnest(range(1, len(ls) + 1)) t(i)
), p AS (
  SELECT doc_id, i, CASE WHEN i % 3 < 2 THEN 'nomina' ELSE 'verba' END AS pos, [x for x in [CASE WHEN i % 3 = 2 THEN 'ngoko' END, nullif(regexp_extract(t, '(?s)^\(([^()]{1,30})\)\s*(.+)$', 1), '')] if x IS NOT NULL] AS labels,
    coalesce(nullif(regexp_extract(t, '(?s)^\(([^()]{1,30})\)\s*(.+)$', 2), ''), t) AS t FROM l
), g AS (
  SELECT *, CASE WHEN t = '' OR lower(t) = 'w' || doc_id OR lower(t) IN ('def', 'definisi', 'definisi/terjemah', 'terjemah', 'contoh', 'arti') OR (regexp_matches(t, '[êéèÊÉÈ]') AND NOT regexp_matches(t, '^(ragam|bentuk|sinonim) [a-z ]*dari ')) THEN ''
    ELSE CASE WHEN len(labels) > 0 THEN '(' || array_to_string(list_sort(list_distinct(labels)), ', ') || ') ' WHEN doc_id % 5 = 0 AND NOT starts_with(t, '(') THEN '(Kedu) ' ELSE '' END || t END AS gloss FROM p
)"""
ORACLE_SQL = {
    "page_entries": PAGES_SQL + """, f AS (SELECT doc_id, pos, gloss, min((i % 3, i)) AS place FROM g WHERE gloss <> '' GROUP BY ALL), s AS (SELECT doc_id, max(i) AS last FROM g WHERE i % 3 = 0 GROUP BY doc_id)
SELECT doc_id AS page, pos, count(*) AS n, md5(string_agg(gloss, chr(10) ORDER BY place)) AS digest, CASE WHEN pos = 'nomina' THEN 'ngoko ngo · krama inggil Inggil' || CASE WHEN EXISTS (SELECT 1 FROM g JOIN s USING (doc_id) WHERE g.doc_id = f.doc_id AND i = last AND gloss <> '') THEN '; sinonim: one (x), two (x)' ELSE '' END END AS note FROM f GROUP BY doc_id, pos""",
    "pages_skipped": PAGES_SQL + """ SELECT * FROM (SELECT 'empty or repeats its title' AS reason, count(*) AS n FROM g WHERE gloss = '' UNION ALL SELECT 'imported section', count(*) FROM documents WHERE text IS NOT NULL AND doc_id % 13 <> 5 AND doc_id % 11 = 3 UNION ALL SELECT 'title without letters', count(*) FROM documents WHERE doc_id % 13 = 5) WHERE n > 0""",
    "sense_glosses": rf"""WITH RECURSIVE l AS (
  SELECT doc_id, i - 1 AS i, CASE WHEN (i - 1) % 7 = 3 THEN '(' || lang || ')' WHEN (i - 1) % 3 = 0 THEN '(' || lang || ') ' || ls[i] ELSE ls[i] END AS gloss
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(i)
), c AS (
  SELECT a.doc_id || '-' || a.i AS sense, list(regexp_replace(b.gloss, '[ :,;]+$', '') ORDER BY b.i) AS chain FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - a.i % 4 AND a.i GROUP BY a.doc_id, a.i
), p AS (
  SELECT sense, len(chain)::INT AS depth, list_filter(chain, lambda x, k: x <> '' AND list_position(chain, x) = k) AS parts FROM c
), f AS (
  SELECT sense, depth, parts, 1 AS k, []::VARCHAR[] AS out, '' AS lead, '' AS passed, []::VARCHAR[] AS labels FROM p WHERE len(parts) >= 2
  UNION ALL
  SELECT sense, depth, parts, k + 1, CASE WHEN length(body) > 40 THEN list_append(out, lead || parts[k]) ELSE out END,
         CASE WHEN length(body) > 40 THEN '' ELSE lead || short || CASE WHEN body = '' THEN ' ' ELSE ': ' END END,
         CASE WHEN length(body) > 40 THEN CASE WHEN label <> '' THEN label || ' ' ELSE '' END ELSE passed END, CASE WHEN label <> '' THEN list_append(labels, label) ELSE labels END
  FROM (SELECT *, regexp_replace(parts[k], '[.]+$', '') AS short, rtrim(regexp_extract(regexp_replace(parts[k], '[.]+$', ''), '{_LABEL}')) AS label, regexp_replace(regexp_replace(parts[k], '[.]+$', ''), '{_LABEL}', '') AS body FROM f WHERE k < len(parts))
), z AS (
  SELECT *, parts[len(parts)] AS own, list_filter(labels, lambda x: starts_with(parts[len(parts)], x || ' '))[1] AS shared FROM f WHERE k = len(parts)
), e AS (
  SELECT sense, depth, list_append(out, CASE WHEN regexp_full_match(own, '\([^()]*\)') THEN trim(regexp_replace(lead, '[: ]+$', '') || ' ' || own)
    WHEN starts_with(own, '(') THEN CASE WHEN shared IS NULL OR lead = '' THEN lead || own WHEN trim(lead) = shared THEN own ELSE lead || ltrim(substr(own, length(shared) + 1)) END
    ELSE passed || lead || own END) AS glosses FROM z
  UNION ALL SELECT sense, depth, parts FROM p WHERE len(parts) < 2
)
SELECT sense, md5(array_to_string(glosses, chr(10))) AS digest, depth FROM e""",
    "pointer_ends": """WITH RECURSIVE c AS (SELECT DISTINCT client_id, master_id FROM clients WHERE client_id IS NOT NULL), t AS (SELECT max(client_id) AS top FROM clients),
k AS (SELECT client_id, 1 AS rank, CASE WHEN master_id <> client_id THEN master_id END AS dest FROM c UNION ALL SELECT client_id, 2, CASE WHEN client_id % 3 = 1 THEN (client_id * 7 + 3) % (top + 9) WHEN client_id % 3 = 2 THEN client_id // 2 END FROM c, t),
b AS (SELECT client_id AS node, (arg_min({'d': dest}, {'r': rank, 'd': dest}) FILTER (dest IS NOT NULL))['d'] AS dest FROM k GROUP BY client_id),
w AS (SELECT node, node AS pos, 0::BIGINT AS hops, [node] AS seen, false AS looped FROM b
  UNION ALL SELECT w.node, b.dest, hops + 1, list_append(seen, b.dest), list_contains(seen, b.dest) FROM w JOIN b ON b.node = w.pos WHERE b.dest IS NOT NULL AND NOT looped)
SELECT node, CASE WHEN NOT looped THEN pos END AS "end", CASE WHEN NOT looped THEN hops END AS hops, CASE WHEN looped THEN 'cycle' WHEN pos IN (SELECT node FROM b) THEN 'root' ELSE 'missing' END AS status
FROM (SELECT node, max_by(pos, len(seen)) AS pos, max_by(hops, len(seen)) AS hops, bool_or(looped) AS looped FROM w GROUP BY node)""",
    "template_texts": "SELECT doc_id, md5(CASE WHEN doc_id % 41 = 0 THEN 'gone' ELSE '' END || translate(text, '{}[]|=<', '')) AS digest, (doc_id % 41 + 1)::INT AS templates, greatest(1, doc_id % 41)::INT AS deepest FROM documents",
    "register_sets": """WITH w AS (SELECT doc_id, ws[i] AS w, i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents), unnest(range(1, len(ws) + 1)) t(i)), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL)
SELECT doc_id AS entry, 'ngoko' AS register, count(*) AS n, md5(string_agg(w, chr(10) ORDER BY i)) AS digest FROM f GROUP BY doc_id
UNION ALL SELECT doc_id, 'krama inggil', 1, md5(source) FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""",
}
