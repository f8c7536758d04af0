"""Validation, selection, usage and card operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import line_scores as L
from sparkloom.functions import text as X
from sparkloom.functions.metrics import ratio
from sparkloom.functions.templates import without_templates

# slant groups of the evaluation fixture as (name, from, below)
SLANTS = (("upright", float("-inf"), 0.1), ("slanted", 0.1, 0.3), ("steep", 0.3, float("inf")))


def label_violations(rows: DataFrame, key: str, text: str, vocab: str) -> DataFrame:
    """(key, problem) of label rows: blank or repeated keys, empty texts, characters out of a regex class, stray marks."""
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    blank = F.coalesce(F.trim(key) == "", F.lit(True))
    rules = {
        "blank key": blank, "repeated key": ~blank & (F.col("_n") > 1), "empty text": F.coalesce(F.col(text) == "", F.lit(True)),
        "unknown characters": F.col(text).rlike(f"[^{vocab}]"), "stray mark": ~X.is_well_formed(F.col(text)),
    }
    found = F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()])
    return rows.select(F.col(key).alias("key"), F.explode(F.array_compact(found)).alias("problem"))


def trailing_number(source: Column) -> Column:
    """The number after the last underscore, null if there is none."""
    tail = F.regexp_extract(source, r"([^_]*)$", 1)
    return F.when(tail.rlike(r"^\d+$"), tail.cast("int"))


def in_ranges(rows: DataFrame, value: str, ranges: list[tuple[str, float, float]]) -> DataFrame:
    """Rows with the name of the first range from <= value < below. The ranges are a handful."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "ord int, grp string, lo double, hi double")
    met = rows.join(F.broadcast(table), (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")), "left")
    return met.drop("ord", "lo", "hi")


def tags(**rules: Column) -> Column:
    """Names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))


def interval_violations(cells: DataFrame, key: list[str], lo: str, value: str, hi: str, known: DataFrame | None = None) -> DataFrame:
    """(key..., problem): repeated cells, values out of 0..1, unordered intervals, methods that are not known."""
    cells = cells.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    found = [F.when(F.col("_n") > 1, F.lit("repeated")), F.when(~F.col(value).between(0, 1), F.lit("out of range")), F.when((F.col(lo) > F.col(hi)) | ~F.col(value).between(F.col(lo), F.col(hi)), F.lit("interval"))]
    out = cells.select(*key, F.explode(F.array_compact(F.array(*found))).alias("problem"))
    if known is not None:
        out = out.unionByName(cells.join(known, key[0], "left_anti").select(*key, F.lit("unknown").alias("problem")))
    return out


def dictionary_rows(entries: DataFrame, word: str, glosses: str, examples: str, url: str) -> DataFrame:
    """Entries with at most 3 examples of at most 300 characters and only http(s) links; `problem` where they do not do."""
    short = F.slice(F.filter(examples, lambda e: F.length(e) <= 300), 1, 3)
    problem = F.when(F.coalesce(F.trim(word) == "", F.lit(True)), "no word").when(F.length(word) > 190, "long word").when(F.coalesce(F.size(glosses) < 1, F.lit(True)), "no gloss")
    return entries.withColumn(examples, short).withColumn(url, F.when(F.col(url).rlike("^https?://"), F.col(url))).withColumn("problem", problem)


def review_import(drafts: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """(outcome, n): drafts confirmed, corrected, without a usable review, and reviews of unknown drafts."""
    met = drafts.select(key, "draft").join(reviews.select(F.col(key).alias("_k"), "status", "text"), F.col(key) == F.col("_k"), "full_outer")
    outcome = F.when(F.col(key).isNull(), "unknown").when(F.col("status") == "benar", "confirmed").when((F.col("status") == "koreksi") & (F.trim("text") != ""), "corrected").when(F.col("status").isNull(), "open").otherwise("excluded")
    return met.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def pending_conditions(lines: DataFrame, conditions: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Every line under every condition (few rows) that the cache does not hold."""
    return lines.crossJoin(F.broadcast(conditions)).join(cache.select(*keys).distinct(), keys, "left_anti")


def equal_except(a: Column, b: Column, keys: list[str]) -> Column:
    """Whether two argument maps agree outside `keys`."""
    rest = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: ~k.isin(keys))))
    return rest(a) == rest(b)


def nearest_valid(chain: DataFrame, valid: DataFrame, node: str, ancestor: str, distance: str) -> DataFrame:
    """For each node the valid ancestor of least distance."""
    met = chain.join(valid, chain[ancestor] == valid["_valid"])
    return met.groupBy(node).agg(F.min(F.struct(distance, ancestor)).alias("b")).select(node, F.col("b")[ancestor].alias(ancestor), F.col("b")[distance].alias(distance))


def homoglyphs(steps: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(ref, hyp, n) of substitutions between listed look-alikes, both ways; pairs that do not occur count 0."""
    spark = steps.sparkSession
    both = spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "ref string, hyp string")
    n = steps.where("tag = 'replace'").groupBy(F.col("r").alias("ref"), F.col("h").alias("hyp")).agg(F.count(F.lit(1)).alias("n"))
    return both.join(n, ["ref", "hyp"], "left").select("ref", "hyp", F.coalesce("n", F.lit(0)).alias("n"))


def homoglyphs_read(rows: DataFrame, ref: str, hyp: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """homoglyphs of texts and their readings, counted where they are aligned: no step becomes a row."""
    both = [p for a, b in pairs for p in ((a, b), (b, a))]
    total = rows.select(L.substitutions(F.col(ref), F.col(hyp), both).alias("n")).agg(*[F.coalesce(F.sum(F.get("n", F.lit(k))), F.lit(0)).cast("long").alias(f"n{k}") for k in range(len(both))])
    return total.select(F.inline(F.array(*[F.struct(F.lit(x).alias("ref"), F.lit(y).alias("hyp"), F.col(f"n{k}").alias("n")) for k, (x, y) in enumerate(both)])))


def subpopulation(rows: DataFrame, group: str, inside: Column, num: str, den: str) -> DataFrame:
    """A ratio over part of the rows with the others at weight 0, so that all groups stay."""
    w = F.when(inside, 1).otherwise(0)
    return rows.groupBy(group).agg(F.round(ratio(F.sum(F.col(num) * w), F.sum(F.col(den) * w)), 9).alias("rate"), F.sum(w).alias("inside"))


def best_setting(reports: DataFrame, loss: str, key: str, shared: list[str]) -> DataFrame:
    """The report of least loss; `consistent` tells whether all reports share the given settings."""
    return reports.agg(F.min_by(key, F.struct(loss, key)).alias(key), F.min(loss).alias(loss), (F.count_distinct(F.struct(*shared)) == 1).alias("consistent"))


def usage(segments: DataFrame, run: str, batch: str, pool: str) -> DataFrame:
    """Steps, samples and scheduled share of each run from its effective segments (first, last)."""
    steps = F.sum(F.col("last") - F.col("first"))
    return segments.groupBy(run).agg(steps.alias("steps"), F.sum((F.col("last") - F.col("first")) * F.col(batch)).alias("samples"), F.max(pool).alias("pool")).withColumn("share", F.round(F.least(F.lit(1.0), ratio(F.col("samples"), F.col("pool"))), 9))


def cost_per_thousand(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float, lines: Column) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6 * 1000 / F.nullif(lines, F.lit(0))


def warm_mean(rows: DataFrame, group: str, order: list[str], value: str, skip: int = 3) -> DataFrame:
    """Mean latency without the first `skip` calls of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_p", place).groupBy(group).agg(F.round(F.avg(F.when(F.col("_p") > skip, F.col(value))), 6).alias("mean"), F.count_if(F.col("_p") > skip).alias("n"))


def estimate_full(measured: DataFrame, grid: DataFrame, form: str, x: str, y: str) -> DataFrame:
    """Total cost of a grid (form, x, times) from straight lines per form; null if a form has no measurement."""
    one = F.count_distinct(x) == 1
    fit = measured.groupBy(form).agg(F.when(one, F.lit(0.0)).otherwise(F.regr_slope(y, x)).alias("slope"), F.when(one, F.avg(y)).otherwise(F.regr_intercept(y, x)).alias("base"))
    cost = F.greatest(F.lit(0.0), F.col("base") + F.col("slope") * F.col(x)) * F.col("times")
    met = grid.join(F.broadcast(fit), form, "left")
    return met.agg(F.when(F.count_if(F.col("base").isNull()) == 0, F.round(F.sum(cost), 4)).alias("total"), F.count_distinct(F.when(F.col("base").isNull(), F.col(form))).alias("unmeasured"))


def cumulative_config(ops: Column, k: Column) -> Column:
    return F.array_join(F.slice(ops, F.lit(1), k), "+")


def last_value(rows: DataFrame, group: str, value: str, seq: str) -> DataFrame:
    """The last value that is not null, in order of `seq`."""
    return rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.max_by(value, seq).alias(value))


def official(pipelines: DataFrame, flag: str, key: str, default: str) -> DataFrame:
    """The first flagged pipeline, else the default."""
    return pipelines.agg(F.coalesce(F.min(F.when(F.col(flag), F.col(key))), F.lit(default)).alias(key))


def stale(cards: DataFrame, current: DataFrame, card_run: str, run: str) -> DataFrame:
    return cards.crossJoin(F.broadcast(current.select(F.col(run).alias("_run")))).withColumn("stale", ~F.col(card_run).eqNullSafe(F.col("_run"))).drop("_run")


def name_entries(entries: DataFrame, word: str, spelling: str, special: str, seq: str) -> DataFrame:
    """Capitalised one-word lemmas whose spelling has a special letter, the first by `seq`; `ordinary` if also a common word."""
    names = entries.where(F.col(word).rlike(r"^\p{Lu}[\p{L}\p{M}]*$") & F.col(spelling).rlike(special))
    first = names.groupBy(F.lower(word).alias("name")).agg(F.min_by(spelling, seq).alias("spelling"))
    plain = entries.where(F.col(word).rlike(r"^\p{Ll}[\p{L}\p{M}]*$")).select(F.col(word).alias("name"), F.lit(True).alias("o")).distinct()
    return first.join(plain, "name", "left").select("name", "spelling", F.coalesce("o", F.lit(False)).alias("ordinary"))


WIKI_LINK = r"\[\[([^\[\]]*)\]\]"
WIKI_MEDIA = ("file", "image", "category", "berkas", "kategori")


def wiki_to_text(source: Column) -> Column:
    """Plain text of wiki markup: comments, references, templates (of any depth), links, tags and quotes.

    A link shows what follows its last bar; links into media and category spaces show nothing; an outer link its caption.
    """
    out = source
    for gone in (r"(?s)<!--.*?-->", r"(?s)<ref\b[^>/]*>.*?</ref\s*>", r"<ref\b[^>]*/\s*>"):
        out = F.regexp_replace(out, gone, "")
    out = without_templates(out)
    for space in WIKI_MEDIA:
        out = F.regexp_replace(out, rf"(?i)\[\[\s*{space}\s*:[^\[\]]*\]\]", "")
    # the text between links and the links themselves take turns
    plain, links = F.split(out, WIKI_LINK, -1), F.regexp_extract_all(out, F.lit(WIKI_LINK), F.lit(1))
    shown = F.transform(links, lambda x: F.element_at(F.split(x, r"\|", -1), -1))
    out = F.array_join(F.zip_with(plain, shown, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    out = F.regexp_replace(out, r"\[(?:https?:)?//[^\s\]]+\s*", "[").cast("string")
    out = F.translate(out, "[]", "")
    return X.markup_to_text(F.regexp_replace(out, "''+", ""))


def wiki_senses(pages: DataFrame, title: str, source: str) -> DataFrame:
    """(title, language, pos, seq, gloss): numbered lines under level-3 heads of level-2 language sections."""
    lines = pages.select(F.col(title).alias("title"), F.posexplode(F.split(source, "\n")).alias("seq", "line"))
    w = Window.partitionBy("title").orderBy("seq")
    head = lambda n: F.nullif(F.regexp_extract("line", rf"^={{{n}}}\s*([^=]+?)\s*={{{n}}}\s*$", 1), F.lit(""))
    at = lines.withColumn("language", F.last(head(2), ignorenulls=True).over(w)).withColumn("_two", F.last(F.when(head(2).isNotNull(), F.col("seq")), ignorenulls=True).over(w)).withColumn("_three", F.last(F.when(head(3).isNotNull(), F.struct("seq", head(3).alias("pos"))), ignorenulls=True).over(w))
    own = at.where(F.col("line").rlike("^# ?[^#*:]"))
    return own.select("title", "language", F.when(F.col("_three.seq") > F.col("_two"), F.col("_three.pos")).alias("pos"), "seq", wiki_to_text(F.regexp_replace("line", "^# ?", "")).alias("gloss")).where("language is not null")
