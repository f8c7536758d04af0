"""Dictionary entries out of wiki pages: language sections, blocks by part of speech, definitions, level boxes, synonyms.

Sections, blocks and definitions are cut by arrays within a row; only a page's own definitions meet again, by page and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import templates as P
from sparkloom.functions.text import nfd_bare

# fixed values: part of speech by subheading
POS = {
    "n": "nomina", "nomina": "nomina", "nom": "nomina", "kata benda": "nomina", "k_b": "nomina", "v": "verba", "verba": "verba", "verb": "verba", "kata kerja": "verba", "k_k": "verba",
    "a": "adjektiva", "adj": "adjektiva", "adjektiva": "adjektiva", "kata sifat": "adjektiva", "k_s": "adjektiva", "adv": "adverbia", "adverbia": "adverbia", "adverb": "adverbia",
    "pron": "pronomina", "pronomina": "pronomina", "num": "numeralia", "numeralia": "numeralia", "p": "partikel", "part": "partikel", "partikel": "partikel", "ptcl": "partikel",
    "prep": "preposisi", "preposisi": "preposisi", "conj": "konjungsi", "konjungsi": "konjungsi", "kon": "konjungsi", "intj": "interjeksi", "interjeksi": "interjeksi",
    "pn": "nama diri", "nama diri": "nama diri", "akhiran": "akhiran", "suf": "akhiran", "awalan": "awalan", "frasa": "frasa", "art": "artikula", "artikula": "artikula",
    "akronim": "singkatan", "singkatan": "singkatan", "definisi": "",
}
# fixed values: subheadings that close no block, placeholders, headings of the language and their dialects, levels of boxes
NEUTRAL = ("lafal", "pelafalan", "pengucapan")
PLACEHOLDERS = ("def", "definisi", "definisi/terjemah", "terjemah", "contoh", "arti")
LANGUAGE = r"(?i)\{\{bahasa\s*\|\s*jv\}\}|\{\{bhs\|jv\}\}|\[\[bahasa jawa\]\]|\{\{(jawa(?: [a-z ]+)?|semarang)\}\}(?: (kedu))?"
DIALECTS = {"jawa kedu": "Kedu", "kedu": "Kedu", "semarang": "Semarang", "jawa krama inggil": "krama inggil", "jawa ngoko": "ngoko", "jawa ngapak": "Banyumas"}
LEVELS = {"n": "ngoko", "m": "madya", "k": "krama", "ki": "krama inggil", "ka": "krama andhap"}
HEADING = r"(?dm)^==[ \t]*([^=\n][^\n]*?)[ \t]*==[ \t]*$"
SUBHEAD = r"(?dm)^[ \t]*(?:\{\{-([^|{}\n]+?)-(?:\|[^{}\n]*)?\}\}|={3,}[ \t]*(?:\{\{)?([^={}|\n]+?)(?:\}\})?[ \t]*={3,})[^\n]*$"
IMPORTED = r"\{\{rfv\|jv\|[^{}]*KBBI|\{\{R:KBBI"
POINTER = r"^(?:ragam|bentuk|sinonim) [a-z ]*dari "
NO_GLOSS, COPIED, NO_TITLE = "empty or repeats its title", "imported section", "title without letters"


def _map(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.coalesce(key, F.lit("")))


def _bare(text: Column) -> Column:
    """nfd_bare, without sending plain ASCII to Python."""
    return F.coalesce(nfd_bare(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _cut(text: Column, mark: str) -> Column:
    """Pieces of a text between the matches of a pattern: one more than there are matches."""
    return F.split(text, mark, -1)


def _shown(text: Column) -> Column:
    """A text with each link as it is shown."""
    return F.regexp_replace(text, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")


def sections(pages: DataFrame) -> DataFrame:
    """(page, title, section, dialect, copied, body) of the language's sections of pages (page, title, text), numbered by their place from 1.

    Null texts and titles have none. Copied sections hold marks of an import that is not to be taken.
    """
    heads = F.regexp_extract_all("text", F.lit(HEADING), F.lit(1))
    pieces = F.arrays_zip(heads.alias("head"), F.slice(_cut(F.col("text"), HEADING), 2, 2**31 - 1).alias("body"))
    found = pages.where("text is not null and title is not null").select("page", "title", F.posexplode(pieces).alias("section", "s")).select("page", "title", (F.col("section") + 1).alias("section"), F.trim("s.head").alias("head"), "s.body")
    own = found.where(F.col("head").rlike(f"^(?:{LANGUAGE})$"))
    named = [F.nullif(F.regexp_extract("head", LANGUAGE, g), F.lit("")) for g in (2, 1)]
    return own.select("page", "title", "section", _map(DIALECTS, F.lower(F.coalesce(*named))).alias("dialect"), F.col("body").rlike(IMPORTED).alias("copied"), "body")


def blocks(found: DataFrame) -> DataFrame:
    """(page, title, section, dialect, piece, block, pos, body) of sections: what stands under a part of speech, and under neutral subheadings after it.

    What stands under any other subheading belongs to no block. Block 0 is before the first subheading and has no part of speech.
    """
    either = F.transform(F.regexp_extract_all("body", F.lit(SUBHEAD), F.lit(0)), lambda m: F.lower(F.trim(F.coalesce(F.nullif(F.regexp_extract(m, SUBHEAD, 1), F.lit("")), F.regexp_extract(m, SUBHEAD, 2)))))
    named = found.withColumn("_names", F.concat(F.array(F.lit("definisi")), either)).withColumn("_bodies", _cut(F.col("body"), SUBHEAD))
    # the block of each piece is the last subheading up to it that is not neutral
    start = F.struct(F.array().cast("array<int>").alias("of"), F.lit(0).alias("last"))
    opened = lambda acc, i: F.when(F.get("_names", i).isin(*NEUTRAL), acc["last"]).otherwise(i)
    numbered = F.aggregate(F.sequence(F.lit(0), F.size("_names") - 1), start, lambda acc, i: F.struct(F.array_append(acc["of"], opened(acc, i)).alias("of"), opened(acc, i).alias("last")))["of"]
    pieces = named.select("page", "title", "section", "dialect", "_names", F.posexplode(F.arrays_zip(numbered.alias("block"), F.col("_bodies").alias("body"))).alias("piece", "p"))
    return pieces.select("page", "title", "section", "dialect", "piece", F.col("p.block").alias("block"), _map(POS, F.get("_names", F.col("p.block"))).alias("pos"), F.col("p.body").alias("body")).where("pos is not null")


def glosses(defs: DataFrame) -> DataFrame:
    """Definition lines (title, dialect, line, ...) with `gloss`: its text with its labels in front, '' where it is no gloss.

    Typed labels in brackets count as labels, a repeated title before its meaning goes, and so do placeholders and lines that only repeat the title or
    spell with marks of the other language, unless they point to another word.
    """
    read = defs.withColumn("_d", P.wiki_line(F.element_at(F.split("line", r"(?i)<br\s*/?>", 2), 1)))
    typed = r"(?s)^\(([^()]{1,30})\)\s*(.+)$"
    is_typed = F.col("_d.text").rlike(typed)
    read = read.withColumn("_labels", F.when(is_typed, F.array_append("_d.labels", F.regexp_extract("_d.text", typed, 1))).otherwise(F.col("_d.labels")))
    read = read.withColumn("_text", F.when(is_typed, F.regexp_extract("_d.text", typed, 2)).otherwise(F.col("_d.text")))
    echo = r"(?s)^(.+?)\s*(?:[;:]\s*(.+)|\((.+)\))$"
    read = read.withColumn("_lead", F.regexp_extract("_text", echo, 1))
    rest = F.btrim(F.coalesce(F.nullif(F.regexp_extract("_text", echo, 2), F.lit("")), F.regexp_extract("_text", echo, 3)), F.lit(" ;,:"))
    # what is compared without marks goes to Python at one place, as each place has a worker of its own in every task
    read = read.withColumn("_rest", rest).withColumns({f"_plain_{c}": F.lower(F.trim(_bare(F.col(c)))) for c in ("title", "_lead", "_text", "_rest")})
    echoed = (F.col("_lead") != "") & (F.col("_plain__lead") == F.col("_plain_title"))
    read = read.withColumn("_same", F.when(echoed, F.col("_plain__rest")).otherwise(F.col("_plain__text")) == F.col("_plain_title"))
    read = read.withColumn("_text", F.when(echoed, F.col("_rest")).otherwise(F.col("_text")))
    foreign = F.col("_text").rlike("(?iu)[êéè]") & ~F.col("_text").rlike(POINTER)
    void = (F.col("_text") == "") | F.col("_same") | F.lower("_text").isin(*PLACEHOLDERS) | foreign | (F.col("_d.open") > 0)
    labels = F.array_distinct("_labels")
    shown = F.concat(F.when(F.size(labels) > 0, F.concat(F.lit("("), F.array_join(labels, ", "), F.lit(") "))).otherwise(""), F.col("_text"))
    shown = F.when(F.col("dialect").isNotNull() & ~shown.startswith("("), F.concat(F.lit("("), F.col("dialect"), F.lit(") "), shown)).otherwise(shown)
    return read.withColumn("gloss", F.when(void, "").otherwise(shown)).drop("_d", "_labels", "_text", "_lead", "_rest", "_same", *[f"_plain_{c}" for c in ("title", "_lead", "_text", "_rest")])


def page_entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, counts of what was skipped by reason) of pages (page, title, text); page is a key.

    entries: (page, title, section, block, pos, glosses, note), one for each block with a gloss. Glosses are listed once, in order. The note names the
    forms of the block's level boxes that differ from the title, then the synonyms of its definitions. Examples are not read.
    """
    titled = pages.withColumn("_letters", _bare(F.col("title")).rlike("(?i)[a-z]"))
    found = sections(titled.where("_letters").select("page", "title", "text"))
    parts = blocks(found.where("not copied"))
    cut = F.slice(_cut(F.col("body"), r"(?dm)^#(?![:*#])"), 2, 2**31 - 1)
    listed = parts.select("page", "title", "section", "dialect", "block", "pos", "piece", F.posexplode(cut).alias("_n", "part"))
    one = listed.select("*", F.regexp_extract("part", r"(?d)^([^\n]*)", 1).alias("line"), F.filter(P.templates(F.array_join(F.regexp_extract_all("part", F.lit(r"(?dm)^#:([^\n]*)$"), F.lit(1)), "\n")), lambda t: t["name"].isin("syn", "sinonim", "sin")).alias("_syn"))
    read = glosses(one)
    words = F.flatten(F.transform("_syn", lambda t: F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(t["args"]))), lambda i: F.try_element_at(t["args"], i.cast("string")) != ""), lambda i: F.concat(_shown(F.try_element_at(t["args"], i.cast("string"))), F.coalesce(F.concat(F.lit(" ("), F.try_element_at(t["args"], F.lit("q")), F.lit(")")), F.lit(""))))))
    at = F.struct(F.col("section"), F.col("block"), F.col("piece"), F.col("_n"))
    kept = read.where("gloss <> ''").select("page", "title", "section", "block", "pos", at.alias("_at"), "gloss", words.alias("_words"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_at", c))), lambda x: x[c])
    entries = kept.groupBy("page", "section", "block").agg(F.first("title").alias("title"), F.first("pos").alias("pos"), F.array_distinct(in_order("gloss")).alias("glosses"), F.array_distinct(F.flatten(in_order("_words"))).alias("_words"))
    boxes = parts.where(F.col("body").contains("{{jvword")).select("page", "title", "section", "block", F.explode(P.templates("body")).alias("t")).where("t.name = 'jvword'")
    plain = lambda c: F.lower(F.trim(_bare(c if isinstance(c, Column) else F.col(c))))
    forms = boxes.select("page", "section", "block", F.array_join(F.filter(F.array(*[F.when((F.trim(v) != "") & (plain(v) != plain("title")), F.concat(F.lit(f"{level} "), F.trim(v))) for k, level in LEVELS.items() for v in [F.try_element_at("t.args", F.lit(k))]]), lambda x: x.isNotNull()), " · ").alias("_box"), F.col("t.at").alias("_place"))
    last = forms.groupBy("page", "section", "block").agg(F.max_by("_box", "_place").alias("_box"))
    known = F.when(F.size("_words") > 0, F.concat(F.lit("sinonim: "), F.array_join("_words", ", ")))
    note = F.concat_ws("; ", F.nullif("_box", F.lit("")), known)
    entries = entries.join(last, ["page", "section", "block"], "left").select("page", "title", "section", "block", F.nullif("pos", F.lit("")).alias("pos"), "glosses", F.nullif(note, F.lit("")).alias("note"))
    why = [titled.where(~F.col("_letters")).select(F.lit(NO_TITLE).alias("reason")), found.where("copied").select(F.lit(COPIED).alias("reason")), read.where("gloss = ''").select(F.lit(NO_GLOSS).alias("reason"))]
    return entries, why[0].unionByName(why[1]).unionByName(why[2]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
