"""Dictionary building: sense trees, pointers between titles, register sets, spellings read as words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import senses as S
from sparkloom.functions import templates as P
from sparkloom.functions.text import nfd_bare_once, spread
from sparkloom.operators.lineage import ancestry

# fixed values: register labels of head templates, and column heads of register tables
HEAD_REGISTER = {
    "ngoko": "ngoko", "ngoko lugu": "ngoko", "ngoko alus": "ngoko alus", "krama ngoko": "krama-ngoko", "krama-ngoko": "krama-ngoko", "ngoko-krama": "krama-ngoko", "madya": "madya", "krama madya": "madya",
    "krama": "krama", "krama lugu": "krama", "krama alus": "krama alus", "krama inggil": "krama inggil", "krama andhap": "krama andhap", "kawi": "kawi",
}
TABLE_REGISTER = {"ꦔꦺꦴꦏꦺꦴ": "ngoko", "ꦏꦿꦩ": "krama", "ꦏꦿꦩꦲꦶꦁꦒꦶꦭ꧀": "krama inggil", "ꦏꦿꦩꦔꦺꦴꦏꦺꦴ": "krama-ngoko", "ꦏꦿꦩꦲꦤ꧀ꦝꦥ꧀": "krama andhap", "ꦏꦮꦶ": "kawi"}
TABLE_HEAD = "Javanese register set"


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut by checkpoint() in the session's shared folder; kept in the session where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def best_pointers(candidates: DataFrame, node: str, to: str, rank: str) -> DataFrame:
    """(node, to): the candidate of least rank of each node, ties by the smaller target. Null targets are no candidates."""
    best = candidates.where(F.col(to).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(F.struct(F.col(rank).alias("r"), F.col(to).alias("to"))).alias("b"))
    return best.select("node", F.col("b.to").alias("to"))


def resolved(nodes: DataFrame, pointers: DataFrame) -> DataFrame:
    """(node, end, hops, status) by following one pointer (node, to) per node to its end.

    status: `root` (the end has no pointer), `missing` (the last pointer leads to no node; end is its target), `cycle` (end and hops null). Pointers double
    in each round, so chains of n take log2 n rounds. When a round settles no node, the rest leads into cycles: a chain
    that is still open would have shorter ones behind it that closed in this round. Rows that repeat a node count once; a null node is left out.
    """
    own = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct()
    known = own.select(F.col("node").alias("to"), F.lit(True).alias("known"))
    first = own.join(pointers.select("node", "to"), "node", "left").join(known, "to", "left")
    status = F.when(F.col("to").isNull(), "root").when(F.col("known").isNull(), "missing").otherwise("open")
    now = cut(first.select("node", F.coalesce("to", "node").alias("end"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("hops"), status.alias("status")))
    left = now.where("status = 'open'").count()
    while left:
        onward = now.select(F.col("node").alias("end"), F.col("end").alias("_end"), F.col("hops").alias("_hops"), F.col("status").alias("_status"))
        moved = now.where("status = 'open'").join(onward, "end").select("node", F.col("_end").alias("end"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_status").alias("status"))
        last, now = now, cut(now.where("status <> 'open'").unionByName(moved))
        before, left = left, now.where("status = 'open'").count()
        last.unpersist()
        if left == before:
            break
    looped = F.col("status") == "open"
    return now.select("node", F.when(~looped, F.col("end")).alias("end"), F.when(~looped, F.col("hops")).alias("hops"), F.when(looped, "cycle").otherwise(F.col("status")).alias("status"))


def sense_chains(senses: DataFrame) -> DataFrame:
    """(sense, chain): the glosses from the outermost parent to each sense of a table (sense, parent, gloss), at any depth.

    Null glosses are left out of the chain; a parent that is no sense ends it.
    """
    up = ancestry(senses, "sense", "parent").where("status = 'ok'")
    met = up.join(senses.select(F.col("sense").alias("ancestor"), "gloss"), "ancestor")
    chain = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "gloss"))), lambda x: x["gloss"])
    return met.groupBy(F.col("node").alias("sense")).agg(F.filter(chain, lambda x: x.isNotNull()).alias("chain"))


def _known(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)


def register_sets(entries: DataFrame) -> DataFrame:
    """(entry, register, words) of entries (entry, word, source, forms): from head templates in wiki source, and from canonical forms that hold a register table.

    A head template names (register, words) in its arguments from the third on, by pairs. A table's columns are `head : words`, and the word itself may
    trail the last of them. Words are listed once, in order of their first place.
    """
    heads = entries.select("entry", F.explode(P.templates("source")).alias("t")).where(F.lower("t.name").isin("head", "kepala"))
    number = F.expr("try_cast(key as int)")
    args = heads.select("entry", F.col("t.at").alias("at"), "t.args", F.explode("t.args").alias("key", "label")).withColumn("n", number)
    pairs = args.where("n >= 3 and n % 2 = 1").select("entry", F.lit(0).alias("kind"), F.struct("at", "n").alias("place"), _known(HEAD_REGISTER, F.lower(F.trim("label"))).alias("register"), F.try_element_at("args", (F.col("n") + 1).cast("string")).alias("words"))
    joined = entries.select("entry", "word", F.posexplode(F.slice(F.split(F.array_join("forms", ", "), TABLE_HEAD, -1), 2, 2**31 - 1)).alias("part", "table"))
    columns = F.regexp_extract_all(S.mend(F.trim("table")), F.lit(rf"({S.SCRIPT}+) : (.*?)(?= {S.SCRIPT}+ : |$)"), F.lit(0))
    cells = joined.select("entry", "word", "part", F.size(columns).alias("many"), F.posexplode(columns).alias("n", "cell"))
    value = F.regexp_extract("cell", r"^\S+ : (.*)$", 1)
    tokens = F.filter(F.split(value, r"\s+", -1), lambda x: x != "")
    trailing = (F.col("n") == F.col("many") - 1) & (F.size(tokens) > 1) & (F.try_element_at(tokens, F.lit(-1)) == F.col("word"))
    value = F.array_join(F.when(trailing, F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens), " ")
    table = cells.select("entry", F.lit(1).alias("kind"), F.struct(F.col("part").alias("at"), "n").alias("place"), _known(TABLE_REGISTER, F.regexp_extract("cell", r"^(\S+) : ", 1)).alias("register"), value.alias("words"))
    found = pairs.unionByName(table).where("register is not null").withColumn("words", S.register_words(F.coalesce("words", F.lit("")))).where("size(words) > 0")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("kind", "place", "words"))), lambda x: x["words"])
    return found.groupBy("entry", "register").agg(F.array_distinct(F.flatten(in_order)).alias("words"))


def read_as(spellings: DataFrame, words: DataFrame, spelling: str, word: str) -> DataFrame:
    """(spelling, word): every spelling in script that can be read as a word, an equi-join of their phonetic forms."""
    a, b = _forms(spellings, words, spelling, word)
    return a.join(b, "_form").select("spelling", "word")


def read_as_counts(spellings: DataFrame, words: DataFrame, spelling: str, word: str) -> DataFrame:
    """(spelling, words): how many words each spelling can be read as, without their pairs: words are counted by phonetic form. Spellings without one are left out."""
    a, b = _forms(spellings, words, spelling, word)
    return a.join(b.groupBy("_form").agg(F.count(F.lit(1)).alias("words")), "_form").select("spelling", "words")


def _forms(spellings: DataFrame, words: DataFrame, spelling: str, word: str) -> tuple[DataFrame, DataFrame]:
    a = spread(spellings.select(F.col(spelling).alias("spelling")).distinct()).withColumn("_form", S.phonetic_script("spelling"))
    b = spread(words.select(F.col(word).alias("word")).distinct()).withColumn("_form", S.phonetic_latin(nfd_bare_once("word")))
    return a, b


def definitions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, counts by status) of definition lines (title, seq, line): text and labels; lines with open templates or without a text are skipped and counted."""
    seen = lines.select("title", "seq", P.wiki_line(F.regexp_replace("line", "^#+ ?", "")).alias("d")).select("title", "seq", "d.*")
    status = F.when(F.col("open") > 0, "open template").when(F.col("text") == "", "no gloss").when(F.lower("text") == F.lower("title"), "title only").otherwise("kept")
    seen = seen.withColumn("status", status)
    gloss = F.concat(F.when(F.size("labels") > 0, F.concat(F.lit("("), F.array_join("labels", ", "), F.lit(") "))).otherwise(""), "text")
    return seen.where("status = 'kept'").select("title", "seq", gloss.alias("gloss")), seen.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
