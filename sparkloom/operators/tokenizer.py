"""Building the reorder table of a script from syllable counts and votes on visual orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X


def vocabulary(lines: DataFrame, text: str) -> DataFrame:
    """(ch, n, id): characters in code-point order, ids from 1 (0 is the blank). As few rows as the charset."""
    n = lines.select(F.explode(F.split(text, "", -1)).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("id", F.row_number().over(Window.orderBy("ch")))


def encoded(lines: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(key, ids); a character out of the vocabulary raises."""
    table = F.broadcast(vocab.agg(F.map_from_entries(F.collect_list(F.struct("ch", "id"))).alias("m")))
    one = lambda c: F.coalesce(F.col("m")[c], F.raise_error(F.concat(F.lit("not in the vocabulary: "), c)).cast("int"))
    return lines.crossJoin(table).select(key, F.transform(F.filter(F.split(text, "", -1), lambda c: c != ""), one).alias("ids"))


def syllable_counts(lines: DataFrame, text: str, times: str | None = None) -> DataFrame:
    """(syllable, n) of syllables of two characters and more; `times`: a column that says how often a row stands."""
    n = F.count(F.lit(1)) if times is None else F.sum("_times")
    many = F.lit(1) if times is None else F.col(times)
    return lines.select(many.alias("_times"), F.explode(X.logical_syllables(F.col(text))).alias("syllable")).where(F.length("syllable") > 1).groupBy("syllable").agg(n.alias("n"))


def written_words(lines: DataFrame, text: str, write) -> DataFrame:
    """(script, times): the different space-parted words of the lines in the script by write(column), each written once, and how often they stand."""
    words = lines.select(F.explode(F.split(text, " ", -1)).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    return X.spread(words).select(write("word").alias("script"), "times")


def consensus(votes: DataFrame) -> DataFrame:
    """(syllable, perm) of votes (syllable, perm, votes): most votes, then fewest inversions, then the smaller order."""
    leading = F.dense_rank().over(Window.partitionBy("syllable").orderBy(F.desc("votes")))
    ahead = votes.withColumn("r", leading).where("r = 1")
    # only orders with as many votes as another one of their syllable are looked into
    tied = ahead.withColumn("_tied", F.count(F.lit(1)).over(Window.partitionBy("syllable")) > 1)
    w = Window.partitionBy("syllable").orderBy(F.when(F.col("_tied"), X.inversions(F.col("perm"))), "perm")
    return tied.withColumn("r", F.row_number().over(w)).where("r = 1").select("syllable", "perm")


def before_base(counts: DataFrame, agreed: DataFrame) -> DataFrame:
    """(mark, total, before, rate): how often a mark is drawn before its syllable's base (position 0)."""
    one = counts.join(agreed, "syllable").select("syllable", "n", "perm", (F.array_position("perm", 0) - 1).alias("base"), F.posexplode("perm").alias("place", "j"))
    marks = one.where("j <> 0").withColumn("mark", F.substring("syllable", F.col("j") + 1, F.lit(1))).where(~F.col("mark").rlike(f"^{X.LETTER}$"))
    out = marks.groupBy("mark").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("place") < F.col("base"), F.col("n")).otherwise(0)).alias("before"))
    return out.withColumn("rate", F.col("before") / F.col("total"))


def reorder_table(counts: DataFrame, rates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(pattern, visual, perm, n, kept): canonical orders; of patterns that look alike only the most frequent is kept."""
    pre = F.broadcast(rates.where(F.col("rate") > threshold).agg(F.collect_list("mark").alias("prebase")))
    perm = X.canonical_permutation(F.col("syllable"), F.col("prebase"))
    each = counts.crossJoin(pre).select(X.syllable_pattern(F.col("syllable")).alias("pattern"), perm.alias("perm"), "n")
    table = each.groupBy("pattern", "perm").agg(F.sum("n").alias("n"))
    parts = F.split("pattern", " ")
    table = table.withColumn("visual", F.array_join(F.transform("perm", lambda i: F.get(parts, i)), " "))
    w = Window.partitionBy("visual").orderBy(F.desc("n"), "pattern")
    return table.withColumn("kept", F.row_number().over(w) == 1)
