"""Ranked dictionary search and glosses over entries (id, dictionary, word, lookup, gloss_lang, gloss_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CONTAINS = 3
REVERSE_LIMIT = 12


def rank() -> list[Column]:
    """Indonesian glosses first, then Javanese, then shorter words, then byte order and id."""
    lang = F.when(F.col("gloss_lang") == "id", 0).when(F.col("gloss_lang") == "jv", 1).otherwise(2)
    return [lang, F.length("lookup"), F.col("lookup"), F.col("id")]


def tiers(entries: DataFrame, needle: str, limit: int) -> DataFrame:
    """Matches by tier (0 equal, 1 beginning, 2 within, the last for needles of 3 or more), in one scan and one top-k.

    `total` is the number of all matches.
    """
    look = F.col("lookup")
    tier = F.when(look == needle, 0).when(look.startswith(needle), 1)
    if len(needle) >= MIN_CONTAINS:
        tier = tier.when(look.contains(needle), 2)
    found = entries.withColumn("tier", tier).where("tier is not null")
    total = F.broadcast(found.agg(F.count(F.lit(1)).alias("total")))
    return found.orderBy("tier", *rank()).limit(limit).crossJoin(total)


def effective_needle(entries: DataFrame, needle: str) -> str:
    """A typed affix ("-an") falls back to the word without hyphen if only that is an entry."""
    bare = needle.lstrip("- ")
    if bare == needle or not bare:
        return needle
    has = entries.agg(F.count_if(F.col("lookup") == needle).alias("own"), F.count_if(F.col("lookup") == bare).alias("bare")).first()
    return bare if not has["own"] and has["bare"] else needle


def reverse(entries: DataFrame, needle: str, limit: int = REVERSE_LIMIT) -> DataFrame:
    """Entries whose gloss holds the word and whose own word does not, shortest gloss first."""
    own = entries.where(F.col("gloss_text").contains(f" {needle} ") & ~F.col("lookup").contains(needle))
    if len(needle) < MIN_CONTAINS:
        own = own.limit(0)
    return own.orderBy(F.length("gloss_text"), "lookup", "id").limit(limit)


def gloss(words: DataFrame, entries: DataFrame, per_word: int = 3) -> DataFrame:
    """Up to `per_word` exact entries of each word (seq, word); words without one stay, with nulls."""
    met = words.join(entries, words["word"] == entries["lookup"], "left")
    place = F.row_number().over(Window.partitionBy("seq").orderBy(*[c.asc_nulls_last() for c in rank()]))
    return met.withColumn("place", place).where(F.col("place") <= per_word)
