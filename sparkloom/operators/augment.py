"""Rare characters and line openers put into lines: keyed rejection sampling, the same on any partitioning."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.line_scores import OPENER, among
from sparkloom.functions.text import LETTER, MARK, is_well_formed

#: Attempts to place a character where the line stays valid.
ATTEMPTS = 8


def unit(key: Column, *salt) -> Column:
    """A number in [0, 1) from a hash of the key and some salt."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.lit(s) if not isinstance(s, Column) else s for s in salt], key)), 25, 8), 16, 10).cast("double") / 2.0**32


def pick(items: Column, u: Column) -> Column:
    """The item at share u of an array; null of an empty one."""
    return F.get(items, F.floor(u * F.size(items)).cast("int"))


def kinds(rare: list[str]) -> dict[str, list[str]]:
    """Rare characters by where they go: letters replace common letters, marks follow letters without one, others stand at a space."""
    by = {"letter": [], "mark": [], "token": []}
    for c in rare:
        category = unicodedata.category(c)
        by["letter" if category == "Lo" else "mark" if category in ("Mn", "Mc") else "token"].append(c)
    return by


def spots(text: Column, kind: Column, common: list[str]) -> Column:
    """Places (from 0) of a line where a character of a kind can go."""
    chars = F.split(text, "")
    at = lambda cond: F.filter(F.transform(chars, lambda c, i: F.when(cond(c, i), i)), lambda i: i.isNotNull())
    bare = lambda c, i: c.rlike(f"^{LETTER}$") & ~F.coalesce(F.get(chars, i + 1).rlike(f"^{MARK}$"), F.lit(False))
    return F.when(kind == "letter", at(lambda c, i: among(c, common))).when(kind == "mark", at(bare)).otherwise(at(lambda c, i: c == " "))


def put(text: Column, ch: Column, kind: Column, spot: Column, spaced: bool) -> Column:
    """The line with the character at a spot: in place of a letter, behind it, or before a space (parted from the word if `spaced`)."""
    before = lambda n: F.substr(text, F.lit(1), spot + n)
    after = lambda n: F.substr(text, spot + 1 + n)
    token = F.concat(F.lit(" " if spaced else ""), ch)
    return F.when(kind == "letter", F.concat(before(0), ch, after(1))).when(kind == "mark", F.concat(before(1), ch, after(1))).otherwise(F.concat(before(0), token, after(0)))


def all_well_formed(texts: Column) -> Column:
    return F.transform(texts, is_well_formed)


def with_rare_text(rows: DataFrame, key: str, text: str, rare: list[str], common: list[str], insert: float, opener: float, seed: int = 0, skip: tuple = (), attach: bool = False, valid: Callable[[Column], Column] = all_well_formed, sign: str = OPENER) -> DataFrame:
    """`rows` with `changed`: the line with at most one rare character more and at most one opener more.

    A share `insert` of the lines draws a character and up to ATTEMPTS places; the first that gives a valid line counts, and without one
    the line stays. A drawn character in `skip` is not put in, and its share goes to no other. A share `opener` of the lines that do not begin
    with the opener gets it, if the result is valid. `valid` maps an array of lines to an array of booleans. All draws are hashes
    of (seed, key), so rows repeat on any partitioning; null lines stay null.
    """
    k = F.col(key).cast("string")
    drawn = pick(F.array(*[F.lit(c) for c in rare]) if rare else F.array().cast("array<string>"), unit(k, seed, "which"))
    by = kinds(rare)
    kind = F.when(among(F.col("_ch"), by["letter"]), "letter").when(among(F.col("_ch"), by["mark"]), "mark").otherwise("token")
    out = rows.withColumn("_ch", F.when((unit(k, seed, "insert") < insert), drawn)).withColumn("_ch", F.when(~among(F.col("_ch"), list(skip)), F.col("_ch"))).withColumn("_kind", kind)
    out = out.withColumn("_spots", F.when(F.col("_ch").isNotNull(), spots(F.col(text), F.col("_kind"), common)))
    tries = F.transform(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), lambda i: put(F.col(text), F.col("_ch"), F.col("_kind"), pick(F.col("_spots"), unit(k, seed, "place", i.cast("string"))), not attach))
    out = out.withColumn("_tries", F.coalesce(F.filter(tries, lambda t: t.isNotNull()), F.array().cast("array<string>")))
    good = F.get(F.filter(F.zip_with("_tries", valid(F.col("_tries")), lambda t, ok: F.when(ok, t)), lambda t: t.isNotNull()), F.lit(0))
    out = out.withColumn("_line", F.coalesce(good, F.col(text)))
    headed = F.array(F.concat(F.lit(sign), "_line"))
    wants = (unit(k, seed, "opener") < opener) & ~F.startswith("_line", F.lit(sign)) & F.get(valid(headed), F.lit(0))
    return out.withColumn("changed", F.when(wants, F.concat(F.lit(sign), "_line")).otherwise(F.col("_line"))).drop("_ch", "_kind", "_spots", "_tries", "_line")
