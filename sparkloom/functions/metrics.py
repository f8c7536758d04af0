"""Error rates as column expressions and aggregates. Ratios are of sums (micro averages)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import alignment as A


def edits(ref: str, hyp: str) -> Column:
    return F.levenshtein(F.col(ref), F.col(hyp)).cast("long")


def line_edits(ref: str, hyp: str) -> Column:
    """The same, a batch of lines at once."""
    return A.line_distance(F.col(ref), F.col(hyp))


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0: what does not occur has no rate."""
    return F.try_divide(a.cast("double"), b)


def cer(ref: str, hyp: str) -> Column:
    """Edits over reference characters; 0 characters count as 1."""
    return F.sum(edits(ref, hyp)) / F.greatest(F.lit(1), F.sum(F.length(ref)))


def ned(ref: str, hyp: str) -> Column:
    """Edits over the longer side's characters, 0 to 1."""
    return F.sum(edits(ref, hyp)) / F.greatest(F.lit(1), F.sum(F.greatest(F.length(ref), F.length(hyp))))


def cer_no_space(ref: str, hyp: str) -> Column:
    """Spaces are taken out of the hypothesis only."""
    return F.sum(F.levenshtein(F.col(ref), F.replace(F.col(hyp), F.lit(" "), F.lit("")))) / F.greatest(F.lit(1), F.sum(F.length(ref)))


def exact(ref: str, hyp: str) -> Column:
    return F.avg((F.col(ref) == F.col(hyp)).cast("double"))


def line_cer(ref: str, hyp: str) -> Column:
    return A.line_distance(F.col(ref), F.col(hyp)) / F.greatest(F.lit(1), F.length(ref))


def line_ned(ref: str, hyp: str) -> Column:
    return F.levenshtein(F.col(ref), F.col(hyp)) / F.greatest(F.lit(1), F.length(ref), F.length(hyp))


def edits_no_space(ref: str, hyp: str) -> Column:
    return F.levenshtein(F.col(ref), F.replace(F.col(hyp), F.lit(" "), F.lit(""))).cast("long")


def summary_of(edits_: str, bare: str, ref: str, longer: str, same: str) -> list[Column]:
    """Lines, cer, ned, cer without spaces and exact share of a group, from each line's edits, lengths and equality."""
    rate = lambda a, b: F.round(F.sum(a) / F.greatest(F.lit(1), F.sum(b)), 9)
    return [F.count(F.lit(1)).alias("lines"), rate(edits_, ref).alias("cer"), rate(edits_, longer).alias("ned"), rate(bare, ref).alias("cer_no_space"), F.round(F.avg(same), 9).alias("exact")]
