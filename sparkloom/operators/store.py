"""Relational store queries: explorer, latest per group, top-n per kind, decorations, inventories, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_group(rows: DataFrame, group: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last row of each group in a total order; partial maxima instead of a sort."""
    best = F.max(F.struct(*order, *[f for f in fields if f not in order])).alias("_b")
    return rows.groupBy(group).agg(best).select(group, *[F.col("_b")[f].alias(f) for f in dict.fromkeys([*order, *fields])])


def top_n_per_kind(counts: DataFrame, kind: str, n: dict[str, int], count: str, ties: list[str]) -> DataFrame:
    """The n[kind] largest counts of each kind."""
    limit = F.create_map(*[F.lit(x) for kv in n.items() for x in kv])[F.col(kind)]
    place = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(count), *ties))
    return counts.where(F.col(kind).isin(*n)).withColumn("place", place).where(F.col("place") <= limit)


def decorate(metrics: DataFrame, pipelines: DataFrame, key: str) -> DataFrame:
    """Metrics with label and order of their pipeline; unknown pipelines come last under their own key."""
    out = metrics.join(pipelines, key, "left")
    return out.withColumn("sort", F.coalesce("sort", F.lit(99))).withColumn("label", F.coalesce("label", key))


def suffix_pairs(metrics: DataFrame, scope: str, key: str, suffix: str, value: str) -> DataFrame:
    """(scope, key, base, other): metrics whose key with the suffix has one too."""
    other = metrics.select(F.col(scope).alias("_s"), F.col(key).alias("_k"), F.col(value).alias("other"))
    return metrics.join(other, (F.col(scope) == F.col("_s")) & (F.concat(F.col(key), F.lit(suffix)) == F.col("_k"))).select(scope, key, F.col(value).alias("base"), "other")


def with_label(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return rows.join(labels, key, "left_semi")


def without_label(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return rows.join(labels, key, "left_anti")


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 40) -> DataFrame:
    return rows.orderBy(*order).offset(page * size).limit(size)


def pivot_scores(rows: DataFrame, key: str, pipeline: str, names: list[str], value: str) -> DataFrame:
    """One column per pipeline: what correlated scalar subqueries would fetch, in one aggregation."""
    return rows.groupBy(key).agg(*[F.max(F.when(F.col(pipeline) == n, F.col(value))).alias(n) for n in names])


def inventory(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null values and distinct values of some columns."""
    wide = rows.agg(*[F.count(c).alias(f"n_{c}") for c in columns], *[F.count_distinct(c).alias(f"d_{c}") for c in columns])
    one = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n_{c}").alias("present"), F.col(f"d_{c}").alias("kinds")) for c in columns])
    return wide.select(F.inline(one))


def document_violations(rows: DataFrame, key: str, document: str, spec: dict[str, str]) -> DataFrame:
    """(key, path, problem) of JSON documents against path -> type; a trailing ? allows absence.

    Types: int, number, share (0 to 1), text, list, map.
    """
    checks = {"int": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$", "share": r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$", "list": r"^\[.*\]$", "map": r"^\{.*\}$"}
    found = []
    for path, kind in spec.items():
        optional, kind = kind.endswith("?"), kind.rstrip("?")
        value = F.get_json_object(document, f"$.{path}")
        bad = F.lit(False) if kind == "text" else ~value.rlike(checks[kind])
        if kind == "share":
            bad = bad | ~F.expr(f"try_cast(get_json_object({document}, '$.{path}') AS double) BETWEEN 0 AND 1")
        problem = F.when(value.isNull(), F.lit(None) if optional else F.lit("missing")).when(F.coalesce(bad, F.lit(True)), F.lit(f"not {kind}"))
        found.append(F.struct(F.lit(path).alias("path"), problem.alias("problem")))
    return rows.select(F.col(key).alias("key"), F.inline(F.array(*found))).where("problem is not null")


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that holds, in order; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(why)) for c, why in rules])


def keep_or_drop(rows: DataFrame, key: str, *rules: tuple[Column, str]) -> DataFrame:
    """(key, reason): a line goes for all its conditions if a rule holds in one of them; the first rule in order is told."""
    first = F.coalesce(*[F.when(c, F.struct(F.lit(i).alias("i"), F.lit(why).alias("why"))) for i, (c, why) in enumerate(rules)])
    return rows.groupBy(key).agg(F.min(first)["why"].alias("reason"))


def reconcile(left: DataFrame, right: DataFrame, key: str, a: str, b: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose totals differ by more than the tolerance, or stand on one side only."""
    met = left.select(key, F.col(a).alias("a")).join(right.select(key, F.col(b).alias("b")), key, "full_outer")
    return met.where(F.coalesce(F.abs(F.col("a") - F.col("b")) > tolerance, F.lit(True)))


def weighted_mean_fit(rows: DataFrame, group: str, x: str, y: str, weight: str) -> DataFrame:
    """Weighted mean and straight line per group; a single x gives the mean and slope 0."""
    one = F.count_distinct(x) == 1
    return rows.groupBy(group).agg(
        F.round(F.try_divide(F.sum(F.col(y) * F.col(weight)), F.sum(weight)), 6).alias("mean"), F.round(F.when(one, F.lit(0.0)).otherwise(F.regr_slope(y, x)), 6).alias("slope"), F.round(F.when(one, F.avg(y)).otherwise(F.regr_intercept(y, x)), 4).alias("intercept")
    )


def grid_best(rows: DataFrame, grid: DataFrame, group: str, loss: Column) -> DataFrame:
    """The grid point (alpha, beta) of least summed loss per group; ties: the smaller point. The grid is a small table."""
    each = rows.crossJoin(F.broadcast(grid)).groupBy(group, "alpha", "beta").agg(F.round(F.sum(loss), 6).alias("loss"))
    return each.groupBy(group).agg(F.min(F.struct("loss", "alpha", "beta")).alias("b")).select(group, "b.loss", "b.alpha", "b.beta")


def lag_delta(rows: DataFrame, order: str, value: str, group: list[str] | None = None) -> DataFrame:
    """A metric less the one before it; null at the first and beside a null."""
    w = Window.partitionBy(*(group or [])).orderBy(order)
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(w))
