"""Small relational operators of reports, gates, runs and dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_problem(rows: DataFrame, key: str, rules: list[tuple[Column, Column | str]]) -> DataFrame:
    """(key, problem): what the first broken rule says of each row, '' where all hold. A rule is (broken, what to say)."""
    said = [F.when(broken, say if isinstance(say, Column) else F.lit(say)) for broken, say in rules]
    return rows.select(F.col(key), F.coalesce(*said, F.lit("")).alias("problem"))


def switch_violations(runs: DataFrame, key: str, switches: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(key, problem) of runs whose options contradict their declaration.

    For each switch (name: declared flag column, option columns): when declared, every option must be above 0, else all
    of them 0. Null counts as 0 and as not declared.
    """
    found = []
    for name, (flag, options) in switches.items():
        on = F.coalesce(F.col(flag), F.lit(False))
        values = [F.coalesce(F.col(o), F.lit(0)) for o in options]
        found.append(F.when(on & reduce(Column.__or__, [v <= 0 for v in values]), F.lit(f"{name} declared, option off")))
        found.append(F.when(~on & reduce(Column.__or__, [v != 0 for v in values]), F.lit(f"{name} not declared, option on")))
    return runs.select(F.col(key), F.explode(F.array_compact(F.array(*found))).alias("problem"))


def source_inputs(lines: DataFrame, key: str, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, source, input): for each named source (table, text column) the lines that have a text there."""
    parts = [lines.select(key).join(t.select(key, F.col(text).alias("input")), key).where(F.coalesce(F.col("input"), F.lit("")) != "").select(key, F.lit(name).alias("source"), "input") for name, (t, text) in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def with_reference(rows: DataFrame, references: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the reference of their composite key, null where there is none; of repeated references the least."""
    return rows.join(references.groupBy(*keys).agg(F.min(value).alias("reference")), keys, "left")


def unordered_pairs(items: DataFrame, key: str, group: str) -> DataFrame:
    """(group, a, b) with a < b: the pairs of the few items of a group, as checkpoints of one experiment."""
    one, two = items.select(group, F.col(key).alias("a")).distinct(), items.select(group, F.col(key).alias("b")).distinct()
    return one.join(two, group).where("a < b")


def sum_by(rows: DataFrame, kind: str, value: str) -> DataFrame:
    return rows.groupBy(kind).agg(F.sum(value).alias("total"))


def counted_down(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, place): values by falling count, ties by value. There are few values, so one task places them."""
    n = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), value)))


def joined_texts(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, text): the group's texts in order, joined by spaces."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def spread(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"))


def distinct_list(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias("all"))


def either_total(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """How many rows match a, b, and one of them at least: no row counts twice."""
    return rows.agg(F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a | b).alias("either"))


def inserted_after(items: DataFrame, key: str, order: str, more: DataFrame, after: str) -> DataFrame:
    """(key, place): `more` in its own order right behind the item `after`, the others as they were. Few items."""
    own = items.select(key, order, F.lit(0).alias("_side")).unionByName(more.select(key, order, F.lit(1).alias("_side")))
    own = own.withColumn("_at", F.max(F.when((F.col(key) == after) & (F.col("_side") == 0), F.col(order))).over(Window.partitionBy()))
    place = F.when(F.col("_side") == 0, F.struct(F.when(F.col(order) <= F.col("_at"), 0).otherwise(2), F.col(order))).otherwise(F.struct(F.lit(1), F.col(order)))
    return own.select(key, F.row_number().over(Window.orderBy(place, key)).alias("place"))


def long_metrics(rows: DataFrame, key: str, metrics: dict[str, str]) -> DataFrame:
    """(key, name, value): one row per named column."""
    return rows.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in metrics.items()])))


def method_kind(main: Column, lines: Column, wanted: Column, partial: Column) -> Column:
    """full, partial or invalid: a method with main results must cover the whole subset."""
    return F.when(main.isNotNull(), F.when(lines == wanted, "full").otherwise("invalid")).when(partial.isNotNull(), "partial").otherwise("invalid")


def step_evidence(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, steps, first, last, change, steepest, rise): consecutive changes of an ablation, and the step of largest rise."""
    w = Window.partitionBy(group).orderBy(order)
    steps = rows.select(group, order, value, (F.col(value) - F.lag(value).over(w)).alias("d"))
    best = F.max_by(F.when(F.col("d").isNotNull(), F.struct("d", order)), F.when(F.col("d").isNotNull(), F.struct("d", order)))
    out = steps.groupBy(group).agg(F.count("d").alias("steps"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), best.alias("b"))
    return out.where("steps > 0").select(group, "steps", "first", "last", F.round(F.col("last") - F.col("first"), 4).alias("change"), F.col(f"b.{order}").alias("steepest"), F.round("b.d", 4).alias("rise"))


def best_report(reports: DataFrame, goal: list[str], lines: str, name: str) -> DataFrame:
    """The report of most lines for each goal; of equals the first by name."""
    w = Window.partitionBy(*goal).orderBy(F.desc(lines), name)
    return reports.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fingerprint(entries: DataFrame, group: str, key: str, value: str, digits: int = 16) -> DataFrame:
    """(group, fingerprint): first digits of the SHA-256 of the sorted key=value lines."""
    parts = F.array_sort(F.collect_set(F.concat_ws("=", F.col(key).cast("string"), F.col(value).cast("string"))))
    return entries.groupBy(group).agg(F.substring(F.sha2(F.array_join(parts, "\n"), 256), 1, digits).alias("fingerprint"))


def boundary_count(units: Column) -> Column:
    """Neighbouring pairs of units of which neither is a space."""
    apart = F.zip_with(F.slice(units, F.lit(1), F.greatest(F.size(units) - 1, F.lit(0))), F.slice(units, 2, F.greatest(F.size(units), F.lit(1))), lambda a, b: (a != " ") & (b != " "))
    return F.size(F.filter(apart, lambda x: x))


def marked_texts(rows: DataFrame, text: str, plain: str, marked: str, least: int = 10, share: float = 0.3) -> DataFrame:
    """Rows whose text has at least `least` marked letters, which are at least `share` of plain and marked ones."""
    low = F.lower(F.col(text))
    n = lambda letters: F.length(low) - F.length(F.translate(low, letters, ""))
    return rows.withColumn("marked", n(marked)).withColumn("plain", n(plain)).where((F.col("marked") >= least) & (F.col("marked") >= share * F.greatest(F.lit(1), F.col("marked") + F.col("plain"))))


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row `times` times, numbered from 1; none for 0 or null."""
    n = F.coalesce(times, F.lit(0)).cast("int")
    return rows.where(n > 0).withColumn("turn", F.explode(F.sequence(F.lit(1), n)))


def schedule(rows: DataFrame, group: str, key: str, batch: int, seed: int) -> DataFrame:
    """(group, key, batch): each group's rows in hash order, dealt into batches. The order differs from a sequential generator's."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key)
    return rows.select(group, key, F.floor((F.row_number().over(w) - 1) / batch).cast("long").alias("batch"))


def gloss_text(glosses: Column) -> Column:
    """Words of all glosses, single spaces around each, so that LIKE '% word %' finds whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.array_join(glosses, " ")), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def signed_points(share: Column) -> Column:
    """A difference of shares as signed percentage points with two decimals."""
    p = F.round(share * 100, 2).cast("decimal(20,2)")
    return F.concat(F.when(p >= 0, "+").otherwise(""), p.cast("string"))
