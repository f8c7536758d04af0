"""The matrix of methods: readings out of several sources, and declared pairs of them compared by kind of line, with intervals by page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import metrics as M
from sparkloom.operators import comparison as C
from sparkloom.operators.reports import last_value

R9 = lambda c: F.round(c, 9)
ALL = "all"


def united(sources: list[DataFrame]) -> DataFrame:
    """(method, line, text) of several sources: a method comes whole from the last source that has it.

    Rows that repeat a method and line give the least text, null texts after all others. Null methods and lines are left out.
    """
    tagged = [s.select("method", "line", "text").withColumn("_at", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged).where("method is not null and line is not null")
    last = rows.groupBy("method").agg(F.max("_at").alias("_at"))
    # one row per method: a join by method would leave each method to one task; by line alone, so that a join by line moves nothing again
    own = rows.join(F.broadcast(last), ["method", "_at"]).repartition("line")
    return own.groupBy("line", "method").agg(F.min("text").alias("text")).select("method", "line", "text")


def scored(lines: DataFrame, readings: DataFrame) -> DataFrame:
    """(method, page, kind, chars, norm, edits) of each reading of a known line (line, page, kind, ref); null texts are empty, readings of unknown lines left out."""
    ref, hyp = (F.coalesce(c, F.lit("")) for c in ("ref", "text"))
    met = lines.select("line", "page", "kind", ref.alias("ref")).join(readings.select("method", "line", hyp.alias("hyp")), "line")
    n = F.length("ref").cast("long")
    return met.select("method", "page", "kind", n.alias("chars"), F.greatest(n, F.length("hyp").cast("long")).alias("norm"), M.line_edits("ref", "hyp").alias("edits"))


def _names(pairs: list[tuple[str, str, str]], kinds: list[str]) -> tuple[list[str], list[str]]:
    return sorted({m for _, a, b in pairs for m in (a, b)}), [*kinds, ALL]


def _of(kind: str) -> Column:
    return F.lit(True) if kind == ALL else F.col("kind") == kind


def by_page(scores: DataFrame, methods: list[str], kinds: list[str]) -> DataFrame:
    """One row per page: characters, longer lengths and edits of each method and kind, and lines of each method, as columns <what>_<method number>_<kind number>."""
    whats = {"lines": F.lit(1).cast("long"), "chars": F.col("chars"), "norm": F.col("norm"), "edits": F.col("edits")}
    sums = [F.coalesce(F.sum(F.when((F.col("method") == m) & _of(k), c)), F.lit(0)).alias(f"{w}_{i}_{j}") for i, m in enumerate(methods) for j, k in enumerate(kinds) for w, c in whats.items() if w != "lines" or k == ALL]
    return scores.where(F.col("method").isin(methods)).groupBy("page").agg(*sums, *[(F.sum(_of(k).cast("long")) > 0).cast("long").alias(f"page_{j}") for j, k in enumerate(kinds)])


def pair_rates(lines: DataFrame, scores: DataFrame, pairs: list[tuple[str, str, str]], kinds: list[str]) -> DataFrame:
    """(label, a, b, kind, status, lines, pages, cer_a, cer_b, delta, ned_a, ned_b, ned_delta) of declared pairs of methods, for each kind and all lines.

    status: `ok`, `missing` (a method has no readings), `incomplete` (one does not read every line). Figures are of complete pairs only, else null;
    a rate without characters is null too.
    """
    methods, sets = _names(pairs, kinds)
    pages = by_page(scores, methods, sets)
    total = pages.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in pages.columns if c != "page"])
    want = lines.agg(*[F.count_if(_of(k)).alias(f"want_{j}") for j, k in enumerate(sets)])
    rate = lambda n, d: F.try_divide(F.col(n).cast("double"), F.nullif(F.col(d), F.lit(0)))
    whole = sets.index(ALL)
    rows = []
    for label, a, b in pairs:
        x, y = methods.index(a), methods.index(b)
        none = (F.col(f"lines_{x}_{whole}") == 0) | (F.col(f"lines_{y}_{whole}") == 0)
        short = (F.col(f"lines_{x}_{whole}") < F.col(f"want_{whole}")) | (F.col(f"lines_{y}_{whole}") < F.col(f"want_{whole}"))
        status = F.when(none, "missing").when(short, "incomplete").otherwise("ok")
        for j, k in enumerate(sets):
            own = {"lines": F.col(f"want_{j}"), "pages": F.col(f"page_{j}")}
            for name, over in (("cer", "chars"), ("ned", "norm")):
                ra, rb = rate(f"edits_{x}_{j}", f"{over}_{x}_{j}"), rate(f"edits_{y}_{j}", f"{over}_{y}_{j}")
                own |= {f"{name}_a": R9(ra), f"{name}_b": R9(rb), "delta" if name == "cer" else "ned_delta": R9(ra - rb)}
            shown = [F.when(status == "ok", c).alias(n) for n, c in own.items()]
            rows.append(F.struct(F.lit(label).alias("label"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("kind"), status.alias("status"), *shown))
    return total.crossJoin(want).select(F.inline(F.array(*rows)))  # one row by one row


def pair_intervals(scores: DataFrame, pairs: list[tuple[str, str, str]], kinds: list[str], reps: int = 10_000, seed: int = 0) -> DataFrame:
    """(label, kind, measure, low, high): 95 % intervals of the differences of pair_rates by resampled pages, all over the same draws.

    A page's row holds every method, so that one pass of weights serves all pairs; one row of sums per resample leaves a task. All columns of a page are
    summed, so that its rows are those of pair_rates and Spark shuffles and scores them once for both.
    """
    methods, sets = _names(pairs, kinds)
    pages = by_page(scores, methods, sets)
    columns = [c for c in pages.columns if c != "page"]
    stats, named = {}, []
    for n, (label, a, b) in enumerate(pairs):
        x, y = methods.index(a), methods.index(b)
        for j, k in enumerate(sets):
            for measure, over in (("cer", "chars"), ("ned", "norm")):
                stats[f"{n}:{j}:{measure}"] = (f"edits_{x}_{j}", f"{over}_{x}_{j}", f"edits_{y}_{j}", f"{over}_{y}_{j}")
                named.append((f"{n}:{j}:{measure}", label, k, measure))
    found = C.ratio_report(C.resampled(pages, "page", "page", columns, reps, seed, ("clusters",)), stats)
    names = scores.sparkSession.createDataFrame(named, "metric string, label string, kind string, measure string")
    return found.join(F.broadcast(names), "metric").select("label", "kind", "measure", F.col("clusters_low").alias("low"), F.col("clusters_high").alias("high"))  # one row per declared pair, kind and measure


def pair_report(lines: DataFrame, scores: DataFrame, pairs: list[tuple[str, str, str]], kinds: list[str], reps: int = 10_000) -> DataFrame:
    """pair_rates and the bounds low, high of delta and ned_low, ned_high of ned_delta; null unless the pair is complete."""
    spans = pair_intervals(scores, pairs, kinds, reps).groupBy("label", "kind").agg(*[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{p}{c}") for m, p in (("cer", ""), ("ned", "ned_")) for c in ("low", "high")])
    out = pair_rates(lines, scores, pairs, kinds).join(spans, ["label", "kind"], "left")
    return out.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in ("low", "high", "ned_low", "ned_high")})


def stage_rates(lines: DataFrame, scores: DataFrame, stages: list[tuple[str, str, str, str, str]], logs: DataFrame, kinds: list[str]) -> DataFrame:
    """Stages (stage, a, b, run of a, run of b) that both methods read whole, as pair_rates, with each run's last recorded validation.

    logs: (run, at, val); entries without a value are no validation, a run without one has null.
    """
    rates = pair_rates(lines, scores, [(s, a, b) for s, a, b, _, _ in stages], kinds).where("status = 'ok'").drop("status")
    last = last_value(logs, "run", "val", "at")
    runs = lines.sparkSession.createDataFrame([(s, i, x, y) for i, (s, _, _, x, y) in enumerate(stages)], "label string, place int, run_a string, run_b string")
    own = lambda side: last.select(F.col("run").alias(f"run_{side}"), F.col("val").alias(f"val_{side}"))
    known = runs.join(own("a"), "run_a", "left").join(own("b"), "run_b", "left")
    return rates.join(known, "label").withColumnRenamed("label", "stage").drop("run_a", "run_b")
