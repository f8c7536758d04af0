"""Lineage and usage accounting over logs and parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ancestry(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, distance, status) by following parent pointers to the root, however long the chain.

    status: ok, cycle (the pointer leads back), missing (a parent that is no node). Paths double in each round: after k
    rounds every node knows its next 2^k ancestors, so a chain of n takes about log2 n rounds. Rounds are cut by checkpoint()
    where the session has spark.checkpoint.dir.
    """
    spark = nodes.sparkSession
    edge = nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_p"))
    known = edge.select(F.col("_n").alias("_k"))
    first = edge.join(known, F.col("_p") == F.col("_k"), "left").select(F.col("_n").alias("node"), F.array_compact(F.array("_p")).alias("path"), F.when(F.col("_p").isNotNull() & F.col("_k").isNull(), "missing").when(F.col("_p") == F.col("_n"), "cycle").when(F.col("_p").isNull(), "root").otherwise("ok").alias("end"))
    now = first
    while True:
        onward = now.select(F.col("node").alias("_last"), F.col("path").alias("_path"), F.col("end").alias("_end"))
        met = now.join(onward, (F.col("end") == "ok") & (F.try_element_at("path", F.lit(-1)) == F.col("_last")), "left")
        both = F.concat("path", F.coalesce("_path", F.slice("path", 1, 0)))
        # the first pointer that leads to a node seen before, or to the node itself, ends the path there
        again = F.array_position(F.transform(both, lambda x, i: (x == F.col("node")) | F.array_contains(F.slice(both, F.lit(1), i), x)), True)
        end = F.when(F.col("end") != "ok", F.col("end")).when(again > 0, "cycle").otherwise(F.col("_end"))
        now = met.select("node", F.when((F.col("end") == "ok") & (again > 0), F.slice(both, F.lit(1), again.cast("int"))).otherwise(both).alias("path"), end.alias("end"))
        now = now.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else now.persist()
        if now.where("end = 'ok'").isEmpty():
            break
    size = F.size("path")
    up = now.select("node", F.posexplode("path").alias("i", "ancestor"), (size - 1).alias("last"), "end")
    status = F.when((F.col("i") == F.col("last")) & F.col("end").isin("cycle", "missing"), F.col("end")).otherwise("ok")
    own = nodes.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("distance"), F.lit("ok").alias("status"))
    return own.unionByName(up.select("node", "ancestor", (F.col("i") + 1).alias("distance"), status.alias("status")))


def as_of_last(events: DataFrame, probes: DataFrame, key: str, at: str, value: str, seq: str) -> DataFrame:
    """For each probe (key, at): the value of the last event of the key strictly before it; null without one.

    Events and probes are one stream in order of time per key, so a hot key costs a sort, not a product.
    """
    e = events.select(key, F.col(at).alias("at"), F.col(seq).alias("seq"), F.col(value).alias("v"), F.lit(1).alias("kind"))
    p = probes.select(key, F.col(at).alias("at"), F.col(seq).alias("seq"), F.lit(None).cast(e.schema["v"].dataType).alias("v"), F.lit(0).alias("kind"))
    # probes come before events of their own moment: those do not count
    w = Window.partitionBy(key).orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return e.unionByName(p).withColumn("last", F.last("v", ignorenulls=True).over(w)).where("kind = 0").select(key, "at", "seq", "last")


def rollbacks(log: DataFrame, key: str, order: list[str], step: str, starts: str) -> DataFrame:
    """Start events at a step that an earlier event of the key had already reached."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("reached", F.max(step).over(w)).where(F.col(starts) & (F.col(step) <= F.col("reached")))


def segments(log: DataFrame, key: str, order: list[str], step: str, starts: str, upto: int | None = None) -> DataFrame:
    """(key, segment, first, last): the step ranges of each process that still count.

    A process begins with a start event and reaches its highest step; what lies at or beyond a later start is lost.
    """
    w = Window.partitionBy(key).orderBy(*order)
    run = log.withColumn("segment", F.count_if(F.col(starts)).over(w)).where("segment > 0")
    each = run.groupBy(key, "segment").agg(F.min(F.when(F.col(starts), F.col(step))).alias("first"), F.max(step).alias("last"))
    later = F.min("first").over(Window.partitionBy(key).orderBy("segment").rowsBetween(1, Window.unboundedFollowing))
    out = each.withColumn("last", F.least("last", later, *([F.lit(upto)] if upto is not None else [])))
    return out.where("last > first")


def islands(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: (key, island, value, rows, first, last in order[0])."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1), F.lit(True))
    run = rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w))
    return run.groupBy(key, "island").agg(F.first(value).alias("value"), F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def dropped(events: DataFrame, key: str, seq: str, names: str) -> DataFrame:
    """Names that earlier events of a key list and its last one does not."""
    return events.groupBy(key).agg(F.max_by(names, seq).alias("final"), F.array_distinct(F.flatten(F.collect_list(names))).alias("all")).select(key, F.array_sort(F.array_except("all", "final")).alias("dropped"))


def recipe_changes(runs: DataFrame, order: str, args: str) -> DataFrame:
    """(order, name, before, after): arguments (map) that differ from the run before."""
    w = Window.partitionBy().orderBy(order)
    pair = runs.select(order, F.col(args).alias("now"), F.lag(args).over(w).alias("was")).where("was is not null")
    names = pair.select(order, "now", "was", F.explode(F.array_union(F.map_keys("now"), F.map_keys("was"))).alias("name"))
    both = names.select(order, "name", F.col("was")[F.col("name")].alias("before"), F.col("now")[F.col("name")].alias("after"))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def conditional_arg_max(rows: DataFrame, group: str, by: str, limit: float, fields: list[str]) -> DataFrame:
    """The row of largest `by` in (0, limit] of each group."""
    own = rows.where((F.col(by) > 0) & (F.col(by) <= limit + 1e-9))
    return own.groupBy(group).agg(F.max(F.struct(by, *fields)).alias("b")).select(group, "b.*")
