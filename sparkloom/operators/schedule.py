"""Training schedules: a pool in hash order, batches of lines of similar length, epochs. No task holds the corpus or a language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.dictionary import cut

#: Batches whose lines are sorted by length together.
GROUP = 50


def numbered(rows: DataFrame, order: list, name: str = "at") -> DataFrame:
    """`rows` with their place from 0 in a total order: ranges of the order, the rows of the ranges before, and the place within a range.

    Ranges are as many as shuffle partitions; only their row counts, one number each, meet in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = cut(keyed.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_range", before.alias("_before")))  # one row per shuffle partition
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return ranged.withColumn("_place", place).join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before", *keys)


def pool(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """The first `size` rows in hash order, with their place `at`: a smaller pool is the beginning of a larger one."""
    k = F.col(key).cast("string")
    return numbered(rows, [F.md5(F.concat_ws(":", F.lit(seed), k)), k]).where(F.col("at") < size)


def epoch_batches(own: DataFrame, key: str, length: str, batch: int, seed: int, epoch: int) -> DataFrame:
    """(step, place, key): one epoch over a pool. Hash order, groups of GROUP batches sorted by length, batches in hash order; the last of a group may be short."""
    k = F.col(key).cast("string")
    mixed = numbered(own.drop("at"), [F.md5(F.concat_ws(":", F.lit(seed + epoch), F.lit("rows"), k)), k])
    group = mixed.withColumn("group", F.floor(F.col("at") / (batch * GROUP)))
    w = Window.partitionBy("group").orderBy(length, "at")  # a group has batch * GROUP rows
    placed = group.withColumn("i", F.row_number().over(w) - 1).withColumn("batch", F.col("group") * GROUP + F.floor(F.col("i") / batch)).withColumn("place", (F.col("i") % batch).cast("int"))
    batches = placed.select("batch").distinct()
    steps = numbered(batches, [F.md5(F.concat_ws(":", F.lit(seed + epoch), F.lit("batches"), "batch")), F.col("batch")], "step")
    return placed.join(steps, "batch").select("step", "place", F.col(key).alias("key"))


def schedule(rows: DataFrame, key: str, length: str, size: int, batch: int, steps: int, seed: int) -> DataFrame:
    """(epoch, step, place, key): the first `steps` batches over a pool, epoch after epoch. An empty pool has none."""
    own = cut(pool(rows, key, size, seed))
    n = own.count()
    if not n:
        return own.select(F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("step"), F.lit(0).alias("place"), F.col(key).alias("key"))
    full, rest = divmod(n, batch * GROUP)
    each = full * GROUP + -(-rest // batch)  # batches of an epoch
    out = None
    for e in range(-(-steps // each)):
        one = epoch_batches(own, key, length, batch, seed, e).select(F.lit(e).alias("epoch"), (F.col("step") + e * each).alias("step"), "place", "key").where(F.col("step") < steps)
        out = one if out is None else out.unionByName(one)
    return out
