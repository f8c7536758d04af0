"""Connected components of a link table: a forest per partition, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernel as K
from sparkloom.llm.overlaps import forest
from sparkloom.llm.storage import forget, materialize

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Links that a task holds at once while it makes its forest.
RUN = 1_000_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition by forests of at most RUN links each: fewer links that connect the same."""
    held, count = [], 0

    def flush() -> pa.RecordBatch:
        nonlocal held, count
        table = pa.Table.from_batches(held)
        held, count = [], 0
        u, v = forest(*(table.column(c).to_numpy() for c in ("u", "v")))
        return K.batch_of(_EDGE, {"u": u, "v": v})

    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= RUN:
            yield flush()
    if held:
        yield flush()


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u > v): point each neighbour of a node at the smallest node around it."""
    around = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = around.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the smallest node that it reaches.

    Links may repeat, in either direction; a link of a node to itself and null ends say nothing. Only whether
    any node is left to move reaches the driver.
    """
    a, b = links.columns[:2]
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    now = materialize(edges.mapInArrow(_forests, "u long, v long").distinct(), "forest")
    while True:
        # done when every node has one link and it leads to a node that has none
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("root")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("root")))
        left = ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("root").alias("root")).where("n > 1 or (n = 1 and root = 1)")
        if left.isEmpty():
            break
        last, now = now, materialize(_stars(_stars(now, True), False), "stars")
        forget(last)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
