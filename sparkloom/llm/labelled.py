"""Bounded samples of labelled rows, and the hold-out rule of the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Bytes of text that a sample may hold together: what reaches the driver is bounded by rows and by bytes.
MOST_BYTES = 64_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int = MOST_BYTES) -> list:
    """Rows (text, label, weight) of at most `per_class` ids of either label that are not held out.

    The ids of least hash are taken; weight is the share of the class that the sample stands for, so that
    weighted sums follow the labels' true shares. Ids with null or disagreeing labels are left out. Of the rows of an id the
    text of least hash counts. The chosen ids are at most 2 * per_class, so they are broadcast and the texts need no
    shuffle; whole texts are taken in order of hash while they fit into `most_bytes`, half for either label.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top").select("doc_id", "y")
    known = known.where(~held_out(F.col("doc_id")))
    sizes = {r["y"]: r["c"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect() if r["y"] in (0, 1)}
    order = F.xxhash64("doc_id", F.lit(5))
    parts = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in sizes]
    if not parts:
        return []
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("bytes"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("h", "bytes")).alias("t")).select("doc_id", "y", "t.h", "t.bytes", order.alias("o")).collect()
    taken, room = {}, dict.fromkeys(sizes, most_bytes // 2)
    for r in sorted(found, key=lambda r: (r["o"], r["doc_id"])):
        if r["bytes"] <= room[r["y"]]:
            room[r["y"]] -= r["bytes"]
            taken[r["doc_id"]] = (r["h"], int(r["y"]))
    if not taken:
        return []
    wanted = docs.sparkSession.createDataFrame([(i, h) for i, (h, _) in taken.items()], "doc_id long, h long")
    rows = texts.join(F.broadcast(wanted), ["doc_id", "h"]).groupBy("doc_id").agg(F.first("text").alias("text")).orderBy("doc_id").collect()
    got = {y: sum(taken[r["doc_id"]][1] == y for r in rows) for y in sizes}
    return [(r["text"], taken[r["doc_id"]][1], sizes[taken[r["doc_id"]][1]] / got[taken[r["doc_id"]][1]]) for r in rows]
