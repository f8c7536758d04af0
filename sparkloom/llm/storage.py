"""Cutting lineage with tables in the shared checkpoint folder, and sizing of buckets."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark then deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session of this one machine may go without: its tables are then in its temporary folder."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/checkpoints"
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: later stages read it again after a loss instead of recomputing.

    The shuffle files of the write go when it ends. The table goes at the end of the process, by release() or by forget().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    _WRITTEN.append((spark, path.rpartition("/")[0]))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path.rpartition("/")[0]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        own = (df.sparkSession, df.stored_at)
        if own in _WRITTEN:
            _WRITTEN.remove(own)
            _delete(*own)


def release(spark: SparkSession | None = None) -> None:
    """Delete every table that materialize() has written (for `spark`)."""
    for own, path in [x for x in _WRITTEN if spark is None or x[0] is spark]:
        _delete(own, path)
        _WRITTEN.remove((own, path))


atexit.register(release)


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, bytes of text) of a corpus."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def bucket_bits(total: int, each: int) -> int:
    """Bits of the number of buckets that hold about `each` of `total` items."""
    return max(0, (-(-total // each) - 1).bit_length())
