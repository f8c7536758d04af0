"""Tables that are derived once per set of parameters, and reports that replace their file in one step."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def swap(spark: SparkSession, new: str, path: str) -> None:
    """`new` becomes `path` by renames; what stood there before goes only afterwards, and comes back if the rename fails."""
    fs, target = _fs(spark, path)
    source = _fs(spark, new)[1]
    old = _fs(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(source, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot move {new} to {path}")
    if had:
        fs.delete(old, True)


def replace_all(df: DataFrame, path: str) -> None:
    """The table at `path` becomes `df`. It is written beside and renamed, so a failed job leaves the old table, and `df` may read it."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    try:
        df.write.parquet(new)
        swap(df.sparkSession, new, path)
    finally:
        fs, target = _fs(df.sparkSession, new)
        fs.delete(target, True)


def derived(spark: SparkSession, path: str, params: dict, build: Callable[[], DataFrame], expected: int | None = None, refresh: bool = False) -> DataFrame:
    """The table that `build` gives for `params`, kept under `path` by a hash of the parameters.

    A table of the same parameters is read again; other parameters, or `refresh`, build anew. Rows are counted while they are written
    (an observed metric, no second pass); another count than `expected` raises and leaves nothing, neither written now nor read again.
    """
    text = json.dumps(params, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    own = f"{path}/{hashlib.sha256(text.encode()).hexdigest()[:32]}"
    if refresh or not exists(spark, f"{own}/_SUCCESS"):
        new, seen = f"{path}/.new-{uuid.uuid4().hex}", Observation()
        try:
            build().observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("_params", F.lit(text)).write.parquet(new)
            _counted(seen.get["rows"], expected, params)
            swap(spark, new, own)
        finally:
            fs, target = _fs(spark, new)
            fs.delete(target, True)
    out = spark.read.parquet(own)
    _counted(out.count() if expected is not None else None, expected, params)
    return out.drop("_params")


def _counted(rows: int | None, expected: int | None, params: dict) -> None:
    if expected is not None and rows != expected:
        raise ValueError(f"{rows} rows instead of {expected} for {params}")


def latex(text: Column) -> Column:
    """Text with LaTeX's special characters escaped; null is a dash."""
    out = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("--")), r"\\", "\u0000")
    for c in "&%$#_{}":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    for c, s in (("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"), ("\u0000", r"\textbackslash{}")):
        out = F.replace(out, F.lit(c), F.lit(s))
    return out


def report_lines(df: DataFrame, kind: str, order: list[str], caption: str = "") -> DataFrame:
    """(place, key, line) of a table as markdown or LaTeX: head, rows in order, foot. Nothing reaches the driver."""
    cell = (lambda c: latex(F.col(c))) if kind == "latex" else (lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("–")), r"\s+", " "), F.lit("|"), F.lit("\\|")))
    if kind == "latex":
        sep, left, right = " & ", "", r" \\"
        name = lambda c: c.replace("\\", "").replace("_", r"\_")
        head = [r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\toprule", sep.join(map(name, df.columns)) + right, r"\midrule"]
        foot = [r"\bottomrule", r"\end{tabular}", *([rf"% {caption}"] if caption else [])]
    elif kind == "markdown":
        sep, left, right = " | ", "| ", " |"
        head = [*([f"**{caption}**", ""] if caption else []), left + sep.join(df.columns) + right, "|" + "---|" * len(df.columns)]
        foot = []
    else:
        raise ValueError(f"no report of kind {kind}")
    body = df.select(F.lit(1).alias("place"), F.struct(*order).alias("key"), F.concat(F.lit(left), F.concat_ws(sep, *[cell(c) for c in df.columns]), F.lit(right)).alias("line"))
    edge = lambda place, lines: df.sparkSession.createDataFrame([(place, i, x) for i, x in enumerate(lines)], "place int, i int, line string")
    edges = edge(0, head).unionByName(edge(2, foot)).select("place", F.lit(None).cast(body.schema["key"].dataType).alias("key"), "line", "i")
    return body.withColumn("i", F.lit(0)).unionByName(edges)


def write_report(df: DataFrame, path: str, kind: str, order: list[str], caption: str = "") -> None:
    """A table as one text file in the folder `path`, replaced in one step. For reports, which are small; the rows are sorted and written by one task."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    try:
        lines = report_lines(df, kind, order, caption)
        lines.repartition(1).sortWithinPartitions("place", "i", "key").select("line").write.text(new)
        swap(df.sparkSession, new, path)
    finally:
        fs, target = _fs(df.sparkSession, new)
        fs.delete(target, True)
