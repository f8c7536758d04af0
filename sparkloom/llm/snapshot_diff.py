"""Snapshot difference with rekeying: what became of each row of a table between two snapshots.

Rows are narrow from the start: long columns travel as SHA-256 digests. The first shuffle deals both snapshots by a hash of the key;
in each partition DuckDB joins them fully outer over Arrow batches, so equal keys pair. Rows left over are dealt by (content, side, range of the
key); DuckDB numbers each range of a content by row_number, and the counts of the ranges before it give a row its
number within its content. The second shuffle deals by a hash of (content, number), and DuckDB pairs equal numbers of equal contents by IS NOT
DISTINCT FROM. A content, or a key, of a third of all rows is thereby spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.storage import forget, materialize

#: Most rows of a partition that DuckDB joins in memory, and the least that a partition of its own is worth.
PART_ROWS, WORTH = 250_000, 2_000
#: Rows of a range of the order that groups are numbered by, and the least and most ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 20_000, 16, 4_096


def _arrow_schema(df: DataFrame) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(c, kinds[t]) for c, t in df.dtypes])


def in_duckdb(df: DataFrame, query: str, schema: str) -> DataFrame:
    """Each partition of `df`, as table `part`, through one DuckDB query in memory, on one thread."""
    want = _arrow_schema(df.sparkSession.createDataFrame([], schema))
    have = _arrow_schema(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        held = [b for b in batches if len(b)]
        if not held:
            return
        with duckdb.connect(config={"threads": 1}) as con:
            con.register("part", pa.Table.from_batches(held).cast(have))
            held.clear()
            for batch in con.sql(query).to_arrow_reader(50_000):
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in want], schema=want)

    return df.mapInArrow(run, schema)


def _parts(spark: SparkSession, n: int) -> int:
    return max(n // PART_ROWS, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // WORTH)) + 1


def _splits(rows: DataFrame, n: int, columns: list[str]) -> list[np.ndarray]:
    """Up to MOST_RANGES values of each column that cut its rows into ranges of about RANGE_ROWS, from a bounded sample: it decides balance, not results."""
    ranges = min(MOST_RANGES, max(LEAST_RANGES, n // RANGE_ROWS))
    some = rows.where(F.pmod(F.xxhash64("rid"), F.lit(max(1, n // (4 * MOST_RANGES)))) == 0).select(*columns).collect()
    cuts = []
    for c in columns:
        v = np.sort(np.array([r[c] for r in some if r[c] is not None], dtype=np.int64))
        cuts.append(v[np.linspace(0, len(v) - 1, ranges + 1).astype(int)[1:-1]] if len(v) else v)
    return cuts


def _in_ranges(rows: DataFrame, order: str, n: int) -> DataFrame:
    """`rows` with `range`, which rises with (order, rid): ranges of `order`, and of `rid` within a value of `order` that fills ranges by itself."""
    cuts, inner = _splits(rows, n, [order, "rid"])
    heavy = np.unique(cuts[1:][cuts[1:] == cuts[:-1]])
    cuts = np.unique(cuts)
    have = _arrow_schema(rows)
    want = have.append(pa.field("range", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = batch.column(have.get_field_index(order))
            v, known = array.fill_null(0).to_numpy(zero_copy_only=False), array.is_valid().to_numpy(zero_copy_only=False)
            own = np.isin(v, heavy) & known
            at = np.where(known, 2 * np.searchsorted(cuts, v) + 2 + own, 1)  # nulls come first, and may be many
            sub = np.where(own | ~known, np.searchsorted(inner, batch.column(have.get_field_index("rid")).to_numpy()), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at * (MOST_RANGES + 1) + sub)], schema=want)

    return rows.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "range long"]))


def numbered(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """`rows` with `name`, from 1 within equal values of `by` (nulls are equal) by (order, rid): no group is one task's.

    Rows are dealt by (by, range of the order); DuckDB numbers each group's rows of a range, and what earlier ranges hold of the group is
    added. A range has about as many rows of all groups together as of a group at most, so a hot group is spread over the ranges.
    """
    n = rows.count()
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    dealt = _in_ranges(rows, order, n).repartition(_parts(rows.sparkSession, n), *by, "range")
    over = ", ".join(f'"{c}"' for c in [*by, "range"])
    local = in_duckdb(dealt, f'SELECT *, row_number() OVER (PARTITION BY {over} ORDER BY "{order}" NULLS FIRST, rid) AS local FROM part', f"{fields}, range long, local long")
    local = materialize(local, "numbered")
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = local.groupBy(*by, "range").agg(F.max("local").alias("n"))
    offsets = counts.withColumn("offset", F.sum("n").over(before)).where("offset > 0").drop("n")
    out = local.alias("a").join(offsets.alias("b").hint("merge"), _all([F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "range")]), "left")
    return out.select(*[F.col(f"a.{c}").alias(c) for c in rows.columns], (F.col("local") + F.coalesce("offset", F.lit(0))).alias(name))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def _compared(columns: list[str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN o.c{i} IS DISTINCT FROM n.c{i} THEN '{c}' END" for i, c in enumerate(columns)) + ")"


def difference(old: DataFrame, new: DataFrame, columns: list[str], key: str = "doc_id", content: str = "text") -> DataFrame:
    """(key, old_key, op, changed, row_sha256) per pair or unpaired row of two snapshots.

    Rows of equal keys pair (op `same`, or `update` with the differing `columns`, comma-joined in their order). Among the rows left over, the i-th smallest
    earlier key of a content pairs with its i-th smallest later key (`rekey`). The rest is `insert` and `delete`. key is the later
    key, else the earlier one; row_sha256 is of the later row's columns as text, joined by a line feed, null as `~`, and null for `delete`. Defined cases: nulls equal only
    nulls, in keys, contents and columns; an empty text is a content like any other; rows that repeat a key pair in the order
    in which they are read, and what one snapshot has more of is left over; ties of content and key go by that order too; very long texts travel as digests; empty
    snapshots give only inserts or deletes, two of them an empty table; columns that are not named are not read.
    """
    at = columns.index(content)

    def narrow(df: DataFrame, side: int) -> DataFrame:
        texts = [df[c].cast("string") for c in columns]
        digests = [F.unhex(F.sha2(t.cast("binary"), 256)).alias(f"c{i}") for i, t in enumerate(texts)]
        whole = F.sha2(F.concat_ws("\n", *[F.coalesce(t, F.lit("~")) for t in texts]).cast("binary"), 256)
        return df.select(F.lit(side).alias("side"), df[key].cast("long").alias("key"), *digests, (F.unhex(whole) if side else F.lit(None).cast("binary")).alias("sha"))

    rows = materialize(narrow(old, 0).unionByName(narrow(new, 1)).withColumn("rid", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    cs = [f"c{i}" for i in range(len(columns))]
    if rows.groupBy("side", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        ranked = rows.withColumn("nth", F.lit(1).cast("long"))
    else:
        ranked = numbered(rows, ["key", "side"], "rid", "nth")
    binary = ", ".join(f"{c} binary" for c in cs)
    found = "side int, key long, rid long, old_key long, changed string, sha binary, paired boolean"
    joined = in_duckdb(
        ranked.repartition(_parts(rows.sparkSession, n), "key", "nth"),
        f"""
        SELECT CASE WHEN n.side IS NULL THEN 0 ELSE 1 END::INTEGER AS side, CASE WHEN n.side IS NULL THEN o.key ELSE n.key END AS key, coalesce(n.rid, o.rid) AS rid, o.key AS old_key,
               CASE WHEN o.side IS NULL OR n.side IS NULL THEN '' ELSE {_compared(columns)} END AS changed, n.sha AS sha, o.side IS NOT NULL AND n.side IS NOT NULL AS paired,
               {", ".join(f"CASE WHEN n.side IS NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in cs)}
        FROM (SELECT * FROM part WHERE side = 0) o FULL OUTER JOIN (SELECT * FROM part WHERE side = 1) n ON o.key IS NOT DISTINCT FROM n.key AND o.nth = n.nth
        """,
        f"{found}, {binary}",
    )
    joined = materialize(joined, "joined")
    forget(rows)
    pairs = joined.where("paired").select("key", "old_key", F.when(F.col("changed") == "", "same").otherwise("update").alias("op"), "changed", "sha")

    left = joined.where("not paired").select("side", "key", "rid", "sha", *cs)
    text = f"c{at}"
    placed = numbered(left, [text, "side"], "key", "nth")
    paired = in_duckdb(
        placed.repartition(_parts(left.sparkSession, left.count()), text, "nth"),
        f"""
        SELECT CASE WHEN n.side IS NULL THEN o.key ELSE n.key END AS key, o.key AS old_key,
               CASE WHEN o.side IS NULL THEN 'insert' WHEN n.side IS NULL THEN 'delete' ELSE 'rekey' END AS op,
               CASE WHEN o.side IS NULL OR n.side IS NULL THEN '' ELSE {_compared(columns)} END AS changed, n.sha AS sha
        FROM (SELECT * FROM part WHERE side = 0) o FULL OUTER JOIN (SELECT * FROM part WHERE side = 1) n ON o.{text} IS NOT DISTINCT FROM n.{text} AND o.nth = n.nth
        """,
        "key long, old_key long, op string, changed string, sha binary",
    )
    return pairs.unionByName(paired).select("key", "old_key", "op", "changed", F.lower(F.hex("sha")).alias("row_sha256"))


def later(docs: DataFrame) -> DataFrame:
    """The later snapshot of `documents` by the rules of op12: crc32 of the decimal id modulo 16 changes rows."""
    rule = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 16
    rule = F.coalesce(rule, F.lit(15))  # rows without an id stay as they are
    moved = F.lit(-1).cast("long") - docs["doc_id"]
    own = F.struct(
        F.when(rule.isin(3, 4), moved).otherwise(docs["doc_id"]).alias("doc_id"),
        F.when(rule == 1, F.concat(F.coalesce(docs["text"], F.lit("")), F.lit("+"))).otherwise(docs["text"]).alias("text"),
        F.when(rule == 2, docs["source"]).otherwise(docs["lang"]).alias("lang"),
        F.when(rule == 2, docs["lang"]).when(rule != 4, docs["source"]).alias("source"),
    )
    copy = F.struct(moved.alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"), docs["source"].alias("source"))
    rows = F.when(rule == 5, F.array(own, copy)).when(rule != 0, F.array(own)).otherwise(F.array().cast("array<struct<doc_id:bigint,text:string,lang:string,source:string>>"))
    return docs.select(F.inline(rows))


def op12_snapshot_diff(spark, sf_dir: str) -> DataFrame:
    """What became of all documents in a later snapshot that is derived from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return difference(docs, later(docs), ["text", "lang", "source"])


#: CRC-32 of the decimal digits of an id, bit by bit: DuckDB has no such function.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: list_prepend(ascii(c)::BIGINT + 1000, list_transform(range(8), lambda i: 0::BIGINT))))), lambda a, b: CASE WHEN b >= 1000 THEN xor(a, b - 1000) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""
OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, text, lang, source, coalesce({_CRC} % 16, 15) AS rule FROM documents
), n AS (
  SELECT CASE WHEN rule IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS key, CASE WHEN rule = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
         CASE WHEN rule = 2 THEN source ELSE lang END AS lang, CASE WHEN rule = 2 THEN lang WHEN rule <> 4 THEN source END AS source
  FROM d WHERE rule <> 0
  UNION ALL
  SELECT -1 - doc_id, text, lang, source FROM d WHERE rule = 5
), j AS (
  SELECT o.doc_id AS ok, n.key AS nk, o.text AS ot, n.text AS nt, o.lang AS ol, n.lang AS nl, o.source AS os, n.source AS ns FROM d o FULL OUTER JOIN n ON o.doc_id = n.key
), a AS (
  SELECT ok, ot, ol, os, row_number() OVER (PARTITION BY ot ORDER BY ok) AS i FROM j WHERE nk IS NULL
), b AS (
  SELECT nk, nt, nl, ns, row_number() OVER (PARTITION BY nt ORDER BY nk) AS i FROM j WHERE ok IS NULL
), r AS (
  SELECT *, CASE WHEN concat_ws(',', CASE WHEN ot IS DISTINCT FROM nt THEN 'text' END, CASE WHEN ol IS DISTINCT FROM nl THEN 'lang' END, CASE WHEN os IS DISTINCT FROM ns THEN 'source' END) = '' THEN 'same' ELSE 'update' END AS op
  FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL
  UNION ALL
  SELECT ok, nk, ot, nt, ol, nl, os, ns, CASE WHEN ok IS NULL THEN 'insert' WHEN nk IS NULL THEN 'delete' ELSE 'rekey' END FROM a FULL OUTER JOIN b ON ot IS NOT DISTINCT FROM nt AND a.i = b.i
)
SELECT coalesce(nk, ok) AS key, ok AS old_key, op,
       CASE WHEN op IN ('insert', 'delete') THEN '' ELSE concat_ws(',', CASE WHEN ot IS DISTINCT FROM nt THEN 'text' END, CASE WHEN ol IS DISTINCT FROM nl THEN 'lang' END, CASE WHEN os IS DISTINCT FROM ns THEN 'source' END) END AS changed,
       CASE WHEN nk IS NOT NULL THEN sha256(coalesce(nt, '~') || chr(10) || coalesce(nl, '~') || chr(10) || coalesce(ns, '~')) END AS row_sha256
FROM r
"""
QUERIES = {"op12_snapshot_diff": op12_snapshot_diff}
ORACLE_SQL = {"op12_snapshot_diff": OP12_SQL}
