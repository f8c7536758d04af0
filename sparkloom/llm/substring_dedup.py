"""Substring dedup by fixed-block anchors.

Non-overlapping reference blocks of `block` words are the index; every rolling window of `block`
words of every text probes it. A window of `window` >= 2 * block - 1 words always holds a whole
reference block, wherever it stands, so every repeated window meets an index entry. Hits are extended
over the windows of `window` words around them, and neighbouring repeated windows join to maximal
exact repeats. The first occurrence of a window stays; the words of all later ones go.

Steps, each cut with a table in the shared folder:
1. probes: one pass over the texts, hashes dealt to buckets as packed arrays; a hash that repeats inside
   a unit of some million words is settled there and sent once, so one passage in a third of all texts
   sends a few entries per unit instead of one per text;
2. hits come back to their texts by row key; the windows around hits are dealt out in the same way with
   76 or more bits of hash, and all but the first place of each are marked;
3. marks are gathered per row and applied to the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm import kernel as K
from sparkloom.llm.storage import bucket_bits, corpus_size, forget, materialize

NULL_ID = -(2**63)
UNIT_WORDS = 1_000_000
PROBE_SCHEMA = "bucket long, unit long, kind int, a binary, b binary, c binary"
HIT_SCHEMA = "unit long, kind int, a binary, b binary, c binary"
MARK_SCHEMA = "id long, rk long, marks binary"
_PROBE = pa.schema([("bucket", pa.int64()), ("unit", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_HIT = pa.schema([*_PROBE][1:])
_MARK = pa.schema([("id", pa.int64()), ("rk", pa.int64()), ("marks", pa.binary())])
PROBES, UNIT, LOCAL = 0, 1, 2


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return K.batch_of(schema, {f.name: [r[i] for r in rows] for i, f in enumerate(schema)})


def _alike(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal values together, and where each run begins in it."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    return order, np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, dtype=np.int64)


def _probe(block: int, bits: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        unit, held, count = (ctx.partitionId() if ctx else 0) << 24, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal unit, held, count
            tags, ords, aligned, ids, keys, begins, base = [], [], [], [], [], [], 0
            for x, own_ids, own_keys in held:
                g, at = x
                tags.append(g[0]), aligned.append(g[1]), ords.append(at[0] + base)
                ids.append(own_ids), keys.append(own_keys), begins.append(at[1] + base)
                base += at[2]
            tag, order_of, fixed = map(np.concatenate, (tags, ords, aligned))
            rows = [(-1 - unit % 1009, unit, UNIT, K.pack(np.concatenate(ids)), K.pack(np.concatenate(keys)), K.pack_rising(np.concatenate(begins).astype(np.uint32)))]
            if len(tag):
                order, runs = _alike(tag)
                sizes = np.diff(np.r_[runs, len(tag)])
                known = (sizes > 1) & np.logical_or.reduceat(fixed[order], runs)
                hit = np.zeros(len(tag), dtype=bool)
                hit[order[np.repeat(known, sizes)]] = True
                if hit.any():
                    rows.append((-1 - unit % 1009, unit, LOCAL, K.pack_rising(order_of[hit].astype(np.uint32)), None, None))
                # of the windows that are settled here, one aligned one stands for all
                send = ~hit
                some = order[hit[order] & fixed[order]]
                if len(some):
                    send[some[np.r_[True, tag[some][1:] != tag[some][:-1]]]] = True
                at = np.flatnonzero(send)
                for bucket, own in K.by_bucket((tag[at] >> K.U64(32)).astype(np.uint32)):
                    own = at[own]
                    rows.append((bucket, unit, PROBES, K.pack(tag[own].astype(np.uint32)), K.pack_rising(order_of[own].astype(np.uint32)), np.packbits(fixed[own]).tobytes()))
            unit, held, count = unit + 1, [], 0
            return _rows(_PROBE, rows)

        for batch in batches:
            ids, keys = (K.column(batch, c).to_numpy(zero_copy_only=False) for c in ("id", "rk"))
            for x in K.texts(K.column(batch, "text")):
                docs = x.doc_of_word()
                g, at = K.grams(x.words(), docs, block)
                fixed = (at - x.bounds[docs[at]]) % block == 0
                tag = g >> K.U64(64 - bits - 32)
                held.append((((tag, fixed), (at, x.bounds[:-1], len(docs))), ids[x.first : x.first + x.n], keys[x.first : x.first + x.n]))
                count += len(docs)
                if count >= UNIT_WORDS:
                    yield flush()
        if held:
            yield flush()

    return probe


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """One bucket: windows that equal a reference block at another place, by unit."""
    if key[0].as_py() < 0:
        return table.select(_HIT.names)
    units, blobs, ends, flags = (K.binaries(table, n) for n in ("unit", "a", "b", "c"))
    tags = [K.unpack(b, np.uint32) for b in blobs]
    fixed = [np.unpackbits(np.frombuffer(f, dtype=np.uint8), count=len(t)).astype(bool) for f, t in zip(flags, tags, strict=True)]
    tag, flag = np.concatenate(tags), np.concatenate(fixed)
    index, copies = np.unique(tag[flag], return_counts=True)
    rows = []
    if len(index):
        at = np.minimum(np.searchsorted(index, tag), len(index) - 1)
        met = index[at] == tag
        total = copies + np.bincount(at[met & ~flag], minlength=len(index))
        hit = met & (total[at] > 1)
        lo = 0
        for unit, t, b in zip(units, tags, ends, strict=True):
            own = hit[lo : lo + len(t)]
            lo += len(t)
            if own.any():
                rows.append((unit, LOCAL, K.pack_rising(K.unpack_rising(b)[own].astype(np.uint32)), None, None))
    return pa.Table.from_batches([_rows(_HIT, rows)])


def _to_texts(key: tuple, table: pa.Table) -> pa.Table:
    """One unit: its hits by text, as word positions in the text."""
    kinds = table.column("kind").to_pylist()
    a = K.binaries(table, "a")
    found = [K.unpack_rising(b) for b, kind in zip(a, kinds, strict=True) if kind == LOCAL]
    rows = []
    if found:
        k = kinds.index(UNIT)
        ids, keys = K.unpack(a[k], np.int64), K.unpack(table.column("b")[k].as_py(), np.int64)
        begins = K.unpack_rising(table.column("c")[k].as_py())
        hits = np.unique(np.concatenate(found))
        owner = np.searchsorted(begins, hits, "right") - 1
        for doc, own in K.by_bucket(owner):
            rows.append((int(ids[doc]), int(keys[doc]), K.pack_rising((hits[own] - begins[doc]).astype(np.uint32))))
    return pa.Table.from_batches([_rows(_MARK, rows)])


def _dealt(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Marked places (doc: index into ids and keys) as one packed row for each destination that gets some."""
    home = (K.mix(ids.view(K.U64)) % K.U64(parts)).astype(np.int64)
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    for part, at in K.by_bucket(home[doc]):
        own = doc[at]
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        yield part, _doc_blob(ids[own[cuts]], keys[own[cuts]], np.diff(np.r_[cuts, len(own)])), K.pack(pos[at].astype(np.uint32))


def _around(block: int, window: int, bits: int, parts: int):
    """Windows of `window` words that hold a hit; the later ones of a unit are marked at once."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count
            high, low, doc, pos = (np.concatenate([h[i] for h in held]) for i in range(4))
            base = np.cumsum([0] + [len(h[4]) for h in held])
            doc = doc + np.repeat(base[:-1], [len(h[2]) for h in held])
            ids, keys = (np.concatenate([h[i] for h in held]) for i in (4, 5))
            rows = []
            order = np.lexsort((pos, ids[doc], low, high))
            h, w, d, p = high[order], low[order], ids[doc[order]], pos[order]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])] if len(h) else np.empty(0, dtype=bool)
            # rows that repeat one place (equal rows) tie with it
            first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            late = (d != d[first]) | (p != p[first])
            rows += [(-1 - part, 1, table, places, b"") for part, table, places in _dealt(ids, keys, doc[order[late]], p[late], parts)]
            at = np.sort(order[~late])
            for bucket, own in K.by_bucket((high[at] >> K.U64(64 - bits)).astype(np.uint32) if bits else np.zeros(len(at), dtype=np.uint32)):
                own = at[own]
                cuts = np.flatnonzero(np.r_[True, doc[own][1:] != doc[own][:-1]])
                rows.append((bucket, 0, _doc_blob(ids[doc[own[cuts]]], keys[doc[own[cuts]]], np.diff(np.r_[cuts, len(own)])), K.pack(pos[own].astype(np.uint32)), K.pack(low[own])))
            held, count = [], 0
            return K.batch_of(_WINDOW, {f.name: [r[i] for r in rows] for i, f in enumerate(_WINDOW)})

        for batch in batches:
            ids, keys = (K.column(batch, c).to_numpy(zero_copy_only=False) for c in ("id", "rk"))
            marks = K.binaries(batch, "marks")
            for x in K.texts(K.column(batch, "text")):
                docs, words = x.doc_of_word(), x.words()
                edge = np.zeros(len(words) + 1, dtype=np.int32)
                for d in range(x.n):
                    hits = K.unpack_rising(marks[x.first + d])
                    lo, last = x.bounds[d], x.bounds[d + 1] - window
                    begin, end = np.maximum(hits + lo - (window - block), lo), np.minimum(hits + lo, last) + 1
                    ok = begin < end
                    np.add.at(edge, begin[ok], 1)
                    np.add.at(edge, end[ok], -1)
                wanted = np.cumsum(edge[:-1]) > 0
                high, at = K.grams(words, docs, window, 2)
                own = wanted[at]
                low = K.grams(words, docs, window, 3)[0][own]
                high, at = high[own], at[own]
                held.append((high, low, docs[at].astype(np.int64), at - x.bounds[docs[at]], ids[x.first : x.first + x.n], keys[x.first : x.first + x.n]))
                count += len(at)
                if count >= UNIT_WORDS // 2:
                    yield flush()
        if held:
            yield flush()

    return around


_DEALT = pa.schema([("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
DEALT_SCHEMA = "part long, a binary, b binary"
_WINDOW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
WINDOW_SCHEMA = "bucket long, kind int, a binary, b binary, c binary"


def _doc_blob(ids, keys, counts) -> bytes:
    return K.pack(np.r_[np.asarray(ids, dtype=np.int64), np.asarray(keys, dtype=np.int64), np.asarray(counts, dtype=np.int64)])


def _doc_table(blob: bytes) -> np.ndarray:
    return K.unpack(blob, np.int64).reshape(3, -1)


def _later(parts: int):
    def later(key: tuple, table: pa.Table) -> pa.Table:
        """One bucket of windows: every place but the first of each window."""
        docs = [_doc_table(b) for b in K.binaries(table, "a")]
        ids, keys, counts = np.concatenate(docs, axis=1)
        pos = np.concatenate([K.unpack(b, np.uint32) for b in K.binaries(table, "b")])
        low = np.concatenate([K.unpack(b, np.uint64) for b in K.binaries(table, "c")])
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((pos, ids[doc], low))
        w, d, p = low[order], ids[doc[order]], pos[order]
        fresh = np.r_[True, w[1:] != w[:-1]]
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        late = (d != d[first]) | (p != p[first])
        rows = list(_dealt(ids, keys, doc[order[late]], p[late], parts))
        return pa.Table.from_batches([_rows(_DEALT, rows)])

    return later


def _gather(key: tuple, table: pa.Table) -> pa.Table:
    """One destination: all marked places of each of its rows."""
    ids, keys, counts = np.concatenate([_doc_table(b) for b in K.binaries(table, "a")], axis=1)
    pos = np.concatenate([K.unpack(b, np.uint32) for b in K.binaries(table, "b")])
    doc = np.repeat(np.arange(len(ids)), counts)
    order = np.lexsort((pos, keys[doc], ids[doc]))
    i, k, p = ids[doc][order], keys[doc][order], pos[order]
    new = np.r_[True, (i[1:] != i[:-1]) | (k[1:] != k[:-1])]
    cuts = np.r_[np.flatnonzero(new), len(p)]
    rows = [(int(i[lo]), int(k[lo]), K.pack_rising(np.unique(p[lo:hi]))) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.Table.from_batches([_rows(_MARK, rows)])


def _apply(window: int, schema: pa.Schema):
    """The words that stay, in the order of the text and joined by one space; figures of each text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict = {"n_words": [], "n_removed": [], "text": [], "kept_sha256": [], "spans": []}
            marks = K.column(batch, "marks").to_pylist()
            for x in K.texts(K.column(batch, "text")):
                edge = np.zeros(len(x.starts) + 1, dtype=np.int32)
                for d in range(x.n):
                    lo, hi = x.bounds[d], x.bounds[d + 1]
                    blob = marks[x.first + d]
                    if blob:
                        begin = K.unpack_rising(blob) + lo
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, np.minimum(begin + window, hi), -1)
                gone = np.cumsum(edge[:-1]) > 0
                # bytes of kept words, each followed by one space
                step = np.zeros(len(x.buf) + 1, dtype=np.int8)
                np.add.at(step, x.starts[~gone], 1)
                np.add.at(step, x.ends[~gone], -1)
                stay = np.cumsum(step[:-1], dtype=np.int8) > 0
                sizes = (x.ends - x.starts)[~gone]
                out = np.full(int(sizes.sum()) + len(sizes), 0x20, dtype=np.uint8)
                ends = np.cumsum(sizes + 1)
                fill = np.ones(len(out), dtype=bool)
                fill[ends - 1] = False
                out[fill] = x.raw[stay]
                kept = np.searchsorted(np.flatnonzero(~gone), x.bounds)
                cuts = np.r_[0, ends][kept]
                data = out.tobytes()
                for d in range(x.n):
                    lo, hi = x.bounds[d], x.bounds[d + 1]
                    text = data[cuts[d] : max(cuts[d], cuts[d + 1] - 1)]
                    change = np.flatnonzero(np.diff(np.r_[False, gone[lo:hi], False].astype(np.int8)))
                    rows["n_words"].append(int(hi - lo))
                    rows["n_removed"].append(int(gone[lo:hi].sum()))
                    rows["text"].append(text.decode())
                    rows["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                    rows["spans"].append([{"first": int(s), "last": int(e) - 1} for s, e in change.reshape(-1, 2)])
            yield K.batch_of(schema, {"row": K.column(batch, "row"), **rows})

    return apply


def remove_repeats(docs: DataFrame, window: int = 20, block: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with the words of later repeats removed.

    Returns: row (struct: the input row, whatever its columns), n_words, n_removed, text (kept words joined
    by one space), kept_sha256, spans (array of the removed first..last word positions: maximal exact repeats).

    A word is a run of characters other than space and U+0009..U+000D. A window is `window` consecutive words
    of one text; its earlier place has a smaller id, or the same id and an earlier start. Needs
    2 * block - 1 <= window. Defined cases: null text has no words; texts shorter than a window are kept whole;
    a null id is smaller than all others; rows that repeat an id and its text tie, so neither is earlier than
    the other; rows of one id with different texts are one document whose texts overlay each other; an empty
    table gives an empty table; extra columns stay inside `row`, whatever their names.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must always hold a whole reference block: 2 * block - 1 <= window")
    _, size = corpus_size(docs, text_col)
    text = docs[text_col].cast("string")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("rk"), text.alias("text"))
    slim = keyed.select("id", "rk", "text")

    # buckets are few and heavy: a number of partitions of their own keeps them apart
    bits = bucket_bits(size, 12_000_000)
    probes = slim.mapInArrow(_probe(block, bits), PROBE_SCHEMA)
    met = probes.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(_meet, HIT_SCHEMA)
    found = materialize(met.groupBy("unit").applyInArrow(_to_texts, MARK_SCHEMA), "hits")
    # equal rows give one row of hits each; their union is the same
    hits = found.groupBy("id", "rk").agg(F.max("marks").alias("marks"))

    # texts are joined by sorting at every size: what they meet grows with the corpus
    wide = hits.hint("merge").join(slim, ["id", "rk"]).select("id", "rk", "text", "marks")
    bits, parts = bucket_bits(size, 20_000_000), -(-max(1, size) // 100_000_000)
    windows = materialize(wide.mapInArrow(_around(block, window, bits, parts), WINDOW_SCHEMA), "windows")
    late = windows.where("kind = 0").repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(_later(parts), DEALT_SCHEMA)
    late = late.unionByName(windows.where("kind = 1").select((-1 - F.col("bucket")).alias("part"), "a", "b"))
    marks = materialize(late.groupBy("part").applyInArrow(_gather, MARK_SCHEMA), "marks")
    forget(found, windows)

    joined = keyed.join(marks.hint("merge"), ["id", "rk"], "left").select("row", "text", "marks")
    schema = joined.selectExpr("row", "0L n_words", "0L n_removed", "'' text", "'' kept_sha256", "array(named_struct('first', 0L, 'last', 0L)) spans").schema
    return joined.mapInArrow(_apply(window, to_arrow_schema(schema)), schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words over all documents; earlier occurrences stay."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p+19], ' ')) AS h FROM w, unnest(range(1, len(ws) - 18)) t(p) WHERE len(ws) >= 20
), late AS (
  SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1
), gone AS (
  SELECT DISTINCT doc_id, p + k AS p FROM late, unnest(range(0, 20)) t(k)
), dead AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN dead USING (doc_id)
"""
QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLE_SQL = {"op1_substring_dedup": OP1_SQL}
