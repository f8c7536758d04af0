"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (ended by \\n, or by . ! ? and a space) are hashed to 64-bit digests, the k-th repeat of a
paragraph to another one. Each digest goes to three cells of a table: every cell holds a count, the xor of its
digests and the xor of their check sums. The smallest table is the fingerprint. Two versions are compared by
subtracting their tables and peeling cells that hold one digest, which recovers the digests of the paragraphs
that differ; if peeling stalls, both tables are built again, four times as large. The likeness is the share
of common paragraphs among all, exact once peeling ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import kernel as K
from sparkloom.llm.storage import corpus_size, materialize

NULL_ID = -(2**63)
CELLS = 12
HASHES = 3
_OUT = pa.schema([("kind", pa.int32()), ("pid", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
OUT_SCHEMA = "kind int, pid long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
BREAK = np.zeros(256, dtype=bool)
BREAK[list(b".!?")] = True


class Digests:
    """Paragraph digests of many texts: `key`, and `of`, the text of each."""

    def __init__(self, texts: list[str]):
        keys, owners = [np.empty(0, dtype=K.U64)], [np.empty(0, dtype=np.int64)]
        for x in K.texts(pa.array(texts, type=pa.large_string())):
            b = x.buf
            cut = b == 10
            if len(b) > 1:
                cut[1:] |= BREAK[b[:-1]] & (b[1:] == 0x20)
            at = np.flatnonzero(cut) + 1
            starts = np.union1d(x.offs[:-1], at)
            ends = np.r_[starts[1:], len(b)].astype(np.int64)
            first, last = np.searchsorted(x.starts, starts), np.searchsorted(x.starts, ends)
            some = first < last
            starts, ends = x.starts[first[some]], x.ends[last[some] - 1]  # white space around a paragraph is none of it
            of = np.searchsorted(x.offs, starts, "right") - 1
            h = x.range_hash(starts, ends, 31)
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])][: len(h)]
            turn = np.arange(len(h)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(h) else np.empty(0, dtype=np.int64)
            keys.append(K.mix(h + turn.astype(K.U64) * K._GRAM[6, 3], 32))
            owners.append(of + x.first)
        self.n, self.key, self.of = len(texts), np.concatenate(keys), np.concatenate(owners)
        self.sizes = np.bincount(self.of, minlength=self.n)


def _cells(key: np.ndarray, m: int) -> list[np.ndarray]:
    part = m // HASHES
    return [(K.mix(key, 41 + j) % K.U64(part)).astype(np.int64) + j * part for j in range(HASHES)]


def tables(key: np.ndarray, of: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, xor of digests, xor of check sums) of n tables with m cells."""
    count, keys, checks = np.zeros(n * m, dtype=np.int64), np.zeros(n * m, dtype=K.U64), np.zeros(n * m, dtype=K.U64)
    _add(count, keys, checks, key, of, np.ones(len(key), dtype=np.int64), m)
    return count, keys, checks


def _add(count, keys, checks, key, of, sign, m) -> None:
    check = K.mix(key, 51)
    for cell in _cells(key, m):
        at = of * m + cell
        order = np.argsort(at, kind="stable")
        ranked = at[order]
        if not len(ranked):
            return
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        where = ranked[first]
        count[where] += np.add.reduceat(sign[order], first)
        keys[where] ^= np.bitwise_xor.reduceat(key[order], first)
        checks[where] ^= np.bitwise_xor.reduceat(check[order], first)


def differing(a: Digests, ia: np.ndarray, b: Digests, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, side) of the digests that differ in each pair of texts: side 1 only in a, -1 only in b."""
    found: list[tuple] = []
    left, m = np.arange(len(ia)), CELLS
    while len(left):
        (ka, oa), (kb, ob) = digests_of(a, ia[left]), digests_of(b, ib[left])
        count, keys, checks = tables(ka, oa, len(left), m)
        other = tables(kb, ob, len(left), m)
        count -= other[0]
        keys ^= other[1]
        checks ^= other[2]
        peeled: list[tuple] = []
        while True:
            pure = np.flatnonzero((np.abs(count) == 1))
            pure = pure[K.mix(keys[pure], 51) == checks[pure]]
            if not len(pure):
                break
            of, key, sign = pure // m, keys[pure], count[pure]
            order = np.lexsort((key, of))
            of, key, sign = of[order], key[order], sign[order]
            fresh = np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])]
            of, key, sign = of[fresh], key[fresh], sign[fresh]
            peeled.append((of, key, sign))
            _add(count, keys, checks, key, of, -sign, m)
        stuck = ((count != 0) | (keys != 0)).reshape(len(left), m).any(axis=1)
        for of, key, sign in peeled:
            own = ~stuck[of]
            found.append((left[of[own]], key[own], sign[own]))
        left, m = left[stuck], m * 4
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=K.U64), np.empty(0, dtype=np.int64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def digests_of(d: Digests, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the chosen texts (which may repeat), by place in `chosen`."""
    begins = np.searchsorted(d.of, np.arange(d.n + 1))
    sizes = d.sizes[chosen]
    at = np.repeat(begins[chosen] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(chosen) else np.empty(0, dtype=np.int64)
    return d.key[at], np.repeat(np.arange(len(chosen)), sizes)


def likeness(a: Digests, ia: np.ndarray, b: Digests, ib: np.ndarray) -> np.ndarray:
    """Common paragraphs over all paragraphs of each pair; two texts without paragraphs are alike."""
    differ = np.bincount(differing(a, ia, b, ib)[0], minlength=len(ia))
    total = a.sizes[ia] + b.sizes[ib]
    return np.where(total > 0, (total - differ) / np.maximum(1, total + differ), 1.0)


def serialised(d: Digests) -> list[str]:
    """The smallest table of each text as hex: per cell a 16-bit count, the digests' xor and 16 bits of check."""
    count, keys, checks = tables(d.key, d.of, d.n, CELLS)
    cells = np.empty((d.n * CELLS, 12), dtype=np.uint8)
    cells[:, 0:2] = count.astype(">u2").view(np.uint8).reshape(-1, 2)
    cells[:, 2:10] = keys.astype(">u8").view(np.uint8).reshape(-1, 8)
    cells[:, 10:12] = (checks & K.U64(0xFFFF)).astype(">u2").view(np.uint8).reshape(-1, 2)
    data, size = cells.tobytes().hex(), CELLS * 24
    return [data[i * size : (i + 1) * size] for i in range(d.n)]


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text's first ones."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _figures(pid: int, ids: list, texts: list[str], nexts: list[str]) -> Iterator[pa.RecordBatch]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 2_000_000):
            size += len(texts[hi])
            hi += 1
        own, after = texts[lo:hi], nexts[lo:hi]
        edited = [edit(t, f) for t, f in zip(own, after, strict=True)]
        a, e, f = Digests(own), Digests(edited), Digests(after)
        at = np.arange(len(own))
        n = len(own)
        yield K.batch_of(_OUT, {
            "kind": [0] * n, "pid": [pid] * n, "doc_id": ids[lo:hi], "n_chars": [len(t) for t in own], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": serialised(a), "edited_fingerprint": serialised(e), "near_edited": likeness(a, at, e, at), "near_next": likeness(a, at, f, at), "text": [None] * n,
        })
        lo = hi


def _edge(kind: int, pid: int, doc: int, text: str) -> pa.RecordBatch:
    blank = {f.name: [None] for f in _OUT}
    return K.batch_of(_OUT, blank | {"kind": [kind], "pid": [pid], "doc_id": [doc], "text": [text]})


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition in falling order of id: each text with the next one; the first and the last also as edges."""
    ctx = TaskContext.get()
    pid, last = ctx.partitionId() if ctx else 0, None
    for batch in batches:
        ids, texts = K.column(batch, "id").to_pylist(), K.column(batch, "text").to_pylist()
        if not ids:
            continue
        if last is None:
            yield _edge(1, pid, ids[0], texts[0])
        else:
            ids, texts = [last[0], *ids], [last[1], *texts]
        yield from _figures(pid, ids[:-1], texts[:-1], texts[1:])
        last = ids[-1], texts[-1]
    if last is not None:
        yield _edge(2, pid, *last)


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _figures(0, K.column(batch, "id").to_pylist(), K.column(batch, "text").to_pylist(), K.column(batch, "following").to_pylist())


def _following(pids: DataFrame) -> DataFrame:
    """(tail, pid): the next partition that has rows, after the last one the first. Found by blocks of 4096 partitions, so one task orders blocks only."""
    own = pids.select("pid", F.shiftright("pid", 12).alias("block"))
    line = Window.orderBy("block")
    firsts = own.groupBy("block").agg(F.min("pid").alias("first"))
    around = F.first("first").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("block", F.coalesce(F.lead("first").over(line), around).alias("after"))
    within = own.withColumn("next", F.lead("pid").over(Window.partitionBy("block").orderBy("pid")))
    return within.join(after, "block").select(F.col("pid").alias("tail"), F.coalesce("next", "after").alias("pid"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = 24_000_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document follows in falling order of id (after the last: the first). Defined cases: a null text is
    empty and has no paragraphs; two texts without paragraphs have likeness 1; a null id is the smallest; rows
    that repeat an id follow each other in order of text; one row alone is its own next document; an empty table
    gives an empty table; other columns are not read.
    """
    rows, size = corpus_size(docs, text_col)
    base = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    parts = max(8, -(-size // partition_bytes))
    # the beginnings of texts only part the rows of a repeated id between tasks, in the order of the whole texts
    dealt = base.repartitionByRange(parts, F.col("id").desc(), F.substring("text", 1, 64)).sortWithinPartitions(F.col("id").desc(), "text")
    seen = materialize(dealt.mapInArrow(_stream, OUT_SCHEMA), "fingerprints")
    # the last text of each partition goes on with the first of the next partition that has rows
    heads = seen.where("kind = 1").select("pid", F.col("text").alias("following"))
    tails = seen.where("kind = 2").select(F.col("pid").alias("tail"), F.col("doc_id").alias("id"), "text")
    ends = tails.join(_following(heads.select("pid")), "tail").join(heads, "pid").select("id", "text", "following").mapInArrow(_tails, OUT_SCHEMA)
    out = seen.where("kind = 0").unionByName(ends)
    return out.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), *OUT_COLUMNS)


OUT_COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edited texts and their likeness."""
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op9_document_fingerprints": op9_document_fingerprints}
ORACLE_SQL: dict[str, str] = {}
