"""Source divergence audit: how far the word use of each source is from the other sources and from the whole of its language.

Sort-based streaming. Tasks turn blocks of documents into runs (lang, term, source, first document) with a document frequency and a number
of occurrences; the runs are dealt by (lang, term), sorted by (lang, term, source, document) and scanned once, run by run, so that
nothing but the current term is held. A second scan over the kept terms, sorted after the groups of their
language, emits partial pair sums and the leading terms of every group; Spark adds the pairs and ranks both.

Terms that stand in nearly every document send one run per block of documents instead of one per document; beyond `spread` blocks
a term is dealt over several tasks first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import kernel as K
from sparkloom.llm.storage import materialize

MIN_DOCS, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Bytes of text of a block of documents; groups of a language whose pairs a task keeps in one matrix; cells of a chunk of terms.
BLOCK_BYTES, MATRIX_GROUPS, CHUNK_CELLS = 1 << 23, 1024, 1 << 20
#: Letters A-Z, a-z and everything outside ASCII make terms.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
_RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("doc", pa.int64()), ("df", pa.int64()), ("n", pa.int64())])
RUN_SCHEMA = "lang string, term string, source string, doc long, df long, n long"
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
FOUND_SCHEMA = "lang string, source string, part string, item string, value long"


def _block_runs(groups: tuple[np.ndarray, np.ndarray], names: tuple, first: int, parts: list) -> pa.RecordBatch:
    """The runs of one block: parts are (group, term, occurrences) of each document's distinct terms, by document."""
    group, doc = groups
    at = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, dtype=np.int64)
    words = pa.concat_arrays([p[1].cast(pa.large_string()) for p in parts]).dictionary_encode() if parts else pa.array([], pa.large_string()).dictionary_encode()
    n = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, dtype=np.int64)
    code = words.indices.to_numpy().astype(np.int64)
    key = group[at] * max(1, len(words.dictionary)) + code
    order = np.argsort(key, kind="stable")
    key, at, n, code = key[order], at[order], n[order], code[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
    df = np.diff(np.r_[starts, len(key)])
    total = np.add.reduceat(n, starts) if len(starts) else n
    # every group says that it occurs by an empty term
    seen, first_at = np.unique(group, return_index=True)
    own = np.r_[seen, group[at[starts]]]
    term = pa.concat_arrays([pa.array([""] * len(seen), pa.large_string()), words.dictionary.take(pa.array(code[starts]))])
    lang, source = (pa.array(x, pa.string()).take(pa.array(own)) for x in names)
    return K.batch_of(_RUN, {"lang": lang, "term": term.cast(pa.string()), "source": source, "doc": np.r_[doc[first_at], doc[at[starts]]] + first, "df": np.r_[np.zeros(len(seen), dtype=np.int64), df], "n": np.r_[np.zeros(len(seen), dtype=np.int64), total]})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of blocks of about BLOCK_BYTES of text; rows are numbered in the order of their task."""
    number, size, groups, parts, names, first = 0, 0, [], [], {}, 0

    def flush() -> pa.RecordBatch:
        both = list(zip(*names, strict=True)) if names else ([], [])
        group = np.concatenate(groups)
        return _block_runs((group, np.arange(len(group))), (list(both[0]), list(both[1])), first, parts)

    for batch in batches:
        lang, source = (K.column(batch, c).to_pylist() for c in ("lang", "source"))
        for x in K.texts(K.column(batch, "text"), LETTERS, lower=True):
            groups.append(np.array([names.setdefault((lang[i], source[i]), len(names)) for i in range(x.first, x.first + x.n)], dtype=np.int64))
            if len(x.starts):
                offs = np.empty(2 * len(x.starts) + 1, dtype=np.int64)
                offs[0], offs[1::2], offs[2::2] = 0, x.starts, x.ends
                pieces = pa.LargeStringArray.from_buffers(2 * len(x.starts), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(x.buf)))
                words = pieces.take(pa.array(np.arange(1, 2 * len(x.starts), 2))).dictionary_encode()
                key = x.doc_of_word().astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
                distinct, n = np.unique(key, return_counts=True)
                parts.append((distinct // len(words.dictionary) + number - first, words.dictionary.take(pa.array(distinct % len(words.dictionary))), n))
            number += x.n
            size += len(x.buf)
            if size >= BLOCK_BYTES:
                yield flush()
                size, groups, parts, names, first = 0, [], [], {}, number
    if groups:
        yield flush()


def _scanned(min_docs: int):
    """One pass over runs sorted by (lang, term, source, doc): runs of a (lang, term, source) become one, terms in fewer than min_docs documents go."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed(rows: pa.Table) -> pa.RecordBatch:
            lang, term, source = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
            a, b, c = (x.indices.to_numpy() for x in (lang, term, source))
            df, n, doc = (rows.column(x).to_numpy() for x in ("df", "n", "doc"))
            new_term = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            starts = np.flatnonzero(new_term | np.r_[True, c[1:] != c[:-1]])
            terms = np.flatnonzero(new_term)
            per_term = np.add.reduceat(df, terms)[np.cumsum(new_term) - 1]
            keep = (per_term[starts] >= min_docs) | (np.array(term.dictionary.to_pylist())[b[starts]] == "")
            own = pa.array(starts[keep])
            return K.batch_of(_RUN, {"lang": lang.take(own).cast(pa.string()), "term": term.take(own).cast(pa.string()), "source": source.take(own).cast(pa.string()), "doc": doc[starts[keep]], "df": np.add.reduceat(df, starts)[keep], "n": np.add.reduceat(n, starts)[keep]})

        for batch in batches:
            if not len(batch):
                continue
            # all but the last term of what has come is complete
            lang, term = K.column(batch, "lang"), K.column(batch, "term")
            last = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1])).to_numpy(zero_copy_only=False)
            cut = len(batch) - int(last[::-1].argmin()) if not last.all() else 0
            if cut or held and not (K.column(held[-1], "lang")[-1] == lang[0] and K.column(held[-1], "term")[-1] == term[0]):
                yield closed(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield closed(pa.Table.from_batches(held))

    return scan


def _shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), in whole numbers of any size."""
    over = int(n.max(initial=0)) + SMOOTH >= 2**63 // SCALE
    if over:
        return (1 + SCALE * (n.astype(object) + SMOOTH) // (total.astype(object) + SMOOTH * terms)).astype(np.int64)
    return 1 + SCALE * (n + SMOOTH) // (total + SMOOTH * terms)


def _compared(top: int):
    """One pass over a partition sorted by (lang, bucket, is_term, term, source): the groups of a language, then its terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None}

        def leave() -> Iterator[pa.RecordBatch]:
            if state["key"] is None:
                return
            if state["at"] is None:
                _open(state)
            bare = not state["terms"] and not any(state["heaps"])
            yield from chunk()
            names = state["names"]
            g = len(names)
            if g <= MATRIX_GROUPS:
                yield from pairs(state["sums"], 0)
            elif bare:  # pairs that no term has named
                for lo in range(g):
                    yield from pairs(np.zeros((1, g), dtype=np.int64), lo)
            rows = [(names[i], t, -v) for i, h in enumerate(state["heaps"]) for v, t in h]
            if rows:
                yield K.batch_of(_FOUND, {"lang": [state["key"][0]] * len(rows), "source": [r[0] for r in rows], "part": ["term"] * len(rows), "item": [r[1] for r in rows], "value": [-r[2] for r in rows]})

        def pairs(sums: np.ndarray, lo: int) -> Iterator[pa.RecordBatch]:
            names = np.array(state["names"], dtype=object)
            i, j = np.nonzero(np.arange(len(names)) != np.arange(lo, lo + len(sums))[:, None])
            if len(i):
                yield K.batch_of(_FOUND, {"lang": [state["key"][0]] * len(i), "source": pa.array(names[i + lo], pa.string()), "part": ["pair"] * len(i), "item": pa.array(names[j], pa.string()), "value": sums[i, j]})

        def chunk() -> Iterator[pa.RecordBatch]:
            terms = state["terms"]
            if not terms:
                return
            g, kept = len(state["names"]), state["v"]
            n = np.zeros((g, len(terms)), dtype=np.int64)
            for at, (_, who, counts) in enumerate(terms):
                n[who, at] = counts
            p = _shares(n, state["totals"][:, None], kept)
            q = _shares(n.sum(axis=0), np.array([state["total"]]), kept)
            more = np.where((n > 0) & (p > q), p - q, 0)
            for i in range(g):
                heap = state["heaps"][i]
                for at in np.flatnonzero(more[i]):
                    entry = (int(more[i, at]), _Falling(terms[at][0]))
                    heapq.heappush(heap, entry) if len(heap) < top else heapq.heappushpop(heap, entry)
            state["terms"] = []
            rows = max(1, CHUNK_CELLS // max(1, p.size))
            for lo in range(0, g, rows):
                sums = np.abs(p[lo : lo + rows, None, :] - p[None]).sum(axis=2)
                if g <= MATRIX_GROUPS:
                    state["sums"][lo : lo + rows] += sums
                else:
                    yield from pairs(sums, lo)

        for batch in batches:
            for lang, bucket, is_term, term, source, n, v in zip(*(K.column(batch, c).to_pylist() for c in ("lang", "bucket", "is_term", "term", "source", "n", "v")), strict=True):
                if state["key"] != (lang, bucket):
                    yield from leave()
                    state = {"key": (lang, bucket), "names": [], "counts": [], "v": v, "terms": [], "at": None}
                if not is_term:
                    state["names"].append(source)
                    state["counts"].append(n)
                    continue
                if state["at"] is None:
                    _open(state)
                if not state["terms"] or state["terms"][-1][0] != term:
                    if len(state["terms"]) * len(state["names"]) >= CHUNK_CELLS // 8:
                        yield from chunk()
                    state["terms"].append((term, [], []))
                state["terms"][-1][1].append(state["at"][source])
                state["terms"][-1][2].append(n)
        yield from leave()

    return scan


class _Falling(str):
    """A term that sorts after the terms that it precedes in UTF-8."""

    __slots__ = ()

    def __lt__(self, other: str) -> bool:
        return self.encode() > other.encode()


def _open(state: dict) -> None:
    g = len(state["names"])
    state["at"] = {s: i for i, s in enumerate(state["names"])}
    state["totals"] = np.array(state["counts"], dtype=np.int64)
    state["total"] = int(state["totals"].sum())
    state["heaps"] = [[] for _ in range(g)]
    state["sums"] = np.zeros((g, g), dtype=np.int64) if g <= MATRIX_GROUPS else None


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, spread: int = 256, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each source from the others of its language (`pair`), and its leading terms (`term`).

    Terms are runs of letters A-Z (lower-cased), a-z and characters outside ASCII. A language keeps the terms of at least `min_docs` of its
    rows; every group (lang, source) gives each of them the share 1 + floor(10^9 (count + 5) / (N + 5 V)), N being the group's occurrences of kept terms, V their
    number. A pair's value is the sum of the absolute differences of shares over the kept terms; a term's value is by how
    much its share in the group exceeds that in the whole language, the `top` largest being kept. Ranks run from 1 by falling value, then by
    item in UTF-8 order. Defined cases: null texts, languages and sources are read as ''; a group without terms takes
    part with counts of 0; a language without kept terms has pairs of value 0; a language with one source has no pairs; each row is
    a document, so repeated rows count again; very long texts are documents like any other; an empty table gives an empty table; other columns are not read.
    """
    base = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    order = ("lang", "term", "source", "doc")
    runs = base.mapInArrow(_runs, RUN_SCHEMA)
    parts = -(-base.rdd.getNumPartitions() // spread)
    if parts > 1:  # a term of all blocks goes to several tasks, which leave one run each
        salt = F.pmod(F.spark_partition_id(), F.lit(parts))
        runs = runs.withColumn("salt", salt).repartition("lang", "term", "salt").sortWithinPartitions(*order).select(*order, "df", "n").mapInArrow(_scanned(0), RUN_SCHEMA)
    kept = runs.repartition("lang", "term").sortWithinPartitions(*order).mapInArrow(_scanned(min_docs), RUN_SCHEMA)
    kept = materialize(kept.select("lang", "term", "source", "n"), "kept")
    terms = kept.where("term <> ''")
    sizes = kept.groupBy("lang").agg(F.count_distinct(F.when(F.col("term") != "", F.col("term"))).alias("v"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(sizes, "lang")
    buckets = terms.count() // 100_000 + 1
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(False).alias("is_term"), F.lit("").alias("term"), "source", "n", "v")
    rows = terms.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(True).alias("is_term"), "term", "source", "n", F.lit(0).cast("long").alias("v"))
    dealt = heads.unionByName(rows).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", "is_term", "term", "source")
    found = dealt.mapInArrow(_compared(top), FOUND_SCHEMA)
    # partial pairs add up; a term has one value
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language and their leading terms, over all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT x.lang, x.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY ALL
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 50
"""
QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE_SQL = {"op13_source_divergence": OP13_SQL}
