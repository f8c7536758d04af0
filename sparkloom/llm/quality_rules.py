"""Quality rules: surface rules, and a hashed n-gram log-likelihood ratio between two multinomials.

The trusted-target multinomial counts hashed byte n-grams of the rows labelled good, the raw one those of
every row; both cover all rows. A text's score is the mean log ratio of its n-grams, so length does not
matter, and a fixed threshold decides: equal texts always get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm import kernel as K
from sparkloom.llm.sketches import COUNT_SCHEMA, gathered, sliced

BUCKETS = 1 << 16
THRESHOLD = -0.25
#: Weight of the raw corpus in the smoothed target, as a share of the target's n-grams.
PRIOR = 0.05
#: Ratios are whole numbers of this part, so that a text's sum does not depend on its neighbours.
UNIT = 1 << 20
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"


def _ngrams(x: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte 4-grams of a run, and where each text's begin (those across a border are left out)."""
    b = x.raw.astype(np.uint32)
    n = len(b) - 3
    if n <= 0:
        return np.empty(0, dtype=np.uint16), np.zeros(x.n + 1, dtype=np.int64)
    v = (((b[:n] << 8 | b[1 : n + 1]) << 8 | b[2 : n + 2]) << 8 | b[3:]) * np.uint32(2654435761)
    keep = np.ones(n, dtype=bool)
    for k in range(1, 4):
        at = x.offs[1:-1] - k
        keep[at[(at >= 0) & (at < n)]] = False
    return (v >> np.uint32(16)).astype(np.uint16)[keep], np.searchsorted(np.flatnonzero(keep), x.offs)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, any_rows = np.zeros((2, BUCKETS), dtype=np.int64), False
    for batch in batches:
        trusted = K.column(batch, "trusted").to_numpy(zero_copy_only=False)
        for x in K.texts(K.column(batch, "text")):
            any_rows = True
            grams, bounds = _ngrams(x)
            counts[1] += np.bincount(grams, minlength=BUCKETS)
            own = np.repeat(trusted[x.first : x.first + x.n], np.diff(bounds))
            counts[0] += np.bincount(grams[own], minlength=BUCKETS)
    if any_rows:
        yield sliced(counts)


def fit_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of each n-gram bucket in whole units of 1 / UNIT, from all rows of `docs` (doc_id, text) and `labels` (doc_id, quality).

    An id whose labels disagree is not trusted. Without trusted rows every ratio is 0.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("good_id"))
    # the labels grow with the corpus, so they are shuffled, but the texts need no sort
    joined = docs.join(good.hint("shuffle_hash"), docs["doc_id"] == good["good_id"], "left").select(F.col("good_id").isNotNull().alias("trusted"), "text")
    target, raw = gathered(joined.mapInArrow(_count, COUNT_SCHEMA), (2, BUCKETS))
    if not target.sum():
        return np.zeros(BUCKETS, dtype=np.int64)
    # the target is smoothed towards the raw corpus, so a small target does not look unlike it everywhere
    background = (raw + 1) / (raw.sum() + BUCKETS)
    prior = 1 + PRIOR * target.sum()
    ratio = np.log((target + prior * background) / (target.sum() + prior)) - np.log(background)
    return np.round(ratio * UNIT).astype(np.int64)


def _lines(x: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the \\n-split lines that hold a word."""
    breaks = np.flatnonzero(x.buf == 10)
    starts, ends = np.sort(np.r_[x.offs[:-1], breaks + 1]), np.sort(np.r_[x.offs[1:], breaks])
    some = np.searchsorted(x.starts, starts) < np.searchsorted(x.starts, ends)
    return starts[some], ends[some]


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][bounds])


def figures(x: K.Texts, ratio: np.ndarray) -> dict[str, np.ndarray]:
    docs, out = x.doc_of_word(), {"n_words": np.diff(x.bounds)}
    out["word_chars"] = _per_text(x.inside & ((x.buf & 0xC0) != 0x80), x.offs)
    out["n_symbols"] = _per_text(SYMBOLS[x.buf], x.offs)
    s, e = _lines(x)
    of = np.searchsorted(x.offs, s, "right") - 1
    order = np.lexsort((s, x.range_hash(s, e), of))
    h, d = x.range_hash(s, e)[order], of[order]
    again = np.r_[False, (h[1:] == h[:-1]) & (d[1:] == d[:-1])][: len(h)]
    out["n_dup_lines"] = np.bincount(d[again], minlength=x.n)
    g, at = K.grams(x.words(), docs, 3)
    order = np.lexsort((g, docs[at]))
    h, d = g[order], docs[at][order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    twice = np.r_[False, same][: len(h)] | np.r_[same, False][: len(h)]
    edge = np.zeros(len(docs) + 1, dtype=np.int32)
    begin = at[order[twice]]
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + 3, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(edge[:-1]) > 0, x.bounds)
    grams, bounds = _ngrams(x)
    out["llr"] = _per_text(ratio[grams], bounds) / UNIT / np.maximum(1, np.diff(bounds))
    return out


def _score(ratio: np.ndarray, schema: pa.Schema):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [figures(x, ratio) for x in K.texts(K.column(batch, "text"))]
            yield K.batch_of(schema, {"row": K.column(batch, "row"), **{k: np.concatenate([p[k] for p in parts]) if parts else [] for k in schema.names[1:]}})

    return score


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with its figures and verdict.

    Returns: row (struct: the input row), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr (mean
    log-likelihood ratio per n-gram), base_failed, kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not base_failed and
    llr >= threshold. Defined cases: a null text has no words and fails; a null id is never trusted; labels that
    disagree make an id untrusted; repeated rows are judged each; an empty table gives an empty table; without
    trusted rows every llr is 0; equal texts get equal figures and verdicts.
    """
    text = docs[text_col].cast("string")
    ratio = fit_ratio(docs.select(docs[id_col].alias("doc_id"), text.alias("text")), labels.select("doc_id", "quality"))
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"))
    schema = wide.selectExpr("row", "0L n_words", "0L word_chars", "0L n_symbols", "0L n_dup_lines", "0L n_repeat_words", "0D llr").schema
    out = wide.mapInArrow(_score(ratio, to_arrow_schema(schema)), schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Figures and verdicts of all documents; rows labelled quality 1 are the trusted target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE_SQL: dict[str, str] = {}
