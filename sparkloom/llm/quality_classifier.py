"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Each passage is encoded from hashed byte n-gram frequencies and
the shares of its repeated words;
gated attention, tanh(V h) * sigmoid(U h), weighs the passages, and a logistic unit scores the weighted
representation. Only text labels train all weights together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm import kernel as K
from sparkloom.llm.labelled import held_out, sample

PASSAGE = 64
CELLS = 256
HIDDEN = 32
GATE = 16
PER_CLASS = 2000


class Bags:
    """Features of the passages of a run of texts, and the text of each; a text without words is one blank passage."""

    def __init__(self, x: K.Texts):
        words = np.diff(x.bounds)
        parts = np.maximum(1, -(-words // PASSAGE))
        self.of = np.repeat(np.arange(x.n), parts)
        turn = np.arange(len(self.of)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = x.bounds[self.of] + turn * PASSAGE
        self.first = np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]])
        # bytes of a passage: from its first word to the next passage's
        begin = np.r_[x.starts, len(x.raw)][np.minimum(first, len(x.starts))]
        begin = np.where(words[self.of] > 0, begin, x.offs[self.of])
        begin[self.first] = x.offs[:-1]
        b = x.raw.astype(np.uint32)
        n = len(b) - 2
        self.x = np.zeros((len(self.of), CELLS + 3), dtype=np.float32)
        if n > 0:
            v = ((b[:n] << 16 | b[1 : n + 1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(24)
            # trigrams over a border count where they begin; empty texts share a place with the next one
            own = np.searchsorted(begin, np.arange(n), "right") - 1
            counts = np.bincount(own * CELLS + v, minlength=len(self.of) * CELLS).reshape(-1, CELLS)
            self.x[:, :CELLS] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
        # of its words: equal to the one before, equal to an earlier one of the passage, and how many there are
        total = np.minimum(PASSAGE, words[self.of] - turn * PASSAGE)
        if len(x.starts):
            w = x.words()
            bag = np.repeat(np.arange(len(self.of)), np.maximum(total, 0))
            order = np.lexsort((w, bag))
            again = np.r_[False, (w[order][1:] == w[order][:-1]) & (bag[order][1:] == bag[order][:-1])]
            next_to = np.r_[False, (w[1:] == w[:-1]) & (bag[1:] == bag[:-1])]
            self.x[:, CELLS] = np.bincount(bag, weights=next_to, minlength=len(self.of)) / np.maximum(1, total)
            self.x[:, CELLS + 1] = np.bincount(bag[order], weights=again, minlength=len(self.of)) / np.maximum(1, total)
        self.x[:, CELLS + 2] = np.log1p(np.maximum(0, total)) / 4


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def forward(m: dict, bags: Bags) -> tuple:
    """(score by text, and what the gradient needs)."""
    h = np.tanh((bags.x - m["mu"]) @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * g) @ m["w"]
    top = np.maximum.reduceat(e, bags.first)
    a = np.exp(e - top[bags.of])
    a /= np.add.reduceat(a, bags.first)[bags.of]
    z = np.add.reduceat(a[:, None] * h, bags.first)
    return _sigmoid(z @ m["c"] + m["d"]), h, t, g, a, z


def _gradient(m: dict, bags: Bags, y: np.ndarray, v: np.ndarray) -> dict:
    score, h, t, g, a, z = forward(m, bags)
    ds = (score - y) * v / len(y)
    dz = ds[:, None] * m["c"]
    dzp = dz[bags.of]
    dh = a[:, None] * dzp
    da = (dzp * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, bags.first)[bags.of])
    dtg = de[:, None] * m["w"]
    dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
    dh += dt @ m["V"].T + dg @ m["U"].T
    dx = dh * (1 - h**2)
    return {"W": (bags.x - m["mu"]).T @ dx, "b": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": ((t * g) * de[:, None]).sum(axis=0), "c": z.T @ ds, "d": ds.sum()}


def fit(rows: list, epochs: int = 12, rate: float = 4e-3, batch: int = 64) -> dict:
    """Weights from (text, label, weight) rows by Adam on the weighted likelihood; deterministic."""
    rng = np.random.default_rng(11)
    m = {"mu": np.zeros(CELLS + 3), "W": rng.normal(0, 1.0, (CELLS + 3, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "w": rng.normal(0, 0.2, GATE), "c": np.zeros(HIDDEN), "d": 0.0}
    labels = {y for _, y, _ in rows}
    if len(labels) < 2:  # nothing to tell apart: the one label's probability, or one half
        m["d"] = 0.0 if not labels else (5.0 if 1 in labels else -5.0)
        return m
    order = rng.permutation(len(rows))
    groups = []
    for lo in range(0, len(rows), batch):
        own = [rows[i] for i in order[lo : lo + batch]]
        y, v = np.array([r[1] for r in own], dtype=float), np.array([r[2] for r in own])
        for x in K.texts(pa.array([r[0] for r in own], type=pa.large_string()), limit=1 << 20):
            groups.append((Bags(x), y[x.first : x.first + x.n], v[x.first : x.first + x.n]))
    mean = np.concatenate([v for *_, v in groups]).mean()
    m["mu"] = np.mean([g[0].x.mean(axis=0) for g in groups], axis=0)
    names = ("W", "b", "V", "U", "w", "c", "d")
    one, two, step = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}, 0
    for epoch in range(epochs):
        for i in rng.permutation(len(groups)):
            bags, y, v = groups[i]
            grad = _gradient(m, bags, y, v / mean)
            step += 1
            for k in names:
                g = grad[k] + 1e-5 * m[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g**2
                m[k] = m[k] - rate * (1 - epoch / (2 * epochs)) * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return m


def _score(model, schema: pa.Schema):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out: dict = {"score": [], "attention": []}
            for x in K.texts(K.column(batch, "text")):
                bags = Bags(x)
                scores, _, _, _, a, _ = forward(m, bags)
                out["score"] += scores.astype(float).tolist()
                out["attention"] += [w.tolist() for w in np.split(a.astype(float), bags.first[1:])]
            yield K.batch_of(schema, {"row": K.column(batch, "row"), **out})

    return score


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with its quality.

    Returns: row (struct: the input row), score (0 to 1), attention (weight of each passage of 64 words).

    The model is fitted on at most `per_class` ids of either label that are not held out (crc32 of the id mod 5 not
    0), one text each and `labelled.MOST_BYTES` of text together, and has a fixed size. Very long texts are scored whole; equal
    texts tie and get equal scores. Defined cases: a null text or one without words is one blank passage and gets the
    model's score for it; null ids are not held out and never train; labels that disagree or are null are not
    used; with labels of one kind only, every score is that label's; repeated rows are scored each; an empty table
    gives an empty table.
    """
    text = docs[text_col].cast("string")
    model = fit(sample(docs.select(docs[id_col].alias("doc_id"), text.alias("text")), labels, "quality", per_class))
    shared = docs.sparkSession.sparkContext.broadcast({k: np.asarray(v, dtype=np.float32) for k, v in model.items()})
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"))
    schema = wide.selectExpr("row", "0D score", "array(0D) attention").schema
    return wide.mapInArrow(_score(shared, to_arrow_schema(schema)), schema)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = F.col("row.doc_id")
    return out.select(own.alias("doc_id"), held_out(own).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
