"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from text labels.

A sentence's logit is linear in hashed words and word beginnings; a text is toxic unless none of its
sentences is: 1 - prod(1 - p). Only text labels train the weights, through the noisy-or, and the same sentence
scores then tell which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm import kernel as K
from sparkloom.llm.labelled import held_out, sample

BITS = 18
#: Bytes of word beginnings that are features, beside the whole word. They and the epochs were chosen by fold_loss() over training rows
#: alone (sf0.1, 12 settings): the fewest epochs within 1 % of the least loss.
STEMS = (4, 6)
EPOCHS = 30
PER_CLASS = 3000
BREAK = np.zeros(256, dtype=bool)
BREAK[list(b".!?")] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class Sentences:
    """Sentences of a run of texts (ended by \\n, or . ! ? and a space), as word ranges; features of the words."""

    def __init__(self, x: K.Texts, stems: tuple = STEMS):
        b = x.raw
        cut = b == 10
        if len(b) > 1:
            cut[1:] |= BREAK[b[:-1]] & (b[1:] == 0x20)
        starts = np.union1d(x.offs[:-1], np.flatnonzero(cut) + 1)
        first = np.searchsorted(x.starts, starts)
        last = np.r_[first[1:], len(x.starts)]
        some = first < last
        self.first, self.last = first[some], last[some]
        self.of = x.doc_of_word()[self.first].astype(np.int64)
        size = x.ends - x.starts
        mask = np.uint64((1 << BITS) - 1)
        feats = [(x.words() & mask).astype(np.int32)]
        for k in stems:
            f = (x.range_hash(x.starts, np.minimum(x.ends, x.starts + k), 60 + k) & mask).astype(np.int32)
            f[size <= k] = -1
            feats.append(f)
        self.feats = np.stack(feats, axis=1)

    def logits(self, m: Model) -> np.ndarray:
        w = np.append(m.weights, 0.0)[self.feats].sum(axis=1)
        return (np.add.reduceat(w, self.first) if len(self.first) else np.empty(0)) + m.bias


def _noisy_or(z: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """log prod(1 - p) by text."""
    return -np.bincount(of, weights=np.logaddexp(0.0, z), minlength=n)


def telling(groups: list, least: float = 4.0, most_always: int = 64) -> np.ndarray:
    """Features that stand in toxic texts more often than chance allows: `least` standard errors, or the first few."""
    df, n = np.zeros((2, 1 << BITS)), np.zeros(2)
    for s, y, _, texts in groups:
        n += texts - y.sum(), y.sum()
        if not len(s.first):
            continue
        of = np.repeat(s.of, s.last - s.first)
        key = (of[:, None] * np.int64(1 << BITS) + s.feats)[s.feats >= 0]
        key = np.unique(key)
        own = y[key >> BITS] > 0
        for side in (0, 1):
            df[side] += np.bincount(key[own == bool(side)] & ((1 << BITS) - 1), minlength=1 << BITS)
    share = n[1] / n.sum()
    expected = df.sum(axis=0) * share
    z = np.where(df[1] > expected, (df[1] - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9)), 0.0)
    z[df[1] < 2] = 0.0
    chosen = z >= least
    chosen[np.argsort(-z, kind="stable")[:most_always]] |= z[np.argsort(-z, kind="stable")[:most_always]] > 1.5
    return chosen


def fit(rows: list, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-4, batch: int = 64, stems: tuple = STEMS) -> Model:
    """Weights from (text, label, weight) rows, by AdaGrad on the weighted likelihood; deterministic.

    Only telling features get weights; a rare word that happens to stand in one toxic text does not.
    """
    m = Model(np.zeros(1 << BITS), -6.0)
    if not any(y for _, y, _ in rows):
        return Model(m.weights, -20.0)
    order = np.random.default_rng(3).permutation(len(rows))
    groups = []
    for lo in range(0, len(rows), batch):
        own = [rows[i] for i in order[lo : lo + batch]]
        y, v = np.array([r[1] for r in own], dtype=float), np.array([r[2] for r in own])
        for x in K.texts(pa.array([r[0] for r in own], type=pa.large_string()), K.ALNUM, True, 1 << 22):
            groups.append((Sentences(x, stems), y[x.first : x.first + x.n], v[x.first : x.first + x.n], x.n))
    chosen = telling(groups)
    for s, *_ in groups:
        s.feats = np.where(chosen[s.feats] & (s.feats >= 0), s.feats, -1)
    mean = sum(v.sum() for _, _, v, _ in groups) / sum(n for *_, n in groups)
    seen, seen_bias = np.full(1 << BITS, 1e-2), 1e-2
    for _ in range(epochs):
        for s, y, v, n in groups:
            if not len(s.first):
                continue
            z = s.logits(m)
            none = _noisy_or(z, s.of, n)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            q = np.exp(none)
            slope = np.where(y > 0, -q / np.maximum(1 - q, 1e-6), 1.0) * v / mean
            g = p * slope[s.of]
            per_word = np.repeat(g, s.last - s.first)
            flat = s.feats.ravel()
            own = flat >= 0
            grad = np.bincount(flat[own], weights=np.repeat(per_word, s.feats.shape[1])[own], minlength=1 << BITS)
            touched = np.flatnonzero(grad)
            step = grad[touched] + decay * m.weights[touched]
            seen[touched] += step**2
            m.weights[touched] -= rate * step / np.sqrt(seen[touched])
            seen_bias += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(seen_bias)
    return m


def probabilities(m: Model, texts: list[str], stems: tuple = STEMS) -> np.ndarray:
    """The noisy-or score of each text."""
    out = [1 - np.exp(_noisy_or(s.logits(m), s.of, x.n)) for x in K.texts(pa.array(texts, type=pa.large_string()), K.ALNUM, True, 1 << 22) for s in [Sentences(x, stems)]]
    return np.concatenate(out) if out else np.empty(0)


def fold_loss(rows: list, settings: dict, folds: int = 4) -> tuple[float, float]:
    """(weighted log loss, recall at 0.5) of some settings of fit() over folds of the training rows: what the constants above were chosen by.

    Rows of each fold are scored by a model of the other folds; no other row takes part.
    """
    order = np.random.default_rng(17).permutation(len(rows)) % folds
    loss, total, hit, toxic = 0.0, 0.0, 0, 0
    for f in range(folds):
        m = fit([r for r, k in zip(rows, order, strict=True) if k != f], **settings)
        own = [r for r, k in zip(rows, order, strict=True) if k == f]
        p = np.clip(probabilities(m, [r[0] for r in own], settings.get("stems", STEMS)), 1e-6, 1 - 1e-6)
        y, v = np.array([r[1] for r in own]), np.array([r[2] for r in own])
        loss -= float((v * np.where(y > 0, np.log(p), np.log(1 - p))).sum())
        total, hit, toxic = total + float(v.sum()), hit + int((p[y > 0] >= 0.5).sum()), toxic + int(y.sum())
    return loss / max(total, 1e-9), hit / max(1, toxic)


def _score(model, schema: pa.Schema, floor: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out: dict = {"score": [], "offending": []}
            for x in K.texts(K.column(batch, "text"), K.ALNUM, True):
                s = Sentences(x)
                z = s.logits(m)
                out["score"] += (-np.expm1(_noisy_or(z, s.of, x.n))).tolist()
                found: list[list[dict]] = [[] for _ in range(x.n)]
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                for i in np.flatnonzero(p >= floor):
                    lo, hi = int(x.starts[s.first[i]]), int(x.ends[s.last[i] - 1])
                    found[s.of[i]].append({"sentence": x.raw[lo:hi].tobytes().decode(), "score": float(p[i])})
                out["offending"] += found
            yield K.batch_of(schema, {"row": K.column(batch, "row"), **out})

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, floor: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with its toxicity.

    Returns: row (struct: the input row), score (0 to 1), offending (array of sentence and score, those of at least
    `floor`, in order of the text).

    The model is fitted on at most `per_class` ids of either label that are not held out (crc32 of the id mod 5 not
    0), one text each and `labelled.MOST_BYTES` of text together, and has a fixed size. Very long texts are scored whole; ties
    of features go by their number. Defined cases: a null text or one without words has no sentences and score 0; null ids
    are not held out and never train; labels that disagree or are null are not used; without toxic labels every
    score is near 0; repeated rows are scored each; an empty table gives an empty table.
    """
    text = docs[text_col].cast("string")
    model = fit(sample(docs.select(docs[id_col].alias("doc_id"), text.alias("text")), labels, "toxic", per_class))
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias))
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"))
    schema = wide.selectExpr("row", "0D score", "array(named_struct('sentence', '', 'score', 0D)) offending").schema
    return wide.mapInArrow(_score(shared, to_arrow_schema(schema), floor), schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = F.col("row.doc_id")
    return out.select(own.alias("doc_id"), held_out(own).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
