"""License scans by diagonal voting.

Every rolling window of K words of a text is hashed and joined to the places of equal windows in the licence
templates. A pair of places votes for its diagonal, text place less template place: a quoted template puts its
votes on one diagonal, small edits shift them to neighbouring ones. Votes are summed per diagonal, neighbouring
diagonals merge into one candidate span, and a span counts when the windows that voted cover enough of the
template. Beside the method, fixed phrases give base labels, which always stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import kernel as K
from sparkloom.llm.storage import materialize

NULL_ID = -(2**63)
K_WORDS = 3
SLACK = 4
COVER = 0.6
# fixed values: the phrases of the base rule and their labels
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# fixed values: short notices in customary wording, by label
TEMPLATES = (
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("mit-release", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4", "licensed under cc by nc 4 0"),
    ("cc-by-4", "licensed under cc by 4 0"),
    ("cc-by-sa-4", "licensed under cc by sa 4 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("rights-reserved", "all rights reserved no part of this publication may be reproduced"),
)
_SCAN = pa.schema([("id", pa.int64()), ("rk", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string()))])
SCAN_SCHEMA = "id long, rk long, n_words long, n_base long, first_word long, last_word long, base array<string>"
_GRAMS = pa.schema([("id", pa.int64()), ("rk", pa.int64()), ("grams", pa.list_(pa.int64()))])
#: Template windows that are broadcast at most (32 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 200_000


def _hashes(text: str) -> tuple[np.ndarray, np.ndarray, K.Texts]:
    x = next(K.texts(pa.array([text]), K.ALNUM, True))
    w = x.words()
    return w, K.grams(w, x.doc_of_word(), K_WORDS, 1)[0].view(np.int64), x


def template_grams(templates=TEMPLATES) -> list[tuple[int, str, int, int]]:
    """(hash, label, place, number of windows) of each window of K_WORDS words of each template."""
    return [(int(h), label, i, len(g)) for label, text in templates for g in [_hashes(text)[1]] for i, h in enumerate(g)]


def templates_of(folder: str) -> list[tuple[str, str]]:
    """(label, text) of each file of a folder of licence texts, read on the driver: the label is the file's name in lower case."""
    return [(p.stem.lower(), p.read_text(errors="replace")) for p in sorted(Path(folder).iterdir()) if p.is_file()]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all rolling windows of each text, in order."""
    for batch in batches:
        ids, keys = K.column(batch, "id"), K.column(batch, "rk")
        for x in K.texts(K.column(batch, "text"), K.ALNUM, True):
            docs = x.doc_of_word()
            g, at = K.grams(x.words(), docs, K_WORDS, 1)
            bounds = np.searchsorted(docs[at], np.arange(x.n + 1)).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(bounds), pa.array(g.view(np.int64)))
            yield K.batch_of(_GRAMS, {"id": ids.slice(x.first, x.n), "rk": keys.slice(x.first, x.n), "grams": grams})


def _scan(phrases: tuple):
    """Base figures of each text."""
    base = [(_hashes(p)[0], label) for p, label in phrases]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict = {f.name: [] for f in _SCAN}
            for x in K.texts(K.column(batch, "text"), K.ALNUM, True):
                docs, words = x.doc_of_word(), x.words()
                found: list[list[tuple[int, str]]] = [[] for _ in range(x.n)]
                for hs, label in base:
                    k = len(hs)
                    at = np.flatnonzero(words[: max(0, len(words) - k + 1)] == hs[0])
                    for j in range(1, k):
                        at = at[words[at + j] == hs[j]]
                    for i in at[docs[at] == docs[at + k - 1]]:
                        found[docs[i]].append((int(i - x.bounds[docs[i]]), label))
                parts["n_words"] += np.diff(x.bounds).tolist()
                parts["n_base"] += [len(f) for f in found]
                parts["first_word"] += [min(f)[0] if f else None for f in found]
                parts["last_word"] += [max(f)[0] if f else None for f in found]
                parts["base"] += [sorted({label for _, label in f}) for f in found]
            yield K.batch_of(_SCAN, parts | {"id": K.column(batch, "id"), "rk": K.column(batch, "rk")})

    return scan


_SPAN = pa.schema([("id", pa.int64()), ("rk", pa.int64()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("votes", pa.int64()), ("cover", pa.float64())])
SPAN_SCHEMA = "id long, rk long, label string, first_word long, last_word long, votes long, cover double"


def chains(at: np.ndarray, place: np.ndarray, size: int, slack: int, cover: float) -> list[tuple[int, int, int]]:
    """(first, last, length) of the longest chains of pairs of places, best first, that cover enough of a template and share no text.

    In a chain both places rise and neighbours' diagonals differ by `slack` at most; a pair can only follow pairs at most
    size + slack text places before it, so work is linear in the text. Of chains that end at one pair the earlier start wins.
    """
    order = np.lexsort((place, at))
    at, place = at[order].tolist(), place[order].tolist()
    best, back, lo = [1] * len(at), [-1] * len(at), 0
    for j in range(len(at)):
        while at[j] - at[lo] > size + slack:
            lo += 1
        for i in range(lo, j):
            if at[i] < at[j] and place[i] < place[j] and abs((at[j] - place[j]) - (at[i] - place[i])) <= slack and best[i] + 1 > best[j]:
                best[j], back[j] = best[i] + 1, i
    found: list[tuple[int, int, int]] = []
    for j in sorted(range(len(at)), key=lambda j: (-best[j], at[j], place[j])):
        if best[j] < cover * size:
            break
        i = j
        while back[i] >= 0:
            i = back[i]
        if all(at[j] < f or at[i] > t for f, t, _ in found):
            found.append((at[i], at[j], best[j]))
    return found


def _verified(slack: int, cover: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.to_pylist():
                diagonals = np.repeat([h["diagonal"] for h in own["hits"]], [len(h["ats"]) for h in own["hits"]])
                at = np.concatenate([h["ats"] for h in own["hits"]]).astype(np.int64)
                for first, last, n in chains(at, at - diagonals, own["size"], slack, cover):
                    rows.append((own["id"], own["rk"], own["label"], first, last + K_WORDS - 1, n, n / own["size"]))
            yield K.batch_of(_SPAN, {f.name: [r[i] for r in rows] for i, f in enumerate(_SPAN)})

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, slack: int = SLACK, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(figures, spans).

    figures: doc_id, n_words, n_base, first_word, last_word, base (array), labels (array), score per input row.
    spans: doc_id, rk, label, first_word, last_word, votes, cover per verified span; rk is the hash of the row's text.
    score is the best cover of any span, 1 if a base phrase stands in the text, else 0.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. Diagonals at most `slack`
    apart merge; a span needs `cover` of its template's windows, in order. Defined cases: a null text is empty and has no
    labels; null ids stay null; rows that repeat an id are figured each; an empty table gives an empty table; other
    columns are not read; very long texts are scanned whole; of equal covers all labels stand. The join of all rolling windows with
    the template places decides alone what votes. `templates` are (label, text) pairs of any length, as templates_of()
    reads them from a folder; their windows are broadcast up to BROADCAST_WINDOWS of them.
    """
    spark = docs.sparkSession
    text = docs[text_col].cast("string")
    base = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("rk"), text.alias("text"))
    rows = template_grams(templates)
    places = spark.createDataFrame(rows, "gram long, label string, place long, size long")
    places = F.broadcast(places) if len(rows) <= BROADCAST_WINDOWS else places.hint("merge")
    seen = materialize(base.mapInArrow(_scan(tuple(phrases)), SCAN_SCHEMA), "scan")
    grams = base.mapInArrow(_windows, "id long, rk long, grams array<long>").select("id", "rk", F.posexplode("grams").alias("at", "gram"))
    # rows that repeat an id and its text vote once: each pair of places counts once
    votes = grams.join(places, "gram").groupBy("id", "rk", "label", "size", (F.col("at") - F.col("place")).cast("long").alias("diagonal"))
    votes = votes.agg(F.min("at").cast("long").alias("first"), F.max("at").cast("long").alias("last"), F.collect_set(F.col("at").cast("long")).alias("ats"))
    line = Window.partitionBy("id", "rk", "label").orderBy("diagonal", "first")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > slack, F.lit(True))
    bands = votes.withColumn("band", F.sum(fresh.cast("int")).over(line))
    # of a band, the pairs of places; those whose places could cover enough in any order are chained
    pairs = bands.groupBy("id", "rk", "label", "size", "band").agg(F.collect_list(F.struct("diagonal", "ats")).alias("hits"))
    places = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(h["ats"], lambda a: a - h["diagonal"])))))
    spans = pairs.where(places >= cover * F.col("size")).select("id", "rk", "label", "size", "hits").mapInArrow(_verified(slack, cover), SPAN_SCHEMA)
    named = spans.groupBy("id", "rk").agg(F.collect_set("label").alias("own"), F.max("cover").alias("best"))
    out = seen.join(named, ["id", "rk"], "left")
    back = F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", none))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(back, "n_words", "n_base", "first_word", "last_word", "base", labels.alias("labels"), score.alias("score")), spans.select(back, "rk", "label", "first_word", "last_word", "votes", "cover")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence labels of all documents, by phrase and by template."""
    out, _ = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE_SQL: dict[str, str] = {}
