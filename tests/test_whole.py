"""Queries on whole texts, by brute force on small tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.alignment import align_batch
from sparkloom.plans.catalogue import QUERIES
from sparkloom.plans.evaluation import bootstrap_ci_row
from sparkloom.plans.fixture import lines, readings

LONG = "Élan vital à Köln, " * 12 + "x" * 200 + " end"
TEXTS = [LONG, "short\n\n  two  spaces \nniño", "", None, "plain ASCII line of more than twenty\r\u2028" + "y " * 90]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "en" if i % 2 else "fr", f"site_{i}") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("abcdefghijkl ÉéxyzßK",)], "text string").write.parquet(f"{d}/benchmark.parquet")
    turns = [(0, 0, "Köln a short turn"), (0, 1, ""), (1, 0, "ŋ never seen")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def test_whole_lines_keep_every_character(spark, small):
    rows = sorted(lines(spark, small).collect(), key=lambda r: (r["page"], r["line_no"]))
    assert all(1 <= len(r["ref"]) <= 80 for r in rows)
    assert len({(r["page"], r["line_no"]) for r in rows}) == len(rows)
    for i, text in enumerate(TEXTS):
        own = [r["ref"] for r in rows if r["page"] == i]
        assert "".join(own).replace(" ", "") == (text or "").replace("\n", "").replace(" ", "")
        assert [x for x in (text or "").split("\n") if 0 < len(x) <= 80] == [x for x in own if x in (text or "").split("\n")]


def test_eval_summary_counts_whole_texts(spark, small):
    rows = readings(spark, small).collect()
    got = {r["lang"]: r for r in QUERIES["eval_summary_by_lang"](spark, small).collect()}
    for lang in ("en", "fr", None):
        own = [r for r in rows if lang in (None, r["lang"])]
        assert got[lang]["lines"] == len(own)
        assert got[lang]["cer"] == round(sum(levenshtein(r["ref"], r["a"]) for r in own) / sum(len(r["ref"]) for r in own), 9)


def test_length_histogram_counts_every_line(spark, small):
    got = QUERIES["corpus_length_histogram"](spark, small).collect()
    assert sum(r["lines"] for r in got) == lines(spark, small).count()


def test_language_model_of_all_documents(spark, small):
    padded = ["\x02" * 4 + t + "\x03" for t in TEXTS if t is not None]
    grams = Counter((k, s[e - k : e]) for s in padded for e in range(5, len(s) + 1) for k in range(1, 6))
    got = {(r["k"], bytes.fromhex(r["gram"]).decode()): r["n"] for r in QUERIES["ngram_counts"](spark, small).collect()}
    assert got == grams
    total, types = Counter(), Counter()
    for (k, g), n in grams.items():
        total[g[:-1]] += n * (k > 1)
        types[g[:-1]] += k > 1
    got = {bytes.fromhex(r["ctx"]).decode(): (r["total"], r["types"]) for r in QUERIES["ngram_contexts"](spark, small).collect()}
    assert got == {c: (total[c], types[c]) for c in total if total[c]}
    every, v = sum(n for (k, _), n in grams.items() if k == 1), len(set("".join(t or "" for t in TEXTS)))
    for r in QUERIES["lm_witten_bell_scores"](spark, small).collect():
        text = {"0-0": "Köln a short turn", "0-1": "", "1-0": "ŋ never seen"}[r["key"]]
        s, logp = "\x02" * 4 + text + "\x03", 0.0
        for e in range(5, len(s) + 1):
            p = (grams[1, s[e - 1]] + 1) / (every + v + 1)
            for k in range(2, 6):
                if c := s[e - k : e - 1]:
                    p = (grams[k, s[e - k : e]] + types[c] * p) / (total[c] + types[c]) if total[c] else p
            logp += math.log(p)
        assert r["chars"] == len(text) + 1 and abs(r["logp"] - logp) < 1e-5


def test_labels_are_checked_past_60_characters(spark, tmp_path):
    rows = [(3, "a" * 60 + "é"), (6, "b" * 70 + "ꦴ"), (9, "fine " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["problem"]: r["n"] for r in QUERIES["label_violations"](spark, str(tmp_path)).collect()}
    assert got == {"unknown characters": 1, "stray mark": 1}


def test_names_of_all_languages_and_letters(spark, tmp_path):
    rows = [(1, "Kévin sieht Öbb", "de"), (2, "kévin Kurt zu", "fr"), (3, "Bob", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["name"]: r["ordinary"] for r in QUERIES["name_entries"](spark, str(tmp_path)).collect()}
    assert got == {"kévin": True, "öbb": False, "bob": False}


def test_homoglyphs_of_all_readings(spark, small):
    own = readings(spark, small).collect()
    steps = [s for r in own for s in align_batch([r["ref"]], [r["a"]])[0]]
    got = {(r["ref"], r["hyp"]): r["n"] for r in QUERIES["homoglyph_table"](spark, small).collect()}
    assert got == {(x, y): sum(s[3] == x and s[4] == y for s in steps) for p in (("a", "b"), ("e", "c"), ("x", "y")) for x, y in (p, p[::-1])}


def test_cluster_bootstrap_has_10000_resamples(spark, small):
    assert QUERIES["bootstrap_ci_cluster"](spark, small).first()["valid"] == 10_000
    assert QUERIES["bootstrap_ci_stepwise"](spark, small).first()["low"] is not None


def test_row_bootstrap_by_brute_force(spark, small):
    own = readings(spark, small).withColumn("key", F.xxhash64(F.concat_ws("-", "page", "line_no"))).collect()
    cdf = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    mask, diffs = 2**64 - 1, []
    rows = [(r["key"] & mask, levenshtein(r["ref"], r["a"]), levenshtein(r["ref"], r["b"]), len(r["ref"])) for r in own]
    for four in range(50):
        sums = [[0, 0, 0] for _ in range(4)]
        for key, x, y, n in rows:
            h = key ^ ((four + 1) * 0x9E3779B97F4A7C15 & mask) * 0xD1B54A32D192ED03 & mask
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
            h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
            h ^= h >> 31
            for k in range(4):
                u = ((h >> 16 * k & 0xFFFF) + 0.5) / 65536
                w = sum(u > c for c in cdf)
                sums[k] = [s + w * v for s, v in zip(sums[k], (x, y, n), strict=True)]
        diffs += [(x - y) / n for x, y, n in sums if n]
    got = bootstrap_ci_row(spark, small, 200).first()
    low, high = np.quantile(diffs, [0.025, 0.975])
    assert got["valid"] == len(diffs) and abs(got["low"] - low) < 1e-8 and abs(got["high"] - high) < 1e-8
    assert QUERIES["bootstrap_ci_row"](spark, small).first()["valid"] == 10_000


def test_alignment_counters_by_brute_force(spark, small):
    own = readings(spark, small).collect()
    assert all(sum(t != "equal" for t, *_ in s) == levenshtein(r["ref"], r["a"]) for r, s in zip(own, align_batch([r["ref"] for r in own], [r["a"] for r in own]), strict=True))
    steps = [(r["lang"], *s) for r, ss in zip(own, align_batch([r["ref"] for r in own], [r["a"] for r in own]), strict=True) for s in ss]
    bare = [s for ss in align_batch([r["ref"].replace(" ", "") for r in own], [r["a"].replace(" ", "") for r in own]) for s in ss]
    name = {"replace": "sub", "delete": "del", "insert": "ins"}
    got = {(r["kind"], r["ref"], r["hyp"]): r["n"] for r in QUERIES["confusion_chars"](spark, small).collect()}
    assert got == Counter((name[t], r or "", h or "") for t, _, _, r, h in bare if t != "equal")
    ref, hit, out = (Counter() for _ in range(3))
    for _, tag, _, _, r, h in steps:
        ref[r] += 1
        out[h] += 1
        hit[r] += tag == "equal"
    got = {r["ch"]: (r["ref"], r["hits"], r["emitted"], r["recall"], r["precision"]) for r in QUERIES["align_recall_precision"](spark, small).collect()}
    part = lambda a, b: round(a / b, 9) if b else None
    assert got == {c: (ref[c], hit[c], out[c], part(hit[c], ref[c]), part(hit[c], out[c])) for c in {*ref, *out} - {None}}
    wrong = Counter((r, h or "") for _, tag, _, _, r, h in steps if r is not None and tag != "equal")
    best = {c: sorted(((-n, h) for (x, h), n in wrong.items() if x == c))[:3] for c, _ in wrong}
    got = {(r["ch"], r["place"]): (-r["n"], r["read_as"]) for r in QUERIES["top_misreads"](spark, small).collect()}
    assert got == {(c, i + 1): x for c, xs in best.items() for i, x in enumerate(xs)}
    for r in QUERIES["rare_line_stats"](spark, small).collect():
        mine = [s for s in steps if s[0] == r["lang"]]
        assert r["ref"] == sum(s[4] in ("k", "v", "b") for s in mine) and r["emitted"] == sum(s[5] in ("k", "v", "b") for s in mine)
        assert r["hits"] == sum(s[4] in ("k", "v", "b") and s[1] == "equal" for s in mine) and r["touched"] == r["ref"] - r["hits"]
