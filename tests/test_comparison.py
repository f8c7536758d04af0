"""The report of two readings against plain Python: counters, edits beside rare characters, joint intervals, degenerate cases."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import alignment as A
from sparkloom.functions import line_scores as L
from sparkloom.operators import comparison as C
from sparkloom.plans import comparison as P

KA, NA, MURDA, DIGIT, LETTER, OPENER = "ꦏ", "ꦤ", "ꦑ", "꧐", "꧆", L.OPENER
RARE = ["ꦄ", MURDA, "ꦯ", OPENER]


def lines(seed, n=150):
    rng = random.Random(seed)
    signs = [KA, NA, MURDA, LETTER, DIGIT, " ", "ꦶ"]
    out = []
    for i in range(n):
        ref = (OPENER if rng.random() < 0.3 else "") + "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
        spoil = lambda t: "".join(rng.choice([c, c, c, c, "", rng.choice(signs), c + rng.choice([*signs, OPENER])]) for c in t)
        out.append((f"l{i}", rng.choice(["p1", "p1", "p2", "p3", None, ""]), ref, spoil(ref), spoil(ref)))
    return [*out, ("n", "p2", None, "x", None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, cluster string, ref string, a string, b string").repartition(3)


def blocks_by_hand(ref, hyp, ops, rare):
    """Edits outside blocks that substitute or delete a rare reference character, insertions of rare ones aside."""
    total, block = 0, []
    for tag, i, j, *_ in [*ops, ("equal", None, None)]:
        if tag != "equal":
            block.append((tag, i, j))
            continue
        if not any(i is not None and ref[i] in rare for _, i, _ in block):
            total += sum(not (tag == "insert" and hyp[j] in rare) for tag, _, j in block)
        block = []
    return total


def test_plain_errors(spark):
    rare = [MURDA]
    cases = [(KA + MURDA + NA, KA + KA + NA), (KA + NA, KA + MURDA + NA), (KA + MURDA + NA, KA + "xy" + NA), (KA + NA, KA + "x" + NA), ("", MURDA + "x"), (MURDA, ""), (KA + MURDA + KA + NA, KA + "x" + KA + "y")]
    cases += [(r or "", a or "") for _, _, r, a, _ in lines(5, 80)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, ref string, hyp string")
    got = {r["i"]: r["n"] for r in df.select("i", L.plain_errors(A.alignment(F.col("ref"), F.col("hyp")), rare).alias("n")).collect()}
    for i, (ref, hyp) in enumerate(cases):
        assert got[i] == blocks_by_hand(ref, hyp, A.align_batch([ref], [hyp])[0], rare), (ref, hyp)
    assert [got[i] for i in range(7)] == [0, 0, 0, 1, 1, 0, 1]


def test_report_by_hand(spark):
    rows = lines(1)
    found = C.compare(frame(spark, rows), RARE, reps=0)
    clean = [(i, c or i, r or "", a or "", b or "") for i, c, r, a, b in rows]
    per = []
    for i, c, ref, *sides in clean:
        one = {"id": i, "cluster": c, "ref": ref, "rare": Counter(x for x in ref if x in RARE)}
        for s, hyp in zip("ab", sides, strict=True):
            ops = A.align_batch([ref], [hyp])[0]
            one[s] = {"edits": sum(o[0] != "equal" for o in ops), "hits": Counter(o[3] for o in ops if o[0] == "equal" and o[3] in RARE), "out": Counter(x for x in hyp if x in RARE), "first": any(o[:2] == ("equal", 0) for o in ops), "head": hyp.lstrip(" ").startswith(OPENER), "subs": Counter(o[3] + o[4] for o in ops if o[0] == "replace"), "hyp": hyp}
        per.append(one)
    got = found["counts"].first()
    starts = [p for p in per if p["ref"].startswith(OPENER)]
    assert got["lines"] == len(rows) and got["clusters"] == len({p["cluster"] for p in per}) and got["reference_chars"] == sum(len(p["ref"]) for p in per)
    assert got["lines_a_better"] == sum(p["a"]["edits"] < p["b"]["edits"] for p in per) and got["lines_tie"] == sum(p["a"]["edits"] == p["b"]["edits"] for p in per)
    assert got["openers"] == len(starts) and got["opener_only_a"] == sum(p["a"]["first"] and not p["b"]["first"] for p in starts)
    assert got["opener_both"] + got["opener_only_a"] + got["opener_only_b"] + got["opener_neither"] == len(starts)
    assert got["false_start_b"] == sum(p["b"]["head"] and not p["ref"].startswith(OPENER) for p in per)
    table = {r["ch"]: r for r in found["codepoints"].collect()}
    assert set(table) == set(RARE)
    for ch in RARE:
        ref, hit, out = sum(p["rare"][ch] for p in per), sum(p["a"]["hits"][ch] for p in per), sum(p["a"]["out"][ch] for p in per)
        r = table[ch]
        assert (r["ref"], r["hits_a"], r["hyp_a"]) == (ref, hit, out)
        assert r["recall_a"] == (pytest.approx(hit / ref) if ref else None) and r["precision_a"] == (pytest.approx(hit / out) if out else None)
    assert table[MURDA]["codepoint"] == "U+A991" and table[MURDA]["name"] == "JAVANESE LETTER KA MURDA" and table["ꦄ"]["occurs"] == "absent"
    pair = next(r for r in found["lookalikes"].collect() if r["letter"] == LETTER)
    assert pair["letter_as_digit_a"] == sum(p["a"]["subs"][LETTER + DIGIT] for p in per) and pair["digit_as_letter_b"] == sum(p["b"]["subs"][DIGIT + LETTER] for p in per)
    assert pair["false_letter_a"] == sum(p["a"]["hyp"].count(LETTER) for p in per if LETTER not in p["ref"])
    rates = {r["metric"]: r for r in found["metrics"].collect()}
    plain = [p for p in per if not p["rare"]]
    assert rates["cer"]["a"] == pytest.approx(sum(p["a"]["edits"] for p in per) / sum(len(p["ref"]) for p in per))
    assert rates["cer_without_rare"]["b"] == pytest.approx(sum(p["b"]["edits"] for p in plain) / sum(len(p["ref"]) for p in plain))
    assert rates["recall:murda"]["a"] == table[MURDA]["recall_a"] or rates["recall:murda"]["a"] == pytest.approx(table[MURDA]["recall_a"])
    assert rates["recall:opener"]["a"] == pytest.approx(sum(p["a"]["first"] for p in starts) / len(starts))
    assert C.reconciled(found["metrics"], {"cer": F.lit(rates["cer"]["a"])}).collect() == []
    assert len(C.reconciled(found["metrics"], {"cer": F.lit(0.5)}).collect()) == 1
    found["scored"].unpersist()


@pytest.mark.parametrize("kind", ["lines", "clusters"])
def test_intervals_by_brute_force(spark, kind):
    """The same weights in plain loops, and intervals close to those of multinomial resampling."""
    rows, reps = [(i, c or i, r or "", a or "", b or "") for i, c, r, a, b in lines(3, 90)], 400
    scored = C.scored(frame(spark, rows), RARE, {"rare": RARE})
    got = {r["metric"]: r for r in C.metrics(scored, ["rare"], reps, seed=4).collect()}
    own = scored.select(F.xxhash64("id").alias("l"), F.xxhash64(F.lit(1), "cluster").alias("c"), "edits_a", "edits_b", "chars").collect()
    table = C.poisson_table()
    diffs = []
    for rep in range(reps):
        sums = np.zeros(3)
        for r in own:
            h = (r["l" if kind == "lines" else "c"] % 2**64) ^ (((rep // 4 + 1) * 0x9E3779B97F4A7C15 + 4) * 0xD1B54A32D192ED03 % 2**64)
            h ^= h >> 30
            h = h * 0xBF58476D1CE4E5B9 % 2**64
            h ^= h >> 27
            h = h * 0x94D049BB133111EB % 2**64
            h ^= h >> 31
            sums += table[(h >> (16 * (rep % 4))) & 0xFFFF] * np.array([r["edits_a"], r["edits_b"], r["chars"]])
        if sums[2]:
            diffs.append(sums[0] / sums[2] - sums[1] / sums[2])
    r = got["cer"]
    assert r[f"{kind}_valid"] == len(diffs)
    assert (r[f"{kind}_low"], r[f"{kind}_high"]) == tuple(pytest.approx(x) for x in np.percentile(diffs, [2.5, 97.5]))
    assert r[f"{kind}_se"] == pytest.approx(np.std(diffs, ddof=1))
    if kind == "lines":
        v = np.array([(x["edits_a"], x["edits_b"], x["chars"]) for x in own], dtype=float)
        w = np.random.default_rng(0).multinomial(len(v), np.full(len(v), 1 / len(v)), size=4000) @ v
        lo, hi = np.percentile(w[:, 0] / w[:, 2] - w[:, 1] / w[:, 2], [2.5, 97.5])
        assert abs(lo - r["lines_low"]) < 0.35 * (hi - lo) and abs(hi - r["lines_high"]) < 0.35 * (hi - lo)


def test_degenerate_reports(spark):
    none = C.compare(frame(spark, []), RARE, reps=20)
    assert none["counts"].first()["lines"] == 0 and none["metrics"].collect() == []
    one = C.compare(frame(spark, [("x", None, KA + NA, KA + NA, KA)]), RARE, reps=20)
    rates = {r["metric"]: r for r in one["metrics"].collect()}
    assert rates["recall:rare"]["a"] is None and rates["recall:rare"]["lines_low"] is None and rates["recall:rare"]["lines_valid"] == 0
    assert rates["cer"]["diff"] == -0.5 and one["counts"].first()["exact_a"] == 1.0


def test_rare_run(spark):
    rows = [(OPENER + KA, OPENER + KA), (OPENER + KA, KA), (KA, OPENER + KA), (KA + MURDA + NA, KA + KA + NA), (KA + NA, KA + MURDA + NA), (KA + OPENER, OPENER + "")]
    df = spark.createDataFrame(rows, "ref string, hyp string")
    got = C.rare_run(df, RARE).first()
    assert (got["openers"], got["opener_reads"], got["false_openers"]) == (2, 1, 2)
    # the last line's opener stands in the middle and is read at the head: a hit and an output, so precision stays within 1
    assert (got["ref"], got["hits"], got["emitted"]) == (2, 1, 2)
    assert (got["plain_chars"], got["plain_edits"]) == (1 + 2 + 2 + 1, 0 + 0 + 0 + 1)


def spoiled(seed, n=400):
    """Pairs that align place by place, lose, gain or keep spaces and marks, and others."""
    rng, out = random.Random(seed), [("", ""), ("a", ""), ("", " a"), ("x" * 300, "x" * 290 + " y")]
    for i in range(n):
        signs = rng.choice(["ab ", "abc de", "aẹ́ x", KA + NA + "꧀ ꦶ"])
        ref = "".join(rng.choice(signs) for _ in range(rng.randrange(14)))
        spoil = [lambda c: c, lambda c: rng.choice([c, c, ""]), lambda c: rng.choice([c, c, c + rng.choice(signs)]), lambda c: rng.choice([c, c, "x", "y"]), lambda c: rng.choice([c, c, "", rng.choice(signs), c + rng.choice(signs)])][i % 5]
        out.append((ref, "".join(map(spoil, ref))))
    return out


def test_outcomes_are_those_of_the_whole_alignment():
    refs, hyps = map(list, zip(*spoiled(7)))
    edits, hit, right = A.outcomes(pa.array(refs), pa.array(hyps))
    s = A.Steps(refs, hyps)
    assert edits.tolist() == s.edits().tolist() and hit.tolist() == s.same[s.go < 2].tolist() and right.tolist() == s.same[s.go != 1].tolist()
    bare = A.bare_distances(pa.array(refs), pa.array(hyps), edits, right)
    assert bare.tolist() == A.distances(refs, [unicodedata.normalize("NFC", h.replace(" ", "")) for h in hyps]).tolist()


def test_plain_pairs_need_no_alignment(monkeypatch):
    """Substitutions place by place, and characters lost or put in, are counted without a path, and without spaces too."""
    monkeypatch.setattr(A, "Steps", None)
    refs, hyps = pa.array(["one two", "one two", "one two", "", "ab ba"]), pa.array(["ane twa", "ne to", "onee  two", "x", "ab ba"])
    edits, hit, right = A.outcomes(refs, hyps)
    assert edits.tolist() == [2, 2, 2, 1, 0] and hit[:7].tolist() == [False, True, True, True, True, True, False]
    monkeypatch.setattr(A, "short_distances", None)
    assert A.bare_distances(refs.take(pa.array([0, 1, 4])), hyps.take(pa.array([0, 1, 4])), edits[[0, 1, 4]], right[np.r_[0:12, 22:27]]).tolist() == [3, 3, 1]


@pytest.mark.parametrize("factor", [1, 0.5, 1e6])
def test_resamples_of_many_units(factor):
    """Units over several blocks, with columns that few of them have, add up as the whole matrix of weights does."""
    rng = np.random.default_rng(2)
    keys, values = rng.integers(-(2**63), 2**63 - 1, 700), rng.integers(0, 9, (700, 6)) * factor
    values[:, 2:] *= rng.random((700, 4)) < 0.1
    values[5:9] = 0
    sums = np.zeros((6, 2048))
    C.add_resamples(sums, keys, values, C.Draws(2048, 9))
    assert np.allclose(sums.T, C.weights(keys, 0, 2048, 9).astype(float) @ values, rtol=1e-12)
    h = (np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(9)) * np.uint64(0xD1B54A32D192ED03) ^ keys[:1].view(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    assert (C.weights(keys[:1], 0, 2048, 9)[:, 0] == C.poisson_table()[h.view(np.uint16)]).all()


def test_query_has_all_nine_ratios(spark):
    """Rates of errors, of openers, and of rare characters and the murda among them, as in compare()."""
    d = "/root/testdata/sf0.001"
    got = {r["metric"]: r for r in P.compare_metrics(spark, d).collect()}
    assert set(got) == {"cer", "cer_hyp_no_space", "cer_without_rare", "recall:opener", "false_start", *[f"{k}:{g}" for k in ("recall", "precision") for g in ("rare", "murda")]}
    each = {r["ch"]: r for r in P.compare_codepoints(spark, d).collect()}
    for s in "ab":
        n = {k: sum(each[c][k] for c in P.GROUPS["murda"]) for k in ("ref", f"hits_{s}", f"hyp_{s}")}
        assert n["ref"] > 0 and got["recall:murda"][s] == pytest.approx(n[f"hits_{s}"] / n["ref"]) and got["precision:murda"][s] == pytest.approx(n[f"hits_{s}"] / n[f"hyp_{s}"])
    assert got["recall:murda"]["lines_valid"] == 10_000
