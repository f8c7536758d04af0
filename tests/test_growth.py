"""Work that grows no faster than the input: what a task or a Python function sees, and results as before."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions import alignment as A
from sparkloom.functions import diffs as D
from sparkloom.functions import line_scores as L
from sparkloom.operators import dictionary as O
from sparkloom.operators import language_model as M
from sparkloom.operators import lexicon as X
from sparkloom.operators import matrix as T
from sparkloom.operators import pages as G
from sparkloom.operators import reports as R
from sparkloom.operators import tokenizer as K
from sparkloom.plans import comparison as PC
from sparkloom.plans import dictionary as PD
from sparkloom.plans import evaluation as PE
from sparkloom.plans import reports as PR
from sparkloom.plans import script as PS

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def before_shuffle(text: str) -> list[str]:
    """Of each scan, the lines of a plan between it and the next exchange above it."""
    out, lines = [], text.splitlines()
    for at in (i for i, line in enumerate(lines) if "FileScan" in line):
        top = next(i for i in range(at, -1, -1) if "Exchange" in lines[i] or i == 0)
        out.append("\n".join(lines[top:at]))
    return out


def test_spellings_are_converted_once_per_different_word(spark):
    """no word is converted before the words are distinct, and no pairs are made to be counted."""
    words = spark.createDataFrame([(w,) for w in ("aji", "haji", "krama", "kromo", "krama", "x", None)], "w string")
    scripts = spark.createDataFrame([(s,) for s in ("ꦲꦗꦶ", "ꦏꦿꦩ", "ꦏꦿꦩ", "ꦢꦣ", None)], "s string")
    got = {r["spelling"]: r["words"] for r in O.read_as_counts(scripts, words, "s", "w").collect()}
    assert got == dict(Counter(r["spelling"] for r in O.read_as(scripts, words, "s", "w").collect())) == {"ꦲꦗꦶ": 2, "ꦏꦿꦩ": 1}
    found = before_shuffle(plan(PD.spellings_read_as(spark, SF)))
    assert found and not any("EvalPython" in x for x in found)


def pairs(count: int, seed: int) -> list[tuple[str, str]]:
    """Random lines and readings of them: longer than a machine word too, with characters of several bytes, or unlike."""
    r, out = random.Random(seed), []
    for _ in range(count):
        ref = "".join(r.choice("abcdéx q😀") for _ in range(r.choice([0, 1, 5, 30, 63, 64, 65, 80, 129])))
        hyp = list(ref)
        for _ in range(r.randint(0, 12)):
            at = r.randint(0, len(hyp))
            hyp[at : at + r.randint(0, 1)] = r.choice(["", "a", "x", "q ", "é"])
        out.append((ref, "".join(hyp) if r.random() < 0.8 else "".join(r.choice("abx ") for _ in range(r.randint(0, 140)))))
    return out


def test_syllables_are_written_once_per_different_word(spark):
    """words are counted before Python writes them; the counts are made once and read four times."""
    lines = spark.createDataFrame([("aba ki  aba",), ("",), ("ki",)], "t string")
    got = {r["syllable"]: r["n"] for r in K.syllable_counts(K.written_words(lines, "t", lambda c: F.translate(c, "i", "ꦶ")), "script", "times").collect()}
    assert got == {"kꦶ": 2}
    found = before_shuffle(plan(PS.script_syllables(spark, SF)))
    assert found and not any("EvalPython" in x for x in found)
    assert "FileScan" not in plan(PS.reorder_patterns(spark, SF))


def test_consensus_looks_into_ties_only(spark):
    """most votes first; only ties go by inversions, then by order."""
    votes = [("ab", [1, 0], 3), ("ab", [0, 1], 1), ("abc", [2, 1, 0], 2), ("abc", [0, 2, 1], 2), ("abc", [1, 0, 2], 2)]
    got = K.consensus(spark.createDataFrame(votes, "syllable string, perm array<int>, votes int"))
    assert {r["syllable"]: r["perm"] for r in got.collect()} == {"ab": [1, 0], "abc": [0, 2, 1]}
    assert "_tied" in got._jdf.queryExecution().analyzed().toString()


def test_methods_stay_spread_and_meet_lines_where_they_are(spark):
    """no shuffle by method, which would leave a whole method to one task."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = spark.createDataFrame([("m", "1", "x"), ("m", "2", "y"), ("n", "1", "b"), ("n", "1", "a"), (None, "1", "z")], "method string, line string, text string")
        two = spark.createDataFrame([("m", "1", "w"), ("m", None, "v")], "method string, line string, text string")
        got = T.united([one, two])
        # the one shuffle by method is that of the small list of methods
        assert plan(got).count("hashpartitioning(method") == 1 and "hashpartitioning(line" in plan(got)
        assert sorted(map(tuple, got.collect())) == [("m", "1", "w"), ("n", "1", "a")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_line_distance_is_levenshtein(spark):
    """lines are measured a batch at once, long texts and nulls as before."""
    rows = [*pairs(300, 1), ("a" * 300, "ab" * 200), (None, "x"), ("x", None), ("", "")]
    df = spark.createDataFrame(rows, "x string, y string").select(A.line_distance(F.col("x"), F.col("y")).alias("got"), F.levenshtein("x", "y").cast("long").alias("want"))
    assert df.where("not (got <=> want)").count() == 0
    assert "_short_distance" in plan(PE.bootstrap_ci_row(spark, SF, 8)) and "_short_distance" in plan(PE.paired_integrity_violations(spark, SF))


def test_counters_are_those_of_the_steps(spark):
    """counted where lines are aligned, no step in a column."""
    df = spark.createDataFrame([*pairs(200, 2), ("x a", "  x a"), ("xa", "a"), ("ab", " xab"), ("", "x")], "ref string, hyp string").select("*", A.alignment(F.col("ref"), F.col("hyp")).alias("ops"))
    own, rare, tracked = (F.col("ref"), F.col("hyp")), ["q", "é"], ["a", "x"]
    was = L.rare_stats(*own, F.col("ops"), rare, tracked, "x")
    sizes = [F.size(was[c]).cast("long").alias(c) if c in ("ref", "hits", "emitted", "misread") else F.coalesce(was[c].cast("long"), F.lit(0)).alias(c) for c in L.RUN]
    both = df.select(L.run_counters(*own, rare, tracked, "x").alias("got"), F.struct(*sizes).alias("want"), L.plain_edits(*own, rare).alias("p"), L.plain_errors(F.col("ops"), rare).alias("q"), D.rare_line_counts(*own, rare).alias("r"), D.rare_line_stats(F.col("ops"), rare).alias("s"), D.occurrences(F.col("ref"), rare).alias("n"), D.occurrences(F.col("hyp"), rare).alias("m"))
    for r in both.collect():
        assert r["got"] == r["want"] and r["p"] == r["q"] and tuple(r["r"]) == tuple(r["s"]) and (r["n"], r["m"]) == (r["s"]["ref"], r["s"]["emitted"])
    looks = [("a", "b"), ("x", "a"), ("q", "é")]
    want = R.homoglyphs(df.select(F.inline("ops")), looks)
    assert Counter(map(tuple, R.homoglyphs_read(df, "ref", "hyp", looks).collect())) == Counter(map(tuple, want.collect()))
    assert not any("_ops(" in plan(f(spark, SF)) for f in (PS.rare_line_stats, PC.plain_errors, PC.rare_run, PR.homoglyph_table)) and "EvalPython" not in plan(PS.rare_reference_counts(spark, SF))


def test_chrf_batch_is_the_counting_rule(monkeypatch):
    """n-grams of a batch as sorted numbers, in parts and with more letters than fit a number."""
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
    rows = [*pairs(150, 3), (wide, wide[::-1]), ("a b\tc", "abc"), ("", "")]
    want = np.array([D.chrf_counts(r, h) for r, h in rows])
    for size in (1 << 18, 200):
        monkeypatch.setattr(D, "CHRF_CHARS", size)
        assert (D.chrf_batch(*map(list, zip(*rows))) == want).all()
    assert D.chrf_batch([], []).shape == (0, 6, 3)


def test_restored_words_meet_the_lexicon_once_per_text(spark):
    """F16: spaces and repeated words make no rows."""
    docs = spark.createDataFrame([(1, "Ete ete, x  ETE été"), (2, "nothing"), (3, ""), (4, None)], "k long, t string")
    found = X.restore(docs, "k", "t", spark.createDataFrame([("ete", "été")], "plain string, form string"))
    assert {r["k"]: r["text"] for r in found.collect()} == {1: "Été été, x  Été été", 2: "nothing"}
    assert "posexplode" not in plan(found)


def test_grams_by_one_pattern(spark):
    """F32: n-grams of characters beyond the first plane too, without an array of single characters."""
    texts = ["a😀b", "", "line\nbreak", None]
    got = M.grams(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 3)
    want = Counter(("\x02\x02" + t + "\x03")[e - k + 1 : e + 1] for t in texts if t is not None for e in range(2, len(t) + 3) for k in (1, 2, 3))
    assert {r["gram"]: r["n"] for r in got.collect()} == want
    assert "transform(" not in plan(got)


def test_glosses_go_to_python_at_two_places(spark):
    """each place has workers of its own; plain ASCII is not sent to lose its marks."""
    rows = [("kata", None, "[[káta]]: makna", 0), ("káta", None, "kata (arti lain)", 1), ("kata", "Kedu", "káta", 2)]
    found = G.glosses(spark.createDataFrame(rows, "title string, dialect string, line string, n int"))
    assert plan(found).count("EvalPython [") == 2
    assert {r["n"]: r["gloss"] for r in found.collect()} == {0: "makna", 1: "arti lain", 2: ""}
