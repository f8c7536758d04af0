"""Spelling forms, inserted marks, gates, runs and image spans against plain Python and hand cases."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import spans as N
from sparkloom.functions.alignment import align_batch, column_points
from sparkloom.operators import forms as O
from sparkloom.operators import gates as G

SIGNS = ["ꦏ", "ꦚ", "꧀", "ꦕ", "ꦗ", "ꦉ", "ꦊ", "ꦽ", "꧇", "ꦶ", "ꦸ", " "]


def found_in(text):
    return {i: O.SINGLE.get(c) or "nya" for i, c in enumerate(text) if c in O.SINGLE or (c == "ꦚ" and text[i + 1 : i + 3] in O.FOLLOWERS)}


def readings(seed, n=120):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(SIGNS + ["ꦚ꧀ꦕ"]) for _ in range(rng.randrange(9)))
    spoil = lambda t: "".join(rng.choice([c, c, c, "", c + rng.choice(SIGNS)]) for c in t)
    return [(i, f"p{i % 5}", t, spoil(t), spoil(t)) for i, t in enumerate(text() for _ in range(n))]


def test_forms_by_hand(spark):
    rows = readings(1)
    df = spark.createDataFrame([*rows, (999, None, None, "ꦉ", None)], "id int, cluster string, ref string, a string, b string")
    total = {k: Counter() for k in ("ref", "hit", "out", "right")}
    plain_edits = plain_chars = 0
    for _, _, ref, hyp, _ in [*rows, (0, 0, "", "ꦉ", "")]:
        ops = align_batch([ref], [hyp])[0]
        i_ok, j_ok = {o[1] for o in ops if o[0] == "equal"}, {o[2] for o in ops if o[0] == "equal"}
        own, put = found_in(ref), found_in(hyp)
        total["ref"].update(own.values())
        total["hit"].update(f for i, f in own.items() if i in i_ok)
        total["out"].update(put.values())
        total["right"].update(f for j, f in put.items() if j in j_ok)
        if not own:
            plain_edits, plain_chars = plain_edits + sum(o[0] != "equal" for o in ops), plain_chars + len(ref)
    r = O.run_report(df, "ref", "a").first()
    assert (r["in_reference"], r["read"], r["emitted"], r["emitted_right"]) == tuple(sum(total[k].values()) for k in ("ref", "hit", "out", "right"))
    assert r["cer_without_forms"] == pytest.approx(plain_edits / plain_chars) and r["recall"] == pytest.approx(r["read"] / r["in_reference"])
    table = {x["form"]: x for x in O.by_form(df, "ref", "a").collect()}
    assert {f: (table[f]["in_reference"], table[f]["read"], table[f]["emitted"], table[f]["emitted_right"]) for f in O.FORMS} == {f: tuple(total[k][f] for k in ("ref", "hit", "out", "right")) for f in O.FORMS}
    both = {x["metric"]: x for x in O.compared(df, 40).collect()}
    assert both["recall"]["a"] == pytest.approx(r["read"] / r["in_reference"]) and both["recall"]["lines_low"] <= both["recall"]["diff"] <= both["recall"]["lines_high"]
    none = O.run_report(df.where("false"), "ref", "a").first()
    assert none["recall"] is None and none["in_reference"] == 0


def test_forms_in_arrays():
    """Forms of lines in a row are those of each line; none reaches over a line's end."""
    texts = [r[2] for r in readings(4, 200)] + ["ꦚ", "꧀ꦕ", "", "ꦚ꧀", "ꦕ", "ꦚ꧀ꦗ"]
    places, lines = O._formed(*column_points(pa.array(texts)))
    starts = [sum(map(len, texts[:k])) for k in range(len(texts))]
    assert [(int(k), int(p) - starts[k]) for p, k in zip(places, lines, strict=True)] == [(k, i) for k, t in enumerate(texts) for i in sorted(found_in(t))]


def test_compared_by_hand(spark):
    rows = readings(2)
    df = spark.createDataFrame([*rows, (999, None, None, "ꦉ", None)], "id int, cluster string, ref string, a string, b string")
    got = {x["metric"]: x for x in O.compared(df, 8).collect()}
    for hyp, side in (("a", "a"), ("b", "b")):
        r = O.run_report(df, "ref", hyp).first()
        assert {m: got[m][side] and round(got[m][side], 9) for m in got} == {m: r[m] for m in ("recall", "precision", "cer", "cer_without_forms")}


def test_inserted_marks(spark):
    df = spark.createDataFrame([("x", "ꦏ", "ꦏꦶꦸ"), ("x", "ꦏꦶ", "ꦏꦷ"), ("y", "ꦏꦶ", "ꦏ"), ("y", None, "ꦶ")], "c string, ref string, hyp string")
    assert sorted(map(tuple, O.inserted_marks(df, ["c"], "ref", "hyp").collect())) == [("x", 2, 1, 1), ("y", 2, 1, 0)]


def test_gate_rules(spark):
    good = ("G1", "r", "G1", "out/checkpoints/r/last.pt", "test", "none", None, {"semua": (9990, 0), "javatext.ttf": (9990, 10)})
    real = ("G3", "r", "G3", "out/checkpoints/r/last.pt", None, None, 0.0, {"semua": (745, 0)})
    put = lambda row, i, v: (*row[:i], v, *row[i + 1 :])
    cases = [good, put(put(put(good, 0, "G2"), 2, "G2"), 5, "heavy"), real, put(good, 2, "G2"), put(good, 3, "out/checkpoints/q/last.pt"), put(real, 6, 0.1), put(real, 7, {"semua": (700, 0)}), put(good, 4, "val"), put(good, 5, "heavy"), put(good, 7, {"semua": (10000, 0), "other.ttf": (10000, 0)}), put(good, 7, {"semua": (10000, 0), "javatext.ttf": (10000, 1)}), put(good, 2, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, code string, run string, goal string, checkpoint string, split string, augment string, pad_ratio double, results map<string, struct<lines: int, rejected: int>>")
    got = [r["problem"].split(" ")[0] for r in df.coalesce(1).transform(lambda d: G.gate_problems(d.orderBy("i"), 745)).collect()]
    assert got == ["", "", "", "goal", "checkpoint", "padding", "700", "split", "split", "fonts", "10001", "goal"]


def test_run_rules(spark):
    names = ["key", "run", "track", "standard", "slant", "fixes", "neighbor", "rare", "filtered"]
    specs = spark.createDataFrame([("a", "ra", True, None, False, True, None, True, True), ("b", "rb", False, False, True, False, True, False, False), ("c", "rc", *[None] * 7), ("d", "rd", True, True, True, False, None, True, False)], "key string, run string, " + ", ".join(f"{n} boolean" for n in names[2:]))
    columns = "key string, name string, step int, steps int, track_prob double, track_max double, standard_prob double, slant_prob double, slant_max double, font_fixes boolean, neighbor_prob double, rare_insert_prob double, rare_opener_prob double, rare_max_similarity double, rare_attach boolean"
    runs = spark.createDataFrame([("a", "ra", 9, 9, 0.5, 0.3, None, 0.0, None, True, None, 0.1, 0.0, 0.9, True), ("b", "rx", 5, 9, 0.1, 0.0, 0.2, 0.4, 0.0, None, 0.0, 0.0, 0.3, 0.0, None), ("d", "rd", 9, 9, 0.5, 0.0, 0.1, 0.2, 0.3, True, None, 0.0, None, 0.5, None)], columns)
    got = {}
    for r in G.run_problems(specs, runs).collect():
        got.setdefault(r["key"], set()).add(r["problem"])
    assert got == {
        "b": {"record of another run", "run not finished", "track not declared, but on", "standard not declared, but on", "slant declared, but off", "neighbor declared, but off", "rare not declared, but on"},
        "c": {"no record"},
        "d": {"track declared, but off", "font fixes differ from the declaration", "rare declared, but off", "filtered not declared, but on"},
    }


def test_spans_names_and_catalogue(spark):
    df = spark.createDataFrame([([(0, 1), (2, 3), (5, 8)], [2, 1], 200, 40), ([(0, 1)], [2], 200, 40)], "f array<struct<first: int, last: int>>, s array<int>, w int, h int")
    got = [r[0] for r in df.select(N.syllable_spans(F.col("f"), F.col("s"), F.col("w"), F.col("h"))).collect()]
    assert got == [[[0.0, round(4 * 4 / 480, 4)], [round(5 * 4 / 480, 4), round(9 * 4 / 480, 4)]], None]
    padded = df.limit(1).select(N.syllable_spans(F.col("f"), F.col("s"), F.col("w"), F.col("h"), 0.5)).first()[0]
    assert padded[0][0] == 0.0 and all(0 <= x <= 1 for s in padded for x in s)
    one = spark.createDataFrame([("L A9BA A9C0",)], "k string").select(N.readable_pattern("k")).first()[0]
    assert one == "L taling pangkon"
    rows = spark.createDataFrame([("ꦏꦏꦶ꧐a",), (None,)], "t string")
    table = {r["ch"]: r for r in N.catalogue(rows, "t").collect()}
    assert (table["ꦏ"]["n"], table["ꦏ"]["kind"], table["ꦶ"]["kind"], table["꧐"]["kind"], table["ꦑ"]["n"]) == (2, "letter", "mark", "digit", 0) and table["ꦏ"]["code"] == "U+A98F"
    configs = spark.createDataFrame([("crnn:fase7 · 10 font · x",), ("crnn:fase8 · none",), ("other · 3 font",)], "c string")
    assert [tuple(r) for r in N.recorded_fonts(configs, "c").collect()] == [("fase7", 10)]
    widths = spark.createDataFrame([(10, 60), (10, 59)], "n int, w int")
    assert [r[0] for r in widths.select(N.is_trainable(F.col("n"), F.col("w"))).collect()] == [True, False]
