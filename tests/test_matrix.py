"""The matrix of methods, by hand and by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import comparison as C
from sparkloom.operators import matrix as O

LINES = [("l1", 1, "print", "abcd"), ("l2", 1, "hand", "ab cd"), ("l3", 2, "print", "xyz"), ("l4", 3, "hand", None), ("l5", 3, "hand", "long enough")]
READ = "method string, line string, text string"


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, "line string, page long, kind string, ref string")


@pytest.fixture(scope="module")
def readings(spark):
    good = {"l1": "abcd", "l2": "abcd", "l3": "xz", "l4": "", "l5": "long enough"}
    bad = {"l1": "abXd", "l2": "", "l3": "xyz", "l4": "new", "l5": None}
    rows = [("good", *x) for x in good.items()] + [("bad", *x) for x in bad.items()] + [("half", "l1", "abcd"), ("good", "unknown", "zz")]
    return spark.createDataFrame(rows, READ)


def test_methods_come_whole_from_the_last_source(spark):
    first = spark.createDataFrame([("m", "1", "old"), ("m", "2", "old"), ("n", "1", "b"), ("n", "1", "a"), ("n", "1", None), (None, "1", "x"), ("n", None, "x")], READ)
    second = spark.createDataFrame([("m", "1", "new"), ("k", "9", None)], READ + "")
    got = {(r["method"], r["line"], r["text"]) for r in O.united([first, second]).collect()}
    assert got == {("m", "1", "new"), ("n", "1", "a"), ("k", "9", None)}
    assert O.united([first.where("false"), second.where("false")]).count() == 0


def test_pairs_by_hand(lines, readings):
    pairs = [("p", "good", "bad"), ("h", "half", "bad"), ("m", "good", "absent")]
    got = {(r["label"], r["kind"]): r for r in O.pair_rates(lines, O.scored(lines, readings), pairs, ["print", "hand"]).collect()}
    assert len(got) == 9 and {k[0]: r["status"] for k, r in got.items()} == {"p": "ok", "h": "incomplete", "m": "missing"}
    assert all(got["h", k][c] is None for k in ("print", "hand", "all") for c in ("lines", "cer_a", "delta", "ned_b"))
    r = got["p", "print"]
    assert (r["lines"], r["pages"]) == (2, 2) and r["cer_a"] == pytest.approx(1 / 7) and r["cer_b"] == pytest.approx(1 / 7) and r["delta"] == 0
    r = got["p", "hand"]
    assert (r["lines"], r["pages"]) == (3, 2) and r["cer_a"] == pytest.approx(1 / 16) and r["cer_b"] == pytest.approx((5 + 3 + 11) / 16)
    assert r["ned_b"] == pytest.approx(19 / (5 + 3 + 11)) and r["ned_delta"] == pytest.approx(r["ned_a"] - r["ned_b"], abs=1e-8)
    assert got["p", "all"]["lines"] == 5 and got["p", "all"]["pages"] == 3


def test_no_lines_and_no_readings(lines, readings):
    rows = O.pair_rates(lines.where("false"), O.scored(lines, readings.where("false")), [("p", "good", "bad")], ["print"]).collect()
    assert [(r["kind"], r["status"], r["delta"]) for r in rows] == [("print", "missing", None), ("all", "missing", None)]


def test_intervals_by_brute_force(spark, lines, readings):
    scores = O.scored(lines, readings).cache()
    got = {(r["kind"], r["measure"]): (r["low"], r["high"]) for r in O.pair_intervals(scores, [("p", "good", "bad")], ["print", "hand"], 400, 3).collect()}
    rows = scores.collect()
    pages = sorted({r["page"] for r in rows})
    keys = spark.createDataFrame([(p,) for p in pages], "page long").select("page", F.xxhash64(F.lit(1), "page").alias("k")).collect()
    unit = {r["page"]: r["k"] for r in keys}
    w = C.weights(np.array([unit[p] for p in pages]), 0, 400, 3)
    for kind in ("print", "hand", "all"):
        for measure, over in (("cer", "chars"), ("ned", "norm")):
            side = []
            for m in ("good", "bad"):
                own = lambda p, c, m=m: sum(r[c] for r in rows if r["method"] == m and r["page"] == p and kind in ("all", r["kind"]))  # noqa: B023, E731
                e, n = (w @ np.array([own(p, c) for p in pages]) for c in ("edits", over))
                side.append(np.divide(e, n, out=np.full(400, np.nan), where=n > 0))
            d = side[0] - side[1]
            assert got[kind, measure] == pytest.approx(tuple(np.quantile(d[~np.isnan(d)], [0.025, 0.975])))


def test_report_leaves_incomplete_pairs_open(lines, readings):
    rows = O.pair_report(lines, O.scored(lines, readings), [("p", "good", "bad"), ("h", "half", "bad")], ["print"], 100).collect()
    assert len(rows) == 4
    for r in rows:
        assert (r["low"] is None) == (r["label"] == "h")
        assert r["label"] == "h" or r["low"] <= r["high"]


def test_stages_with_their_last_validation(spark, lines, readings):
    logs = spark.createDataFrame([("r1", 1, 0.5), ("r1", 2, 0.25), ("r1", 3, None), ("r2", 1, None)], "run string, at long, val double")
    stages = [("base", "good", "bad", "r1", "r2"), ("cut", "half", "bad", "r1", "r2")]
    rows = O.stage_rates(lines, O.scored(lines, readings), stages, logs, ["print"]).collect()
    assert {(r["stage"], r["kind"], r["place"], r["val_a"], r["val_b"]) for r in rows} == {("base", "print", 0, 0.25, None), ("base", "all", 0, 0.25, None)}


def test_pages_hold_and_draw_only_what_is_used(spark, lines, readings):
    """Rates and intervals read the same columns of a page, so that its scores serve both, and pages are drawn as clusters only."""
    got = O.by_page(O.scored(lines, readings), ["bad", "good"], ["print", O.ALL])
    assert [c for c in got.columns if c.startswith("lines")] == ["lines_0_1", "lines_1_1"]
    pages = spark.createDataFrame([(i, 1.0) for i in range(5)], "page long, x double")
    assert {r["kind"] for r in C.resampled(pages, "page", "page", ["x"], 8, 0, ("clusters",)).collect()} == {"all", "clusters"}
