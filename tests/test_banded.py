"""Alignment in a band, and the counters that need no step of it as a row or column."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import alignment as A
from sparkloom.functions import diffs as D
from sparkloom.functions import script as S
from sparkloom.functions import text as X
from sparkloom.operators import comparison as O
from sparkloom.operators import evaluation as E
from sparkloom.operators import forms as R


def whole_table(ref: str, hyp: str) -> list[tuple]:
    """Steps of one pair by the whole table in plain Python."""
    big = len(ref) + len(hyp) + 1
    step = big * big
    cost = [[step * (i + j) for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    sub = lambda x, y: -big if x == y else step - (A.char_class(x) == A.char_class(y))
    for i, x in enumerate(ref, 1):
        for j, y in enumerate(hyp, 1):
            cost[i][j] = min(cost[i - 1][j - 1] + sub(x, y), cost[i - 1][j] + step, cost[i][j - 1] + step)
    out, i, j = [], len(ref), len(hyp)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + sub(ref[i - 1], hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append(("equal" if ref[i] == hyp[j] else "replace", i, j, ref[i], hyp[j]))
        elif i and cost[i][j] == cost[i - 1][j] + step:
            i -= 1
            out.append(("delete", i, None, ref[i], None))
        else:
            j -= 1
            out.append(("insert", None, j, None, hyp[j]))
    return out[::-1]


def _pairs(n: int) -> list[tuple[str, str]]:
    r = random.Random(5)
    word = lambda: "".join(r.choice("ab cé́") for _ in range(r.randint(0, 25)))
    refs = [word() for _ in range(n)]
    return [(x, r.choice((x, word(), "".join(c * r.choice((0, 1, 1, 1, 2)) for c in x), x.replace(" ", ""), x.replace("a", "b")))) for x in refs]


def test_band_gives_the_steps_of_the_whole_table():
    pairs = _pairs(400)
    got = A.align_batch([r for r, _ in pairs], [h for _, h in pairs])
    assert got == [whole_table(r, h) for r, h in pairs]
    assert A.distances([r for r, _ in pairs], [h for _, h in pairs]).tolist() == [sum(s[0] != "equal" for s in own) for own in got]


def test_long_texts_with_few_edits_need_little_memory():
    ref = "abcdefghij" * 800
    tracemalloc.start()
    steps = A.align_batch([ref], ["x" + ref[1:4000] + ref[4001:] + "y"])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(s[0] != "equal" for s in steps) == 3
    assert peak < 50_000_000  # the whole table alone has 64 million cells


@pytest.fixture(scope="module")
def rows(spark):
    own = [(str(k), "c", r, h, h[::-1]) for k, (r, h) in enumerate(_pairs(60))]
    return spark.createDataFrame(own, "id string, cluster string, ref string, a string, b string")


def test_counts_score_each_line_once(rows, capsys):
    O.counts(O.scored(rows, ["b"], {"rare": ["b"]}, "a", (("a", "b"),))).explain()
    plan = capsys.readouterr().out
    assert plan.count("Scan") == 1 and "NestedLoop" not in plan


def test_metrics_of_bare_edits(rows):
    lines = O.scored(rows, ["b"], {"rare": ["b"]}, "a", (("a", "b"),)).select("ref", "a", "bare_a").collect()
    bare = lambda h: X.unicodedata.normalize("NFC", h.replace(" ", ""))
    assert [r["bare_a"] for r in lines] == [sum(s[0] != "equal" for s in whole_table(r["ref"], bare(r["a"]))) for r in lines]


def test_forms_and_marks_keep_no_steps(rows, capsys):
    rules = {"single": {"a": "one", "é": "two"}, "nasal": "b", "followers": ("ć",)}
    s = R.counted(rows, "ref", "a", "s", **rules)
    s.explain()
    assert "tag" not in capsys.readouterr().out
    for r in s.collect():
        steps = whole_table(r["ref"], r["a"])
        own = [x[3] for x in steps if x[0] == "equal" and x[3] in "aé"]
        assert [x for x in r["s"]["hit"] if x != "nya"] == [rules["single"][c] for c in own] and r["s"]["edits"] == sum(x[0] != "equal" for x in steps)
    got = R.inserted_marks(rows, [], "ref", "a", ["a"], ["b"]).first()
    put = [x[4] for r in rows.collect() for x in whole_table(r["ref"], r["a"]) if x[0] == "insert"]
    assert (got["top"], got["bottom"]) == (put.count("a"), put.count("b"))


def test_spaces_of_a_gap_pair_without_steps_in_the_plan(rows, capsys):
    out = E.gap_pairing(rows, ["cluster"], "ref", "a")
    out.explain()
    assert "tag" not in capsys.readouterr().out
    matched = 0
    for r in rows.collect():
        gaps = [[len(g) for g in "".join(" " if c == " " else "x" for c in t).split("x")] for t in (r["ref"], r["a"])]
        i = j = 0
        for tag in [None, *[s[0] for s in whole_table(r["ref"].replace(" ", ""), r["a"].replace(" ", ""))]]:
            i, j = i + (tag in ("equal", "replace", "delete")), j + (tag in ("equal", "replace", "insert"))
            k = min(gaps[0][i], gaps[1][j])
            gaps[0][i] -= k
            gaps[1][j] -= k
            matched += k
    assert out.first()["matched"] == matched


def test_words_are_converted_once():
    S.write_word.cache_clear()
    text = "kancil nyolong timun " * 50
    again = S.to_latin(S.from_latin(text))
    assert again == S.to_latin(S.from_latin("kancil nyolong timun ")) * 50
    assert S.write_word.cache_info().misses == 3


def test_spelling_rules_name_their_text_once(spark):
    one = spark.createDataFrame([("ꦫꦼꦤ꧀ꦕ",)], "t string").select(X.standardize(F.col("t")).alias("s"))
    assert one._jdf.queryExecution().analyzed().toString().count("regexp_replace") == len(X.RULES)
    assert one.first()["s"] == "ꦉꦚ꧀ꦕ"


def test_equal_readings_are_not_aligned(monkeypatch):
    seen = []
    monkeypatch.setattr(D, "Steps", lambda r, h: seen.append((r, h)) or A.Steps(r, h))
    assert D.segment_batch([" ab c"], [" ab c"]) == [[{"t": " ", "s": "sp"}, {"t": "a", "s": "ok"}, {"t": "b", "s": "ok"}, {"t": " ", "s": "ok"}, {"t": "c", "s": "ok"}]]
    assert seen == [([""], [""])]
    assert [x["s"] for x in D.segments("ab c", "xb dc")] == ["sub", "ok", "ok", "ins", "ok"]


def test_language_model_broadcasts_no_places(spark, tmp_path, capsys):
    from sparkloom.operators import language_model as L

    path = str(tmp_path / "texts")
    spark.createDataFrame([(str(k), "ab cd" * 20) for k in range(20)], "key string, text string").write.parquet(path)
    texts = spark.read.parquet(path)
    L.score(texts, "key", "text", L.grams(texts, "text", 5), 5, 5).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" not in plan and plan.count("BroadcastExchange") == 1  # the one row of the total
