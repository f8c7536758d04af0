"""Look-alikes read for each other: sums by the whole table in plain Python, and lines that need no table at all."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.functions import alignment as A
from sparkloom.functions import line_scores as L
from sparkloom.operators import comparison as C
from sparkloom.plans import comparison as P
from sparkloom.plans.fixture import readings
from tests.test_banded import whole_table

PAIRS = (("e", "c"), ("ꦌ", "꧖"), ("a", "b"))


def lines(seed: int, n: int) -> list[tuple]:
    """Lines and readings with other letters, lost and doubled ones, changed order; nulls and empty ones."""
    r = random.Random(seed)
    signs = "aabceeꦌ꧖ é"
    spoil = lambda t: r.choice((t, t.translate(str.maketrans("aeꦌ", "bc꧖")), t.replace("c", "e"), t.replace(" ", ""), t.replace("e", "ee"), "".join(r.choice([c, c, "", r.choice(signs), c + r.choice(signs)]) for c in t), t[1:] + t[:1]))
    out = [(t, spoil(t), spoil(t)) for t in ("".join(r.choice(signs) for _ in range(r.randrange(20))) for _ in range(n))]
    return [*out, (None, "ae", None), ("ce", None, "ec"), ("", "", "")]


def by_hand(rows: list[tuple], pairs) -> list[dict]:
    rows = [tuple(t or "" for t in row) for row in rows]
    steps = [[[s[3:] for s in whole_table(row[0], hyp) if s[0] == "replace"] for row in rows for hyp in (row[k],)] for k in (1, 2)]
    out = []
    for letter, digit in pairs:
        one = {"letter": letter, "digit": digit, "ref_letter": sum(r.count(letter) for r, *_ in rows), "ref_digit": sum(r.count(digit) for r, *_ in rows)}
        for k, side in enumerate("ab"):
            false = [row[k + 1].count(letter) for row in rows if letter not in row[0]]
            count = lambda p, k=k: sum(own.count(p) for own in steps[k])
            one |= {f"letter_as_digit_{side}": count((letter, digit)), f"digit_as_letter_{side}": count((digit, letter)), f"false_letter_{side}": sum(false), f"false_letter_lines_{side}": sum(n > 0 for n in false)}
        out.append(one)
    return out


def test_sums_by_hand(spark):
    rows = lines(2, 500)
    df = spark.createDataFrame(rows, "ref string, a string, b string").repartition(3)
    want = by_hand(rows, PAIRS)
    assert [r.asDict() for r in C.lookalikes(df, PAIRS).collect()] == want
    assert all(w["letter_as_digit_a"] and w["false_letter_b"] for w in want) and want[0]["digit_as_letter_b"]
    none = C.lookalikes(df.where("false"), PAIRS).collect()
    assert [r["letter"] for r in none] == [x for x, _ in PAIRS] and all(v == 0 for r in none for v in r[2:])


def test_substitutions_of_each_pair():
    rows = [(r or "", a or "") for r, a, _ in lines(3, 400)]
    want = sorted((k, *map(ord, s[3:])) for k, row in enumerate(rows) for s in whole_table(*row) if s[0] == "replace")
    for kind in (pa.string(), pa.large_string()):
        got = A.substituted(*(pa.array(c, kind) for c in zip(*rows, strict=True)))
        assert sorted(zip(*(g.tolist() for g in got), strict=True)) == want


def test_certain_pairs_and_subsequences():
    rows = [(r or "", a or "") for r, a, _ in lines(4, 400)]
    refs, hyps = [r for r, _ in rows], [h for _, h in rows]
    (x, n), (y, m) = A.code_points(refs), A.code_points(hyps)
    for k in np.flatnonzero(A.straight(x, y, n, m)).tolist():
        assert [s[0] for s in whole_table(*rows[k])] == ["equal" if c == d else "replace" for c, d in zip(*rows[k], strict=True)]

    def held(short: str, long: str) -> bool:
        rest = iter(long)
        return all(c in rest for c in short)

    assert A.nested(x, y, n, m).tolist() == [held(*sorted(row, key=len)) for row in rows]
    # moved characters, and two that 6 bits do not tell apart, stay uncertain
    (x, n), (y, m) = A.code_points(["abx", "ab", "a¡"]), A.code_points(["bxa", "cb", "áa"])
    assert A.straight(x, y, n, m).tolist() == [False, True, False]


def test_exchanged_letters_take_no_table(monkeypatch):
    """Before, a line with exchanged letters was computed in a band as wide as it has such letters."""
    asked = []
    own = A._band_moves
    monkeypatch.setattr(A, "_band_moves", lambda a, *rest: asked.append(len(a)) or own(a, *rest))
    ref = "the quick brown fox jumps over the lazy dog and comes back once more"
    hyp = ref.translate(str.maketrans("aeiou", "bcdfg"))
    steps = A.align_batch([ref], [hyp])[0]
    assert asked == [] and steps == whole_table(ref, hyp)
    batch = pa.RecordBatch.from_pydict({"ref": [ref, ref, "qed"], "a": [hyp, ref.replace("e", "ee"), "ecq"], "b": [ref.replace("th", ""), "nil", ref]})
    (got,) = (b.to_pylist()[0] for b in L.lookalike_sums((("e", "c"), ("o", "f")))(iter([batch])))
    assert got["letter_as_digit_a0"] == ref.count("e") and got["letter_as_digit_a1"] == ref.count("o")
    assert sum(asked) == 1  # `ecq` alone: it has the length of `qed`, but its e has moved


def test_query_reads_texts_once_and_aligns_in_one_step(spark, capsys):
    d = "/root/testdata/sf0.001"
    df = P.compare_lookalikes(spark, d)
    df.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and plan.count("FileScan") == 1
    rows = readings(spark, d).where(F.crc32("ref") % 40 == 0).select("ref", "a", "b")
    assert [r.asDict() for r in C.lookalikes(rows, P.PAIRS).collect()] == by_hand([tuple(r) for r in rows.collect()], P.PAIRS)
