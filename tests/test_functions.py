import itertools
import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators.reports import wiki_to_text
from sparkloom.functions import alignment as A
from sparkloom.functions import diffs as D
from sparkloom.functions import script as S
from sparkloom.functions import stats
from sparkloom.functions import text as X
from sparkloom.operators import language_model as L
from sparkloom.operators.corpus import chunk


def best(a, b):
    @lru_cache(None)
    def go(i, j):
        if not i or not j:
            return (i + j, 0, 0)
        same, cls = a[i - 1] == b[j - 1], A.char_class(a[i - 1]) == A.char_class(b[j - 1])
        d = go(i - 1, j - 1)
        options = [(d[0], d[1] - 1, d[2]) if same else (d[0] + 1, d[1], d[2] - cls)]
        options += [(x[0] + 1, x[1], x[2]) for x in (go(i - 1, j), go(i, j - 1))]
        return min(options)

    return go(len(a), len(b))


def cost(steps):
    edits = sum(t != "equal" for t, *_ in steps)
    return edits, -sum(t == "equal" for t, *_ in steps), -sum(t == "replace" and A.char_class(r) == A.char_class(h) for t, _, _, r, h in steps)


def test_alignment_is_best_in_all_three_ways():
    rng = random.Random(2)
    pairs = [("".join(rng.choice("ab ́") for _ in range(rng.randrange(7))), "".join(rng.choice("ab ́") for _ in range(rng.randrange(7)))) for _ in range(400)]
    for (a, b), steps in zip(pairs, A.align_batch([a for a, _ in pairs], [b for _, b in pairs])):
        assert cost(steps) == best(a, b)
        assert "".join(r for *_, r, _ in steps if r) == a and "".join(h for *_, h in steps if h) == b
        assert [i for _, i, *_ in steps if i is not None] == list(range(len(a)))


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_segments_rebuild_the_reading(a, b):
    assert "".join(s["t"] for s in D.segments(a, b) if s["s"] != "del") == b


def test_segments():
    assert D.segments("ab c", "ab c") == [{"t": "a", "s": "ok"}, {"t": "b", "s": "ok"}, {"t": " ", "s": "ok"}, {"t": "c", "s": "ok"}]
    assert [s["s"] for s in D.segments("abc", "a c")] == ["ok", "sp", "del", "ok"]


def test_sign_test(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 5, 0.0625), (5, 0, 0.0625), (3, 3, 1.0), (1, 9, 22 / 1024)], "a long, b long, p double")
    assert all(r["q"] == pytest.approx(r["p"]) for r in rows.withColumn("q", stats.sign_test("a", "b")).collect())


def test_bootstrap_of_equal_sides_is_zero(spark):
    rows = spark.range(30).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("a"), (F.col("id") + 1).alias("b"))
    for boot in (stats.bootstrap_multinomial, stats.bootstrap_poisson):
        got = stats.interval(boot(rows, "k", ("a", "b", "a", "b"), 20)).first()
        assert (got["low"], got["high"], got["se"], got["valid"]) == (0, 0, 0, 20)


def test_gap_pairing_counts_each_space_once(spark):
    rows = spark.createDataFrame([("ka na ta", "ka nata", 1), ("kanata", "ka na ta", 0), ("ka  na", "ka na", 1), ("ka na", "kan a", 0), ("", "", 0)], "r string, h string, n int")
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    got = rows.withColumn("m", A.matched_spaces(F.col("r"), F.col("h"), A.alignment(bare("r"), bare("h")))).collect()
    assert [r["m"] for r in got] == [r["n"] for r in got]


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(X.clean_words(lit("Aku KGPAA lunga-bali, “pasar” x@y"))) == ["aku", None, "lunga", "bali,", "pasar", None]
    assert one(X.logical_syllables(lit("ꦏꦤ꧀ꦠꦶ a"))) == ["ꦏ", "ꦤ꧀ꦠꦶ", " ", "a"]
    assert one(X.is_well_formed(lit("ꦏꦶ"))) and not one(X.is_well_formed(lit("aꦶ")))
    assert one(X.longest_chain(lit("ꦏ꧀ꦠ꧀ꦫꦤ꧀ꦠ"))) == 2
    assert one(X.valid_script(lit("ꦏꦶ"))) and not one(X.valid_script(lit("")))
    assert one(X.syllable_pattern(lit("ꦏꦺ"))) == "L A9BA"
    assert one(X.inversions(F.array(lit(2), lit(0), lit(1)))) == 2
    assert one(X.apply_permutation(lit("abc"), F.array(lit(2), lit(0), lit(1)))) == "cab"
    assert one(X.standardize(lit("ꦥꦤ꧀ꦕꦫꦼꦏꦿꦼ꧑꧒"))) == "ꦥꦚ꧀ꦕꦉꦏꦽ꧇꧑꧒꧇"
    assert one(X.roundtrip_cer(lit("ana"), lit("hana"))) == 0
    assert one(X.ctc_collapse(F.array(*map(lit, [0, 1, 1, 0, 1, 2, 2])))) == [1, 1, 2]
    assert one(X.sentences(lit("A b. C?\nD"))) == ["A b.", "C?", "D"]
    assert one(X.markup_to_text(lit("<p>a&amp;b<br>c</p><script>x</script>"))) == "a&b\nc"
    assert one(X.nfc(lit("é"))) == "é"
    assert X.escape_like("a%b_c\\") == "a\\%b\\_c\\\\"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["ka", "ta", "na", "re", "pi", "so"]), min_size=1, max_size=6))
def test_script_words_read_back(parts):
    word = "".join(parts)
    assert S.to_latin(S.from_latin(word)).replace("ê", "e").replace("é", "e") == word


def test_script_order_is_reversible():
    table, pre = {"L A9BA": (1, 0), "L A9C0 L A9BA": (3, 0, 1, 2)}, frozenset("ꦺ")
    for t in ("ꦏꦺꦤ", "ꦏ꧀ꦠꦺ ꦤ"):
        assert S.to_logical(S.to_visual(t, table, pre), S.inverse_table(table), pre) == t
    with pytest.raises(ValueError):
        S.inverse_table({"L A9BA": (1, 0), "A9BA L": (0, 1)})


def test_chunks_hold_their_bounds():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) if rng.random() > 0.05 else None for _ in range(400)]
    lines = chunk(words, 1, 2, 3)
    assert lines and all(20 <= len(x) <= 80 for x in lines) and chunk(words, 1, 2, 3) == lines


def witten_bell(train, order, vocab):
    grams = Counter()
    for line in train:
        t = L.BEGIN * (order - 1) + line + L.END
        grams.update(t[i - k + 1 : i + 1] for i in range(order - 1, len(t)) for k in range(1, order + 1))
    ones = sum(n for g, n in grams.items() if len(g) == 1)

    def prob(history, c):
        p = (grams[c] + 1) / (ones + len(vocab) + 1)
        for k in range(1, order):
            h = (L.BEGIN * order + history)[-k:]
            follow = [n for g, n in grams.items() if len(g) == k + 1 and g[:-1] == h]
            if follow:
                p = (grams[h + c] + len(follow) * p) / (sum(follow) + len(follow))
        return p

    return prob


def test_language_model(spark):
    lines, vocab = ["abab", "bac", ""], "abc"
    train = spark.createDataFrame([(x,) for x in lines], "text string")
    texts = ["", "a", "ab", "cab", "bbb"]
    for order in (1, 2, 3):
        prob = witten_bell(lines, order, vocab)
        assert all(sum(prob(h, c) for c in [*vocab, L.END]) == pytest.approx(1) for h in ("", "a", "ba", "cc"))
        got = L.score(spark.createDataFrame([(x, x) for x in texts], "key string, text string"), "key", "text", L.grams(train, "text", order), order, 3)
        want = {x: sum(math.log(prob(x[:i], c)) for i, c in enumerate(x + L.END)) for x in texts}
        assert {r["key"]: r["logp"] for r in got.collect()} == pytest.approx(want)


def test_beam_without_model_beats_greedy():
    logs = np.log(np.array([[0.4, 0.6, 1e-9], [0.6, 0.4, 1e-9]]))
    assert L.beam_decode(logs) == [1]
    assert L.beam_decode(np.log(np.array([[0.1, 0.9, 1e-9], [0.9, 0.1, 1e-9], [0.1, 0.9, 1e-9]]))) == [1, 1]


def test_wide_beam_finds_the_most_probable_sequence():
    rng = np.random.default_rng(2)
    for _ in range(12):
        logs = np.log(rng.dirichlet(np.ones(3), size=4))
        every = [list(x) for n in range(5) for x in itertools.product((1, 2), repeat=n)]
        score = lambda ids: D.ctc_log_probability(logs, ids)
        assert L.beam_decode(logs, width=1000, floor=-99.0) == max(every, key=score)
        bonus = lambda prefix, token: 0.3 * (token == 1) - 0.1 * len(prefix)
        model = lambda ids: sum(bonus(tuple(ids[:i]), t) for i, t in enumerate([*ids, 0]))
        best = max(score(ids) + 0.5 * model(ids) + 0.2 * len(ids) for ids in every)
        got = L.beam_decode(logs, bonus, 0.5, 0.2, width=1000, floor=-99.0)
        assert score(got) + 0.5 * model(got) + 0.2 * len(got) == pytest.approx(best)


def test_script_is_read_sign_by_sign():
    assert S.to_latin("ꦲꦤꦕꦫꦏ") == "anacaraka" and S.to_latin("ꦏꦺꦴꦏꦿꦶꦢꦽ꧈ ꧑꧒x") == "kokridrê, 12x"
    assert S.to_latin("ꦥ꦳ꦱꦃ ꦥꦚ꧀ꦗꦁ") == "fasah panjang"
    assert S.from_latin("omah-omah 1.250, a-") == "ꦲꦺꦴꦩꦃꦲꦺꦴꦩꦃ ꧇꧑.꧒꧕꧐꧇꧈ ꦲ-"


def test_wiki_links_show_their_captions(spark):
    source = "a [[b|c]] [[d]] [[File:x.png|thumb|cap]]{{t|{{u}}}} [https://x.y z] ''q''<ref name=a/> <ref>r</ref>e"
    assert spark.createDataFrame([(source,)], "s string").select(wiki_to_text(F.col("s"))).first()[0] == "a c d z q e"


def test_ctc_probability_sums_over_paths():
    logs = np.log(np.array([[0.5, 0.5], [0.25, 0.75]]))
    assert math.exp(D.ctc_log_probability(logs, [1])) == pytest.approx(1 - 0.5 * 0.25)
    assert math.exp(D.ctc_log_probability(logs, [])) == pytest.approx(0.5 * 0.25)


def test_chrf_of_equal_texts_is_100(spark):
    rows = spark.createDataFrame([("g", "some text", "some text"), ("h", "abc", "xyz"), ("i", "", "")], "g string, r string, h string")
    assert {r["g"]: r["chrf"] for r in D.corpus_chrf(rows, "g", "r", "h").collect()} == {"g": 100.0, "h": 0.0, "i": 0.0}


def test_sign_test_of_many_pairs_equals_the_exact_one():
    def exact(n, k):
        row = itertools.accumulate(range(k), lambda c, i: c * (n - i) // (i + 1), initial=1)
        return min(1.0, 2 * sum(row) / 2**n)

    for n, k in ((10_001, 5_000), (10_001, 4_800), (10_001, 3), (12_000, 6_000), (12_000, 5_700), (12_000, 0)):
        assert stats.binomial_tail(n, k) == pytest.approx(exact(n, k), rel=1e-9, abs=1e-300)
    for n, k in ((0, 0), (1, 0), (9, 4), (200, 80)):
        assert stats.binomial_tail(n, k) == exact(n, k)
