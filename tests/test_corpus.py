"""Lines and the funnel against plain Python on a few documents."""

from sparkloom.operators import corpus as O

TEXTS = {
    1: "the quick brown fox jumps over the lazy dog and runs far away from the old grey house near the wide river\nfew words here",
    2: "one two three four five NATO six seven eight nine ten eleven twelve thirteen fourteen\n\nalpha beta gamma delta epsilon zeta eta theta iota kappa",
    3: "",
    4: None,
    5: "a b c d e " + "x" * 90 + " then some more words follow the very long one in this line",
}
# the cleaner's result, by hand: capital words and signs break, paragraphs of fewer than five words go
WORDS = {
    (1, 0): TEXTS[1].split("\n")[0].split(" "),
    (2, 0): [None if w == "NATO" else w for w in TEXTS[2].split("\n")[0].split(" ")],
    (2, 2): TEXTS[2].split("\n")[2].split(" "),
    (5, 0): TEXTS[5].split(" "),
}


def pars(spark, texts=TEXTS):
    return O.paragraphs(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))


def test_paragraphs_by_hand(spark):
    assert {(r.doc, r.par): r.words for r in pars(spark).collect()} == WORDS


def test_lines_are_the_chunks_of_the_words(spark):
    got = {(r.doc, r.par, r.line): r.text for r in O.chunk_lines(pars(spark)).collect()}
    assert got == {(d, p, i): t for (d, p), words in WORDS.items() for i, t in enumerate(O.chunk(words, 1234, d, p))}
    assert all(20 <= len(t) <= 80 for t in got.values()) and not any("six" in t and "five" in t for t in got.values())
    assert O.chunk_lines(pars(spark, {1: ""})).collect() == []


def test_funnel_counts_each_word_once(spark):
    lines = O.dedup_first(spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "text string, at int"), "text", ["at"])
    said = [w for words in WORDS.values() for w in words if w and len(w) < 90] + ["x" * 90]
    got = O.funnel(pars(spark), lines).first().asDict()
    assert got == {"articles": 3, "paragraphs": 4, "words": len(said), "vocab": len(set(said)), "lines": 3, "duplicates": 1, "kept": 2}
    none = O.funnel(pars(spark, {1: "", 2: None}), lines.where("at > 9")).first().asDict()
    assert set(none.values()) == {0}
