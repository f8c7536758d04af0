"""Dictionary entries of wiki pages, by hand."""

from sparkloom.operators import pages as O

FIRST = """== {{bahasa|id}} ==
# not this
== {{bahasa|jv}} ==
# loose
{{-n-|jv}}
# [[air]]; water
#: {{syn|jv|banyu|[[toya]]|q=krama}}
#* quoted
## deeper
# (ngoko) rain
===Lafal===
# {{label|jv|krama}} rain
# {{open
{{jvword|n=kali|k=Lèpèn|ki=}}
===Etimologi===
# gone
=== Kata kerja ===
# def
# pijêt
# ragam dari pijêt
# lèpèn
==Other==
# nor this"""


def run(spark, *pages):
    entries, skipped = O.page_entries(spark.createDataFrame(list(pages), "page long, title string, text string"))
    return {(r["page"], r["section"], r["pos"]): (r["glosses"], r["note"]) for r in entries.collect()}, {r["reason"]: r["n"] for r in skipped.collect()}


def test_page_by_hand(spark):
    got, skipped = run(spark, (1, "Lepen", FIRST))
    assert got[1, 2, None] == (["loose"], None)
    assert got[1, 2, "nomina"] == (["air; water", "(ngoko) rain", "(krama) rain"], "ngoko kali; sinonim: banyu (krama), toya (krama)")
    assert got[1, 2, "verba"] == (["ragam dari pijêt"], None)
    assert len(got) == 3 and skipped == {O.NO_GLOSS: 4}


def test_titles_dialects_and_imports(spark):
    kedu = "=={{jawa kedu}}==\n{{-adj-}}\n# big: large\n# big\n# (x) own\n# two<br>tail"
    pages = [(1, "big", kedu), (2, "ꦏ", kedu), (3, "b", "== {{bhs|jv}} ==\n# a {{R:KBBI}}"), (4, None, kedu), (5, "c", None), (6, "d", ""), (7, "e", "== {{bahasa|jv}} ==\nno definition\u2028# nor here")]
    got, skipped = run(spark, *pages)
    assert got == {(1, 1, "adjektiva"): (["(Kedu) large", "(x) own", "(Kedu) two"], None)}
    assert skipped == {O.NO_TITLE: 1, O.COPIED: 1, O.NO_GLOSS: 1}


def test_repeated_titles_and_long_pages(spark):
    long = "== {{bahasa|jv}} ==\n" + "\n".join(f"# meaning {i % 500}" for i in range(5000))
    got, _ = run(spark, (1, "same", long), (2, "same", long))
    assert got[1, 1, None] == got[2, 1, None] and len(got[1, 1, None][0]) == 500 and got[1, 1, None][0][:2] == ["meaning 0", "meaning 1"]


def test_no_pages(spark):
    entries, skipped = O.page_entries(spark.createDataFrame([], "page long, title string, text string"))
    assert entries.count() == 0 and skipped.count() == 0
