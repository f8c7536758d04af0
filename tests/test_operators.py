import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import lexicon, lineage, search, store
from sparkloom.sources import tables as IO
from sparkloom.streaming import events as E


def test_sources_read_what_they_write(spark, tmp_path):
    df = spark.createDataFrame([("a", "x y"), ("b", "é")], "id string, text string")
    IO.write_delimited(df, f"{tmp_path}/t")
    assert IO.delimited(spark, f"{tmp_path}/t", ["id", "text"]).count() == 2
    with pytest.raises(ValueError):
        IO.delimited(spark, f"{tmp_path}/t", ["id", "nothing"])
    IO.write_jsonl(df, f"{tmp_path}/j", gzip=True)
    assert IO.jsonl(spark, f"{tmp_path}/j", df.schema).orderBy("id").collect() == df.orderBy("id").collect()
    (tmp_path / "torn.jsonl").write_text('{"id": "a", "text": "t"}\n\n{"id": "b", "te')
    good, counts = IO.jsonl_tolerant(spark, f"{tmp_path}/torn.jsonl", df.schema)
    assert good.count() == 1 and {r["status"]: r["n"] for r in counts.collect()} == {"loaded": 1, "broken": 1}
    (tmp_path / "w.xml").write_text("<m><page><title>A</title><ns>0</ns><revision><text>t</text></revision></page><page><title>B</title><ns>1</ns></page></m>")
    assert [tuple(r) for r in IO.xml_pages(spark, f"{tmp_path}/w.xml").collect()] == [("A", "t")]
    (tmp_path / "t.md").write_text("| a | b |\n|---|---|\n| `x` | 1 |\n")
    assert IO.markdown_rows(spark, f"{tmp_path}/t.md", 2).first()["cells"] == ["`x`", "1"]
    name = spark.range(1).select(*IO.name_facts(F.lit("d/o6_n200_ds50.pkl"))).first()
    assert tuple(name) == (6, 200, 50, None)


def test_partition_replace_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, d string")
    IO.replace_partition(df, f"{tmp_path}/p", "d")
    IO.replace_partition(spark.createDataFrame([(9, "b")], "v int, d string"), f"{tmp_path}/p", "d")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/p").select("v", "d").collect())) == [(1, "a"), (9, "b")]
    old = spark.createDataFrame([(1, None, "x"), (2, "p", "y")], "k int, p string, v string")
    new = spark.createDataFrame([(1, None, "z")], "k int, p string, v string")
    assert sorted(r["v"] for r in IO.upsert(old, new, ["k", "p"]).collect()) == ["y", "z"]
    assert [r["v"] for r in IO.upsert(old, new, ["k", "p"], prune=True).collect()] == ["z"]
    cache = spark.createDataFrame([("k", "s", "old", 1), ("k", "s", "new", 2)], "k string, s string, v string, seq int")
    assert IO.cache_merge(cache, cache.limit(0), ["k", "s"], "v", "seq").first()["v"] == "new"


def test_lineage_of_segments(spark):
    log = [(0, True), (50, False), (100, False), (60, True), (90, False), (120, False), (120, True)]
    df = spark.createDataFrame([("r", i, s, b) for i, (s, b) in enumerate(log)], "run string, seq int, step int, start boolean")
    got = lineage.segments(df, "run", ["seq"], "step", "start", 110)
    assert sorted((r["first"], r["last"]) for r in got.collect()) == [(0, 60), (60, 110)]
    assert [r["step"] for r in lineage.rollbacks(df, "run", ["seq"], "step", "start").orderBy("seq").collect()] == [60, 120]


def test_ancestry_tells_cycles_and_missing_parents(spark):
    n = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "x"), ("d", None), ("e", "d")], "k string, p string")
    got = {(r["node"], r["ancestor"], r["status"]) for r in lineage.ancestry(n, "k", "p").where("distance > 0").collect()}
    assert {("a", "b", "ok"), ("a", "a", "cycle"), ("c", "x", "missing"), ("e", "d", "ok")} <= got


def test_ancestry_of_long_chains_and_rings(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)] + [(1000 + i, 1000 + (i + 1) % 70) for i in range(70)] + [(2000, 1000)], "k long, p long")
    got = lineage.ancestry(n, "k", "p")
    own = {(r["ancestor"], r["distance"], r["status"]) for r in got.where("node = 199").collect()}
    assert own == {(199 - i, i, "ok") for i in range(200)}
    assert [(r["ancestor"], r["distance"]) for r in got.where("node = 1000 and status = 'cycle'").collect()] == [(1000, 70)]
    assert [(r["ancestor"], r["distance"]) for r in got.where("node = 2000 and status = 'cycle'").collect()] == [(1000, 71)]


def test_keep_or_drop_tells_the_first_rule(spark):
    rows = spark.createDataFrame([(1, 5), (1, 9), (2, 0)], "k int, v int")
    got = store.keep_or_drop(rows, "k", (F.col("v") > 8, "zz"), (F.col("v") > 4, "aa"))
    assert {r["k"]: r["reason"] for r in got.collect()} == {1: "zz", 2: None}


def test_as_of_is_strictly_before(spark):
    e = spark.createDataFrame([("k", 1, 1, "a"), ("k", 5, 2, "b")], "k string, at int, seq int, v string")
    p = spark.createDataFrame([("k", 1, 9), ("k", 5, 9), ("k", 6, 9), ("z", 6, 9)], "k string, at int, seq int")
    got = {(r["k"], r["at"]): r["last"] for r in lineage.as_of_last(e, p, "k", "at", "v", "seq").collect()}
    assert got == {("k", 1): None, ("k", 5): "a", ("k", 6): "b", ("z", 6): None}


def test_lexicon_needs_a_dominant_marked_form(spark):
    words = [("café",)] * 3 + [("cafe",)] + [("élan",)] + [("été",)] * 2 + [("ete",)] * 2
    lex = {r["plain"]: r["form"] for r in lexicon.build(spark.createDataFrame(words, "word string")).collect()}
    assert lex == {"cafe": "café"}
    docs = spark.createDataFrame([(1, "Cafe, ete! CAFÉ"), (2, None), (3, "")], "k int, t string")
    table = spark.createDataFrame([("cafe", "café")], "plain string, form string")
    got = {r["k"]: r["text"] for r in lexicon.restore(docs, "k", "t", table).collect()}
    assert got == {1: "Café, ete! CAFÉ"}


def test_levels(spark):
    markers = spark.createDataFrame([("aku", "ngoko"), ("ora", "ngoko"), ("kula", "krama"), ("mboten", "krama"), ("niki", "madya")], "word string, level string")
    texts = spark.createDataFrame([(1, "aku ora kula mboten"), (2, "kula"), (3, "nothing"), (4, "griyanipun"), (5, ""), (6, "aku niki")], "k int, t string")
    got = {r["key"]: r["level"] for r in lexicon.classify(texts, "k", "t", markers, {"ipun": "krama"}).collect()}
    assert got == {1: "campur", 2: "krama", 3: None, 4: "krama", 5: None, 6: "ngoko"}


def test_merge_takes_each_field_from_the_first_that_has_it(spark):
    e = spark.createDataFrame([("w", 1, None, "b"), ("w", 2, "x", "c"), ("v", 1, None, None)], "k string, p int, f string, g string")
    got = {r["k"]: (r["f"], r["g"], r["merged"]) for r in lexicon.merge_entries(e, ["k"], "p", ["f", "g"]).collect()}
    assert got == {"w": ("x", "b", 2), "v": (None, None, 1)}


def test_search_falls_back_from_affix(spark):
    e = spark.createDataFrame([(1, "rumah", "id", " house "), (2, "rumahan", "en", " homely "), (3, "perumahan", "jv", " rumah big ")], "id int, lookup string, gloss_lang string, gloss_text string")
    assert search.effective_needle(e, "-rumah") == "rumah" and search.effective_needle(e, "-an") == "-an"
    got = [(r["id"], r["tier"], r["total"]) for r in search.tiers(e, "rumah", 10).collect()]
    assert got == [(1, 0, 3), (2, 1, 3), (3, 2, 3)]
    assert search.reverse(e, "house").first()["id"] == 1 and search.reverse(e, "ho").count() == 0


def test_document_rules(spark):
    d = spark.createDataFrame([(1, '{"n": 3, "s": 0.5}'), (2, '{"n": "x", "s": 1.5}'), (3, "{}")], "k int, j string")
    got = {(r["key"], r["path"], r["problem"]) for r in store.document_violations(d, "k", "j", {"n": "int", "s": "share?"}).collect()}
    assert got == {(2, "n", "not int"), (2, "s", "not share"), (3, "n", "missing")}


def test_reconcile_tells_one_sided_keys(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (3, 2.0)], "k int, w double")
    assert sorted(r["k"] for r in store.reconcile(a, b, "k", "v", "w").collect()) == [2, 3]


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i // 6, i % 6 * 10), i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = E.tumbling(stream, "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, E.tumbling(df, "1 hour").collect()))
    finally:
        q.stop()
    seen = []
    E.upsert_sink(E.deduplicated(stream, ["event_id"]), lambda b, n: seen.append(b.count()), f"{tmp_path}/c").awaitTermination(60)
    assert sum(seen) == 60
