"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import components, fingerprints, jaccard_join, kernel, labelled, licenses, line_dedup, overlaps, packing, pieces, quality_classifier, quality_rules, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, marks int, n_words string, score double"
WS = "[^\x20\x09-\x0d]+"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def corpus(seed=1, n=60):
    """(id, text) with copies, near copies, shared passages and lines, empties, nulls and one very long text."""
    rng = random.Random(seed)
    passage, line = prose(rng, 60), "shared line of some words here"
    out = {}
    for i in range(n):
        t = prose(rng, rng.choice([3, 30, 120, 300])) + "\n" + prose(rng, 20)
        if i % 5 == 0:
            t += "\n" + passage
        if i % 3 == 0:
            t += "\n" + line
        if i % 7 == 6:
            t = out[i - 1]
        if i % 11 == 10:
            words = out[i - 2].split(" ")
            words[len(words) // 2] = "changed"
            t = " ".join(words)
        out[i] = t
    out[n], out[n + 1], out[n + 2], out[n + 3] = "", None, " \n\t ", prose(rng, 6000)
    out[n + 4], out[n + 5] = "é ü 漢字 𐍈 ▁x", "One. Two! Three? \n\n Four"
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 20}", len(t or ""), "x", 7, 1, "y", 0.5) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts.items())


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Null ids, repeated rows, rows that share an id."""
    rows = [(None, texts[0]), (None, None), (1, texts[1]), (1, texts[1]), (1, "other text of this id"), (2, texts[0])]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 6 == 0)) for i in texts] + [(None, 1, 1), (3, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_words_and_grams_keep_inside_texts():
    x = next(kernel.texts(pa.array(["a b", "c", None, " d  e "])))
    assert [x.buf[s:e].tobytes() for s, e in zip(x.starts, x.ends)] == [b"a", b"b", b"c", b"d", b"e"]
    assert x.bounds.tolist() == [0, 2, 3, 3, 5]
    assert kernel.grams(x.words(), x.doc_of_word(), 2)[1].tolist() == [0, 3]


def test_packed_arrays_come_back():
    a = np.array([0, 1, 300, 70_000], dtype=np.uint32)
    assert kernel.unpack(kernel.pack(a), np.uint32).tolist() == kernel.unpack_rising(kernel.pack_rising(a)).tolist() == a.tolist()


def brute_repeats(rows, window):
    seen, out = {}, {}
    for i, t in sorted(rows.items()):
        w = re.findall(WS, t or "")
        gone = set()
        for p in range(len(w) - window + 1):
            if tuple(w[p : p + window]) in seen:
                gone |= set(range(p, p + window))
            seen.setdefault(tuple(w[p : p + window]), (i, p))
        out[i] = len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    return out


@pytest.mark.parametrize("window,block", [(20, 10), (9, 5)])
def test_substring_dedup(docs, texts, window, block):
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs, window, block).collect()}
    assert got == brute_repeats(texts, window)


def test_substring_dedup_odd(odd, none, texts):
    got = substring_dedup.remove_repeats(odd).collect()
    assert len(got) == 6 and {len(r["row"]) for r in got} == {10}
    n = len(texts[0].split())
    assert sorted(r["n_removed"] for r in got if r["text"] is not None and r["n_words"] == n) == ([0, n] if n >= 20 else [0, 0])
    assert all(r["n_removed"] == 0 for r in got if r["row"]["doc_id"] == 1)  # equal rows tie
    assert substring_dedup.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(odd, 10, 10)


def test_pieces_are_lossless_and_reproducible(docs, odd, none, texts):
    a = {r["row"]["doc_id"]: r for r in pieces.encode(docs).collect()}
    assert all(r["lossless"] for r in a.values()) and len(a) == len(texts)
    b = {r["row"]["doc_id"]: r["ids_sha256"] for r in pieces.encode(docs.repartition(7)).collect()}
    assert b == {k: r["ids_sha256"] for k, r in a.items()}
    back = pieces.decode(pieces.encode(docs).select("ids", F.col("row.doc_id").alias("k"))).collect()
    assert {r["row"]["k"]: r["text"] for r in back} == {k: t or "" for k, t in texts.items()}
    assert pieces.encode(odd).count() == 6 and pieces.encode(none).count() == 0


def test_samples_follow_the_lattice():
    v = pieces.load()
    word, n = " thing", 20_000
    look = {v.data[v.offsets[i] : v.offsets[i + 1]].tobytes(): w for i, w in zip(v.ids, v.weights)}

    def ways(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in look:
                for rest, w in ways(s[k:]):
                    yield (s[:k], *rest), w + look[s[:k]]

    all_ways = dict(ways(word.encode()))
    total = np.logaddexp.reduce(list(all_ways.values()))
    x = next(kernel.texts(pa.array([word] * n), limit=1 << 22))
    ids, b = pieces.encode_run(x, np.arange(n, dtype=np.int64), v)
    seen = Counter(tuple(v.data[v.offsets[i] : v.offsets[i + 1]].tobytes() for i in ids[b[d] : b[d + 1]]) for d in range(n))
    assert max(abs(seen[k] / n - np.exp(w - total)) for k, w in all_ways.items()) < 0.02


def test_packing(docs, odd, none, texts):
    rows = packing.pack_documents(docs, (16, 32, 64)).collect()
    bins = defaultdict(list)
    for r in rows:
        if r["n_tokens"]:
            bins[r["bin_id"], r["capacity"]].append((r["start"], r["n_tokens"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), held in bins.items():
        at = 0
        for start, n in sorted(held):
            assert start == at
            at += n
        assert at <= capacity and (capacity == 16 or at > capacity // 2)  # shrunk to its contents
    words = {i: len(re.findall(WS, t or "")) for i, t in texts.items()}
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
        assert r["first_word"] == 64 * r["piece"]
    assert {i: got[i] for i in words} == words
    assert packing.pack_documents(odd).where("bin_id is null").count() == 1 and packing.pack_documents(none).count() == 0


def test_packing_finds_the_perfect_fit():
    bins, starts, caps = packing.pack_lengths([8, 8, 4, 4, 4, 4], (8, 16), 1)
    assert sum(caps) == 32 and starts.count(0) == len(caps)


def brute_jaccard(texts, k=5):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = re.findall(WS, (t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert got == brute_jaccard(texts)


def test_jaccard_join_chains_and_short_texts(spark):
    rng = random.Random(4)
    base = prose(rng, 90).split(" ")
    rows = {}
    for i in range(40):  # a chain: neighbours link, its ends do not
        base = base[:]
        base[rng.randrange(90)] = f"n{i}"
        rows[i] = " ".join(base)
    for i in range(40, 70):
        rows[i] = " ".join(["a", "b", "c", "d", "e", "f", "g", "h"][: 3 + i % 6] + (["z"] if i % 2 else []))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(frame(spark, rows.items())).collect()}
    assert got == brute_jaccard(rows)


def brute_links(texts, k=5):
    words = {i: re.findall(WS, (t or "").lower()) for i, t in texts.items()}
    sets = {i: {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} for i, w in words.items() if w}
    return {i: sum(i != j and i in sets and 100 * len(sets[i] & s) >= 75 * len(sets[i] | s) for j, s in sets.items()) for i in texts}


@pytest.mark.parametrize("rows,items", [(1024, 400_000), (3, 400_000), (1024, 250)])
def test_jaccard_join_counts_links_in_blocks_of_any_size(spark, monkeypatch, rows, items):
    monkeypatch.setattr(overlaps, "BLOCK_ROWS", rows)
    monkeypatch.setattr(overlaps, "BLOCK_ITEMS", items)
    rng = random.Random(8)
    texts, base = {}, prose(rng, 100).split(" ")
    for i in range(60):  # copies of one text with none to six changes: some pairs link, some do not
        own = base[:]
        for _ in range(rng.randrange(7)):
            own[rng.randrange(100)] = f"n{rng.randrange(40)}"
        texts[i] = " ".join(own)
    for i in range(60, 70):
        texts[i] = texts[i - 60]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(frame(spark, texts.items())).collect()}
    links = brute_links(texts)
    assert got == {i: (*x, links[i]) for i, x in brute_jaccard(texts).items()}


def test_common_items_of_blocks_by_both_ways():
    rng = np.random.default_rng(3)
    for n, vocab in ((2, 50), (30, 40), (80, 4000)):
        sets = [np.unique(rng.integers(0, vocab, rng.integers(1, 60))) for _ in range(n)]
        bounds = np.cumsum([0] + [len(x) for x in sets])
        a, b = np.arange(n // 2 + 1), np.arange(n // 3, n)
        want = [[len(set(sets[i]) & set(sets[j])) for j in b] for i in a]
        assert overlaps.common(np.concatenate(sets), bounds, a, b).tolist() == want
        cells = [overlaps.cells(kernel.mix(x.astype(np.uint64))) for x in sets]
        assert (overlaps.at_most([cells[i] for i in a], [cells[j] for j in b]) >= want).all()


def test_components_of_long_paths_and_repeats(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(50)] + [(5, 5), (None, 3), (7, 6)]
    rng.shuffle(pairs)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}}


def test_jaccard_join_odd(odd, none):
    got = jaccard_join.jaccard_classes(odd).collect()
    assert len(got) == 6
    assert {r["component_id"] for r in got if r["doc_id"] is None or r["doc_id"] == 2} == {None}  # the null id is smallest
    assert jaccard_join.jaccard_classes(none).count() == 0


def test_line_dedup(docs, odd, none, texts):
    got = {r["row"]["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.remove_boilerplate(docs, 6).collect()}
    sites, first = defaultdict(set), {}
    for i, t in sorted(texts.items()):
        for p, line in enumerate((t or "").split("\n")):
            if re.search(WS, line):
                sites[line].add(i % 20)
                first.setdefault(line, (i, p))
    for i, t in texts.items():
        lines = [] if t is None else t.split("\n")
        kept = [x for p, x in enumerate(lines) if len(sites[x]) < 6 or first[x] == (i, p)]
        assert got[i] == (len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept))
    assert line_dedup.remove_boilerplate(odd, 1).where("n_removed > 0").count() >= 1
    assert line_dedup.remove_boilerplate(none).count() == 0


def test_line_dedup_counts_near_the_threshold_exactly(spark):
    rows = [(i, f"line {k} stands here") for k in range(30) for i in range(k * 100, k * 100 + k + 1)]
    df = frame(spark, rows).withColumn("source", F.concat(F.lit("site"), F.col("doc_id").cast("string")))
    got = line_dedup.remove_boilerplate(df, 12).groupBy((F.col("row.doc_id") / 100).cast("int").alias("k")).agg(F.sum("n_removed").alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {k: (k if k + 1 >= 12 else 0) for k in range(30)}


def test_line_dedup_of_few_sites(spark, tmp_path):
    rows = [(k * 10 + i, f"line {k} stands here", f"site{i}") for k in range(4, 7) for i in range(k)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = line_dedup.op8_line_dedup_5_sites(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got if r["n_removed"]} == {k * 10 + i for k in (5, 6) for i in range(1, k)}


def paragraphs(t):
    return Counter(p.strip() for p in re.split(r"(?<=\n)|(?<=[.!?])(?= )", t) if re.search(WS, p))


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return sum((a & b).values()) / (sum((a | b).values()) or 1) if a or b else 1.0


def test_fingerprints(docs, odd, none, texts):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(docs, partition_bytes=20_000).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, n = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        e = fingerprints.edit(t, n)
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(t, e)) and r["near_next"] == pytest.approx(likeness(t, n))
    same = defaultdict(set)
    for i, t in texts.items():
        same[t or ""].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.fingerprint(odd).count() == 6 and fingerprints.fingerprint(none).count() == 0


def test_peeling_recovers_the_digests():
    a = fingerprints.Digests(["\n".join(f"p {i}" for i in range(400))])
    b = fingerprints.Digests(["\n".join(f"p {i}" for i in range(390)) + "\nnew one\nnew two"])
    at = np.zeros(1, dtype=np.int64)
    _, digest, side = fingerprints.differing(a, at, b, at)
    assert set(digest[side == 1]) == set(a.key) - set(b.key) and set(digest[side == -1]) == set(b.key) - set(a.key)


def test_licenses(spark, odd, none):
    rows = {
        0: "Text. This work is licensed under the GNU General Public License, version 3. More.",
        1: "licensed under the Apache Licence, Version 2.0",
        2: "permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files, the software, to deal in the software without restriction",
        3: "cc by cc by mit license", 4: "nothing of it", 5: None, 6: "",
    }
    out, spans = licenses.scan_licenses(frame(spark, rows.items()))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["base"] == ["gpl"] and got[0]["labels"] == ["gpl", "gpl-3"] and (got[0]["n_base"], got[0]["first_word"]) == (1, 7)
    assert got[1]["base"] == [] and got[2]["labels"] == ["mit-notice"] and 0.6 <= got[2]["score"] < 1
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (3, 0, 4)
    assert all(got[i]["labels"] == [] and got[i]["score"] == 0 for i in (4, 5, 6))
    assert {(r["doc_id"], r["first_word"], r["last_word"]) for r in spans.where("label = 'gpl-3'").collect()} == {(0, 1, 12)}
    assert licenses.scan_licenses(odd)[0].count() == 6 and licenses.scan_licenses(none)[0].count() == 0


def brute_figures(t):
    w = re.findall(WS, t or "")
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if re.search(WS, line):
            again += line in seen
            seen.add(line)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(covered)


def test_quality_rules(docs, odd, none, labels, texts, spark):
    got = {r["row"]["doc_id"]: r for r in quality_rules.apply_rules(docs, labels).collect()}
    for i, t in texts.items():
        f = brute_figures(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == f
        assert r["base_failed"] == (f[0] < 50 or 100 * f[4] > 50 * f[0]) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.apply_rules(odd, labels.limit(0)).agg(F.max(F.abs("llr")).alias("m")).first()["m"] == 0
    assert quality_rules.apply_rules(none, labels).count() == 0


def test_quality_ratio_tells_junk(spark):
    rng = random.Random(8)
    rows = {i: " ".join(prose(rng, 80).split(" ") if i % 4 else [f"{w}$$$" for w in prose(rng, 80).split(" ")]) for i in range(80)}
    good = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 80, 3)], "doc_id long, quality int")
    got = {r["row"]["doc_id"]: r["kept"] for r in quality_rules.apply_rules(frame(spark, rows.items()), good).collect()}
    assert all(got[i] == bool(i % 4) for i in rows)


def marked(seed, n=300):
    rng = random.Random(seed)
    rows, toxic, quality = {}, {}, {}
    for i in range(n):
        t = [prose(rng, 12) + "." for _ in range(rng.randrange(2, 9))]
        toxic[i], quality[i] = int(i % 3 == 0), int(i % 4 > 0)
        if toxic[i]:
            t[rng.randrange(len(t))] = f"{prose(rng, 4)} rotten{rng.choice('abcdefgh')} {prose(rng, 4)}."
        rows[i] = " ".join(t) if quality[i] else " ".join(t).replace(" ", "## ")
    return rows, toxic, quality


def test_classifiers_on_held_out_rows(spark, odd, none, labels):
    rows, toxic, quality = marked(5)
    df = frame(spark, rows.items())
    lab = spark.createDataFrame([(i, quality[i], toxic[i]) for i in rows], "doc_id long, quality int, toxic int")
    out = {i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r["row"]["doc_id"]: r for r in toxicity.score_toxicity(df, lab).collect()}
    right = [(got[i]["score"] >= 0.5) == bool(toxic[i]) for i in out]
    assert sum(right) / len(right) > 0.9
    found = [s["sentence"] for i in out if toxic[i] for s in got[i]["offending"]]
    assert found and sum("rotten" in s for s in found) / len(found) > 0.9
    got = {r["row"]["doc_id"]: r["score"] for r in quality_classifier.score_quality(df, lab).collect()}
    assert sum((got[i] >= 0.3) == bool(quality[i]) for i in out) / len(out) > 0.95
    for run in (toxicity.score_toxicity, quality_classifier.score_quality):
        assert run(none, lab).count() == 0 and run(df, lab.limit(0)).count() == len(rows)
        assert all(0 <= r["score"] <= 1 for r in run(odd, labels).collect())


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x = next(kernel.texts(pa.array(["a b c " * 60, "", "d e " * 100])))
    bags = quality_classifier.Bags(x)
    m = quality_classifier.fit([("a b", 1, 1.0), ("## #", 0, 1.0)], epochs=1)
    m = {k: np.asarray(v) + rng.normal(0, 0.1, np.shape(v)) for k, v in m.items()}
    y, v = np.array([1.0, 0.0, 1.0]), np.ones(3)
    loss = lambda: -np.mean([np.log(s if t else 1 - s) for s, t in zip(quality_classifier.forward(m, bags)[0], y)])
    grad = quality_classifier._gradient(m, bags, y, v)
    for name in ("W", "V", "U", "w", "c"):
        at = tuple(rng.integers(0, s) for s in np.shape(m[name]))
        m[name][at] += 1e-5
        up = loss()
        m[name][at] -= 2e-5
        down = loss()
        m[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grad[name][at], abs=1e-5)


def test_held_out_rule(spark):


    got = spark.range(200).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_pieces_do_not_depend_on_their_batch(spark, texts):
    rows = [(i, t) for i, t in texts.items() if t] + [(900 + i, " ".join(["if  x:", "   return  y"] * (i + 1))) for i in range(5)]
    got = []
    for parts, size in ((1, 10_000), (3, 2), (7, 11)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = pieces.encode(frame(spark, rows).repartition(parts))
        got.append({r["row"]["doc_id"]: list(r["ids"]) for r in out.collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == got[2]
    back = spark.createDataFrame(list(got[0].items()), "doc_id long, ids array<int>")
    assert {r["row"]["doc_id"]: r["text"] for r in pieces.decode(back).collect()} == dict(rows)


def test_pieces_with_inner_spaces_take_part():
    v = pieces.load()
    x = next(kernel.texts(pa.array([" if" + " " * 16 + "x"])))
    drawn = {i for k in range(60) for i in pieces.encode_run(x, np.array([k]), v)[0].tolist()}
    assert any(v.data[v.offsets[i] : v.offsets[i + 1]].tobytes().startswith(b"  ") for i in drawn)


def test_packing_of_token_ids_gives_whole_sequences(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(1000) for _ in range(rng.choice([0, 3, 40, 130]))]) for i in range(50)] + [(99, None)]
    encoded = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    placed = packing.pack_documents(encoded, (32, 64), 2, ids_col="ids")
    packed = {r["bin_id"]: r for r in packing.sequences(placed, encoded).collect()}
    parts = {}
    for r in placed.where("bin_id is not null").collect():
        one = packed[r["bin_id"]]
        assert len(one["ids"]) == one["n_tokens"] <= one["capacity"] == r["capacity"]
        parts.setdefault(r["doc_id"], []).append((r["piece"], one["ids"][r["start"] : r["start"] + r["n_tokens"]]))
    assert {i: [x for _, p in sorted(ps) for x in p] for i, ps in parts.items()} == {i: x for i, x in rows if x}


def test_packing_deals_repeated_rows_over_shards(spark):
    rows = spark.createDataFrame([(None, "a b c")] * 400, "doc_id long, text string").coalesce(1)
    key = [r["key"] for r in rows.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(packing._pieces(4096), packing.PIECE_SCHEMA).collect()]
    assert len(set(key)) == 400


def brute_spans(text, templates, k=3, slack=4, cover=0.6):
    """Labels and best cover of one text: the longest chain of equal windows over all pairs of places, both rising, steps shifted by `slack` at most."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = {}
    for label, template in templates:
        t = template.split(" ")
        pairs = [(i, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k]]
        best = []
        for i, j in pairs:
            best.append(1 + max((b for b, (p, q) in zip(best, pairs) if p < i and q < j and abs((i - j) - (p - q)) <= slack), default=0))
        share = max(best, default=0) / (len(t) - k + 1)
        if share >= cover:
            out[label] = share
    return out


def test_noisy_or_by_hand():
    """Scores of texts out of their sentences' logits, word by word, and folds that see only their own rows."""
    rng = random.Random(3)
    rows, toxic, _ = marked(6, 120)
    train = [(rows[i], toxic[i], 1.0) for i in rows]
    m = toxicity.fit(train, epochs=5)
    for i in range(0, 120, 7):
        none = 1.0
        for sentence in re.split(r"\n|(?<=[.!?]) ", rows[i]):
            z, some = m.bias, False
            for w in re.findall(r"[a-z0-9]+", sentence.lower()):
                x = next(kernel.texts(pa.array([w]), kernel.ALNUM, True))
                s, some = toxicity.Sentences(x), True
                z += sum(m.weights[f] for f in s.feats[0] if f >= 0)
            none *= 1 - 1 / (1 + np.exp(-z)) if some else 1
        assert toxicity.probabilities(m, [rows[i]])[0] == pytest.approx(1 - none, abs=1e-9)
    loss, recall = toxicity.fold_loss(train, {"epochs": 30})
    shuffled = [(t, rng.choice([0, 1]), v) for t, _, v in train]
    assert loss < 0.5 and recall > 0.5 and toxicity.fold_loss(shuffled, {"epochs": 10})[0] > loss


def test_licenses_need_their_words_in_order(spark):
    """Windows of a notice in reverse or shuffled order, or spread over a long text, are no notice; a sibling's notice is its own only."""
    rng = random.Random(4)
    windows = {label: [" ".join(t.split(" ")[i : i + 3]) for i in range(len(t.split(" ")) - 2)] for label, t in licenses.TEMPLATES}
    rows = {}
    for n, (_label, w) in enumerate(windows.items()):
        rows[n] = " ".join(reversed(w))
        rows[100 + n] = " ".join(rng.sample(w, len(w)))
        rows[200 + n] = " ".join(x + " " + prose(rng, 9) for x in w)
        rows[300 + n] = f"{prose(rng, 20)} {licenses.TEMPLATES[n][1]} {prose(rng, 20)}"
    out, _ = licenses.scan_licenses(frame(spark, rows.items()))
    got = {r["doc_id"]: set(r["labels"]) - set(r["base"]) for r in out.collect()}
    for n, (label, w) in enumerate(windows.items()):
        want = [set(brute_spans(rows[i + n], licenses.TEMPLATES)) for i in (0, 100, 200, 300)]
        assert [got[i + n] for i in (0, 100, 200, 300)] == want
        assert want[3] == {label} and want[2] == set()
        assert len(w) < 9 or not want[0]  # the shortest notices repeat themselves by two windows
    bsd = [label for label, _ in licenses.TEMPLATES].index("bsd")
    assert got[bsd] == got[100 + bsd] == set()


def test_licence_chains():
    at, place = np.array([0, 1, 2, 9, 10, 11, 30, 31]), np.array([0, 1, 2, 0, 1, 2, 2, 0])
    assert licenses.chains(at, place, 3, 4, 0.6) == [(0, 2, 3), (9, 11, 3)]
    assert licenses.chains(at[::-1], place[::-1], 3, 4, 1.0) == [(0, 2, 3), (9, 11, 3)]
    assert licenses.chains(at[:0], place[:0], 3, 4, 0.6) == []
    assert licenses.chains(np.arange(9), np.arange(9)[::-1], 9, 4, 0.3) == []


def test_license_scan_by_brute_force(spark):
    rng = random.Random(12)
    rows = {}
    for i in range(120):
        t = prose(rng, rng.randrange(60)).split(" ")
        for label, notice in rng.sample(licenses.TEMPLATES, rng.randrange(3)):
            n = notice.split(" ")
            for _ in range(rng.randrange(4)):  # words changed, dropped or put in
                p = rng.randrange(len(n))
                n[p : p + rng.randrange(2)] = rng.choice([[], ["Other"], [n[p].upper()]])
            t += n + prose(rng, rng.randrange(9)).split(" ")
        rows[i] = " ".join(t)
    rows[120], rows[121] = None, " ".join([licenses.TEMPLATES[0][1]] * 3)
    out, spans = licenses.scan_licenses(frame(spark, rows.items()))
    want = {i: brute_spans(t, licenses.TEMPLATES) for i, t in rows.items()}
    assert any(want.values()) and not all(want.values())
    for r in out.collect():
        own = want[r["doc_id"]]
        assert r["labels"] == sorted(set(own) | set(r["base"]))
        assert r["score"] == pytest.approx(1.0 if r["n_base"] else max(own.values(), default=0.0))
    best = {(r["doc_id"], r["label"]): r["c"] for r in spans.groupBy("doc_id", "label").agg(F.max("cover").alias("c")).collect()}
    assert best == {(i, label): pytest.approx(c) for i, own in want.items() for label, c in own.items()}


def test_license_templates_come_from_a_folder_too(spark, tmp_path):
    (tmp_path / "My-License.txt").write_text("You may do all that you like, with this text; and nothing else!\nNo warranty is given.")
    rows = [(1, "well: you may do all that you like with this text and nothing else no warranty is given. bye"), (2, "nothing of it")]
    out, _ = licenses.scan_licenses(frame(spark, rows), licenses.templates_of(str(tmp_path)))
    assert {r["doc_id"]: r["labels"] for r in out.collect()} == {1: ["my-license"], 2: []}


def test_samples_are_bounded_in_rows_and_bytes(spark):
    rows = [(i, "x" * 100) for i in range(200)] + [(7, "other text of 7")] * 50
    y = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = labelled.sample(frame(spark, rows).select("doc_id", "text"), y, "quality", 50, 4_000)
    assert Counter(label for _, label, _ in got) == {0: 20, 1: 20}
    assert len(labelled.sample(frame(spark, rows).select("doc_id", "text"), y, "quality", 1000)) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(200))


def test_registered_queries_keep_their_contracts(spark, tmp_path, docs, labels):
    """Columns, hold-out, thresholds and one row per document of the opN_ wrappers."""
    from sparkloom.llm import registry

    d = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    want = {
        "op1_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op4_quality_classifier": {"doc_id", "held_out", "score", "predicted"}, "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op6_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}, "op7_jaccard_join": {"doc_id", "n_shingles", "component_id"}, "op2_sentencepiece": {"doc_id", "ids"},
        "op9_document_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
        "op10_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    }
    n = docs.count()
    for name, columns in want.items():
        rows = registry.QUERIES[name](spark, d).collect()
        assert len(rows) == n and columns <= set(rows[0].asDict()), name
        if "held_out" in columns:
            least = 0.3 if name.startswith("op4") else 0.5
            for r in rows:
                assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
    assert registry.QUERIES["op3_best_fit_packing"](spark, d).select("doc_id").distinct().count() == n
