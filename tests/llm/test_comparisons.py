"""Embedding near-dedup, snapshot difference and source divergence against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import embedding_caps, snapshot_diff, source_divergence

VECTORS = "vec_id long, embedding array<float>, label int, rep long, weight long, id string, filters int, node int, v int, h int"
DOCS = "doc_id long, text string, lang string, source string, term string, n int, side int, key string, nth int, c0 int"


def vectors(spark, rows, double=False):
    schema = VECTORS.replace("float", "double") if double else VECTORS
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", 4, 5, 6, 7) for i, v in rows], schema).repartition(3)


def near_by_hand(rows, cosine=0.95):
    """{(id, vector): (links, component)} by all pairs of rows."""
    good = []
    for i, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if ok else None)
    at = {}
    for n, (i, _) in enumerate(rows):
        at.setdefault(i, []).append(n)
    label = [i for i, _ in rows]
    linked = defaultdict(set)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and good[a] is not None and good[b] is not None and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                linked[a].add(b)
    moved = True
    while moved:
        moved = False
        for a in range(len(rows)):
            for b in [*linked[a], *(x for x in at[rows[a][0]] if good[a] is not None and good[x] is not None)]:
                if label[b] < label[a]:
                    label[a], moved = label[b], True
    return linked, label


def clustered(seed, dim=16, clusters=12, each=9, alone=60):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(clusters):
        centre = rng.standard_normal(dim)
        out += [centre + rng.standard_normal(dim) * 0.22 for _ in range(each)]
    out += list(rng.standard_normal((alone, dim)))
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(out)), out, strict=True)]


@pytest.mark.parametrize("double", [False, True])
def test_near_vectors_by_brute_force(spark, double):
    rows = clustered(3)
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, [x * 4 for x in rows[5][1]])]
    linked, label = near_by_hand(rows)
    got = {r["vec_id"]: r for r in embedding_caps.near_duplicates(vectors(spark, rows, double)).collect()}
    assert len(got) == len(rows)
    want = sum(map(len, linked.values()))
    assert want > 300
    assert sum(r["n_links"] for r in got.values()) == want  # this many filters miss nothing here
    for n, (i, _) in enumerate(rows):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(linked[n]), label[n], label[n] == i)


def test_near_vectors_recall_at_the_threshold():
    """Of pairs whose cosine is just 0.95, at least 95 in 100 share a filter; the list of a vector holds what exceeds its threshold."""
    rng = np.random.default_rng(1)
    code = embedding_caps.Code(64, 50_000)
    x, z = rng.standard_normal((2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    lists = []
    for part in (x, y):
        own = [set() for _ in part]
        for r, f in zip(*code.decode(part), strict=True):
            own[r].add(int(f))
        lists.append(own)
    assert np.mean([bool(a & b) for a, b in zip(*lists, strict=True)]) >= 0.95
    # list decoding finds exactly the directions above alpha
    scores = [(x @ code.rotation)[:, lo:hi] @ c.T for lo, hi, c in zip(code.cuts[:-1], code.cuts[1:], code.codes, strict=True)]
    full = (scores[0][:, :, None] + scores[1][:, None, :]).reshape(len(x), -1)
    for i in range(200):
        above = set(np.flatnonzero(full[i] >= code.alpha))
        assert lists[0][i] == above if len(above) >= code.least else lists[0][i] > above


def test_near_vectors_across_blocks(spark, monkeypatch):
    """A group larger than a block, and one that shares many filters, counts each pair once."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(8)
    rows = [(i, [float(np.float32(x)) for x in centre + rng.standard_normal(8) * 0.02]) for i in range(90)]
    monkeypatch.setattr(embedding_caps, "BLOCK", 20)
    got = embedding_caps.near_duplicates(vectors(spark, rows)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(89, 0)}


def test_near_vectors_in_rounds(spark, monkeypatch):
    """Filters that travel in several rounds and buckets, packed by a few at once, some of them hot, give the same links; so do vectors of several lengths."""
    for name, value in (("ROUND", 500), ("BUCKET", 64), ("HELD", 100), ("BLOCK", 12)):
        monkeypatch.setattr(embedding_caps, name, value)
    rows = clustered(6) + [(2000 + i, v) for i, v in clustered(7, dim=9, clusters=3, alone=5)]
    linked, label = near_by_hand(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_caps.near_duplicates(vectors(spark, rows)).collect()}
    assert got == {i: (len(linked[n]), label[n]) for n, (i, _) in enumerate(rows)}


def test_near_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (11, [0.0, 5.0]), (12, [-1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_caps.near_duplicates(vectors(spark, rows)).collect()}
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 9, 12):
        assert got[i] == (0, i, True)
    assert got[None] == (1, None, True) and got[11] == (1, None, False)
    # an id with two vectors is one node, each row with its own links
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.01]), (3, [1.0, 0.01])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_caps.near_duplicates(vectors(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 1, 1)]
    assert embedding_caps.near_duplicates(vectors(spark, [])).collect() == []
    big = [(1, [1e300, 1e300]), (2, [2e300, 2e300]), (3, [1e-300, 1e-300])]
    assert {r["n_links"] for r in embedding_caps.near_duplicates(vectors(spark, big, True)).collect()} == {2}


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "k", 3, 4) for r in rows], DOCS).repartition(3)


def diff_by_hand(old, new):
    columns = ("text", "lang", "source")
    changed = lambda a, b: ",".join(c for c, x, y in zip(columns, a[1:], b[1:], strict=True) if x != y)
    sha = lambda r: hashlib.sha256("\n".join("~" if x is None else x for x in r[1:]).encode()).hexdigest()
    out, left, right = [], {r[0]: r for r in old}, {r[0]: r for r in new}
    for k in left.keys() & right.keys():
        what = changed(left[k], right[k])
        out.append((k, k, "update" if what else "same", what, sha(right[k])))
    groups = defaultdict(lambda: ([], []))
    for k in left.keys() - right.keys():
        groups[left[k][1]][0].append(left[k])
    for k in right.keys() - left.keys():
        groups[right[k][1]][1].append(right[k])
    for a, b in groups.values():
        a.sort()
        b.sort()
        n = min(len(a), len(b))
        out += [(y[0], x[0], "rekey", changed(x, y), sha(y)) for x, y in zip(a[:n], b[:n], strict=True)]
        out += [(x[0], x[0], "delete", "", None) for x in a[n:]] + [(y[0], None, "insert", "", sha(y)) for y in b[n:]]
    return sorted(out, key=repr)


def difference(old, new):
    return sorted((tuple(r) for r in snapshot_diff.difference(old, new, ["text", "lang", "source"]).collect()), key=repr)


def snapshots(seed, n=400):
    """Half of all texts are one text; some are null or empty."""
    rng = random.Random(seed)
    old = [(i, rng.choice(["same"] * 6 + [None, "", f"t{rng.randrange(40)}", f"u{i}", "long " * 5000]), rng.choice(["en", None, "de"]), rng.choice(["a", None])) for i in range(n)]
    new = []
    for r in old:
        what = rng.randrange(6)
        if what == 1:
            new.append((r[0], (r[1] or "") + "+", *r[2:]))
        elif what == 2:
            new.append((-1 - r[0], r[1], r[2], None))
        elif what:
            new.append(r)
            if what == 3:
                new.append((-1 - r[0], *r[1:]))
    return old, new


@pytest.mark.parametrize("worth", [2000, 20])
def test_difference_by_brute_force(spark, monkeypatch, worth):
    monkeypatch.setattr(snapshot_diff, "WORTH", worth)
    monkeypatch.setattr(snapshot_diff, "RANGE_ROWS", worth)
    spark.conf.set("spark.sql.shuffle.partitions", "16" if worth == 20 else "4")
    old, new = snapshots(worth)
    try:
        assert difference(documents(spark, old), documents(spark, new)) == diff_by_hand(old, new)
        rows = documents(spark, old).select("doc_id", "text", F.lit(1).alias("side"), (F.col("doc_id") * 7 % 400).alias("rid"), F.lit(5).cast("long").alias("one"))
        got = snapshot_diff.numbered(rows, ["text"], "doc_id", "nth").collect()
        # one value of the order, and none, hold all rows: their ranges go by rid
        same = {c: sorted(r["nth"] for r in snapshot_diff.numbered(rows.withColumn(c, e), ["side"], c, "nth").collect()) for c, e in (("one", F.lit(5).cast("long")), ("none", F.lit(None).cast("long")))}
        ranges = {c: snapshot_diff._in_ranges(rows.withColumn(c, e), c, 400).agg(F.count_distinct("range")).first()[0] for c, e in (("one", F.lit(5).cast("long")), ("none", F.lit(None).cast("long")))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(v == list(range(1, 401)) for v in same.values()) and min(ranges.values()) > 10
    seen = defaultdict(list)
    for r in sorted(got, key=lambda r: r["doc_id"]):
        seen[r["text"]].append(r["nth"])
    assert all(v == list(range(1, len(v) + 1)) for v in seen.values()) and len(seen["same"]) > 100


def test_difference_edges(spark):
    one = documents(spark, [(1, "a", "en", "s"), (None, None, None, None)])
    none = documents(spark, [])
    assert difference(none, none) == []
    assert [r[2] for r in difference(one, none)] == ["delete", "delete"]
    assert sorted(r[2] for r in difference(none, one)) == ["insert", "insert"]
    assert {r[2] for r in difference(one, one)} == {"same"}
    # nulls equal only nulls
    got = difference(documents(spark, [(1, None, "en", "s"), (2, "", "en", "s")]), documents(spark, [(1, "", "en", None), (7, None, "en", "s")]))
    assert [r[:4] for r in got] == [(1, 1, "update", "text,source"), (2, 2, "delete", ""), (7, None, "insert", "")]
    # repeated keys pair one by one, the rest is left over
    got = difference(documents(spark, [(1, "a", "en", "s")] * 3), documents(spark, [(1, "a", "en", "s"), (1, "b", "en", "s")]))
    assert sorted((r[2], r[3]) for r in got) == [("delete", ""), ("same", ""), ("update", "text")]


def test_later_snapshot(spark):
    rows = [(i, None if i % 50 == 0 else f"t{i}", "en", f"s{i % 3}") for i in range(200)]
    want = []
    for i, t, lang, s in rows:
        rule = zlib.crc32(str(i).encode()) % 16
        if rule == 1:
            want.append((i, (t or "") + "+", lang, s))
        elif rule == 2:
            want.append((i, t, s, lang))
        elif rule in (3, 4):
            want.append((-1 - i, t, lang, s if rule == 3 else None))
        elif rule:
            want.append((i, t, lang, s))
            if rule == 5:
                want.append((-1 - i, t, lang, s))
    got = [tuple(r) for r in snapshot_diff.later(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def audit_by_hand(rows, min_docs, top):
    rows = [tuple(x or "" for x in r[1:]) for r in rows]
    words = [(lang, s, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))) for t, lang, s in rows]
    out = []
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        df = Counter(t for w in own for t in w[2])
        kept = sorted(t for t in df if df[t] >= min_docs)
        groups = sorted({w[1] for w in own})
        count = {g: {t: sum(w[2][t] for w in own if w[1] == g) for t in kept} for g in groups}
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))
        whole = {t: sum(count[g][t] for g in groups) for t in kept}
        p = {g: {t: share(count[g][t], sum(count[g].values())) for t in kept} for g in groups}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for g in groups:
            pairs = [(sum(abs(p[g][t] - p[h][t]) for t in kept), h) for h in groups if h != g]
            terms = [(p[g][t] - q[t], t) for t in kept if count[g][t] and p[g][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, g, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def sourced(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in ("", "x", "é", "ß", "漢", "Z")]
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 4 + ["s1", "s2", None, "ünï"])
        text = " ".join(rng.choice(vocab[: 20 if source == "s1" else None]) + rng.choice(["", "1", "'", "-"]) for _ in range(rng.randrange(40)))
        rows.append((i, rng.choice([None, "", text, text, text]), rng.choice(["en", "de", None]), source))
    return [*rows, (n, "word " * 20_000, "en", "s1"), (n + 1, "alone", "fr", "s1"), (n + 2, "alone", "fr", "s2"), (3, "a b", "en", "s1"), (n + 3, "", "it", "none")]


@pytest.mark.parametrize(("spread", "matrix"), [(256, 1024), (1, 2)])
def test_audit_by_brute_force(spark, monkeypatch, spread, matrix):
    """Also with every term dealt over several tasks, and with pairs that do not fit into one matrix."""
    monkeypatch.setattr(source_divergence, "MATRIX_GROUPS", matrix)
    monkeypatch.setattr(source_divergence, "CHUNK_CELLS", 1 << (20 if spread > 1 else 6))
    monkeypatch.setattr(source_divergence, "BLOCK_BYTES", 1 << (23 if spread > 1 else 9))
    rows = sourced(spread)
    got = source_divergence.audit(documents(spark, rows), min_docs=8, top=7, spread=spread)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == audit_by_hand(rows, 8, 7)


def test_audit_edges(spark):
    assert source_divergence.audit(documents(spark, [])).collect() == []
    got = source_divergence.audit(documents(spark, [(1, None, None, None), (2, "a", "en", "x"), (2, "a", "en", "y")]))
    assert sorted(map(tuple, got.collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert source_divergence._shares(np.array([2**61]), np.array([2**62]), 10)[0] == 1 + 10**9 * (2**61 + 5) // (2**62 + 50)
