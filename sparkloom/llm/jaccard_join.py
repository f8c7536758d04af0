"""N-gram Jaccard join: a size-aware heavy-light join of word shingle sets.

Two sets link when 100 * |A n B| >= 100 * t * |A u B| (t = 0.75), that is, when they share at least
o = ceil(t / (1 + t) * (|A| + |B|)) shingles. Equal sets are one class from the start.

Light sets (at most x shingles) are enumerated: every 2-subset of the rarest |A| - ceil(t |A|) + 2 shingles is a
key, and light sets that link share one. Heavy sets scan inverted lists: every set that a heavy one can link
with lists its rarest |A| - ceil(t |A|) + 1 shingles, and pairs with a heavy side share one of them. The
boundary x is the one of least estimated cost. "Rarest" follows one global order: by the cell of a count table over all
documents, then by hash. Any order gives the same links; this one keeps common passages out of the lists.

Pairs of a list are never rows. Each entry meets a pivot of its list, and components follow. Then the whole sets of
lists that still touch several components meet in blocks of bounded size, where all pairs of different components are
compared by matrix products and only spanning ties come out; a pair inside a component cannot change it, so no
link is lost. Counts of items in hash cells, an upper bound of what two sets share, go first, so that whole sets
travel only where they can link. The same blocks, over the sets of each component, count every set's links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernel as K
from sparkloom.llm import overlaps as O
from sparkloom.llm.components import components
from sparkloom.llm.sketches import SLICES, gathered
from sparkloom.llm.storage import bucket_bits, forget, materialize

NULL_ID = -(2**63)
SKETCH_BITS = 20
LADDER = (0, 2, 4, 8, 12, 16, 24, 32, 48, 64)
UNIT_POSTINGS = 500_000
_PROFILE = pa.schema([("slice", pa.int32()), ("counts", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
PROFILE_SCHEMA = "slice int, counts binary, id long, n long, s1 long, s2 long"
_POST = pa.schema([("bucket", pa.int64()), ("sets", pa.binary()), ("tags", pa.binary()), ("places", pa.binary())])
POST_SCHEMA = "bucket long, sets binary, tags binary, places binary"
_ENTRY = pa.schema([("list", pa.int64()), ("kind", pa.int32()), ("sig", pa.int64()), ("size", pa.int64()), ("place", pa.int32()), ("pivot", pa.int64())])
ENTRY_SCHEMA = "list long, kind int, sig long, size long, place int, pivot long"


class Sets:
    """Distinct shingle hashes of a run of texts, sorted within each text."""

    def __init__(self, x: K.Texts, k: int):
        docs = x.doc_of_word()
        words = x.words()
        g, at = K.grams(words, docs, k, 4)
        of = docs[at]
        counts = np.diff(x.bounds)
        for d in np.flatnonzero((counts > 0) & (counts < k)):  # the whole sequence is the one shingle
            own = words[x.bounds[d] : x.bounds[d + 1]]
            g = np.append(g, K.mix((own * K._GRAM[5, : len(own)]).sum(keepdims=True), int(len(own)) + 100))
            of = np.append(of, np.int32(d))
        order = np.lexsort((g, of))
        g, of = g[order], of[order]
        fresh = np.r_[True, (g[1:] != g[:-1]) | (of[1:] != of[:-1])][: len(g)]
        self.h, self.of = g[fresh], of[fresh]
        self.bounds = np.searchsorted(self.of, np.arange(x.n + 1))
        self.sizes = np.diff(self.bounds)
        both = np.empty((2, x.n), dtype=K.U64)
        for i in range(2):
            total = np.r_[K.U64(0), np.cumsum(K.mix(self.h, 7 + i))][self.bounds]
            both[i] = K.mix(total[1:] - total[:-1] + self.sizes.astype(K.U64), 9 + i)
        self.sig = both.view(np.int64)


def _ceil(a, b):
    return -(-a // b)


def needed(size: np.ndarray, pct: int) -> np.ndarray:
    """Least overlap of a set with any set that it links with."""
    return _ceil(pct * size, 100)


def overlap(a, b, pct: int):
    """Least overlap of two linked sets of these sizes."""
    return _ceil(pct * (a + b), 100 + pct)


def _profile(k: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some, held, count = np.zeros(1 << SKETCH_BITS, dtype=np.int64), False, [], 0
        for batch in batches:
            ids = K.column(batch, "id").to_numpy(zero_copy_only=False)
            parts = []
            for x in K.texts(K.column(batch, "text"), lower=True):
                s = Sets(x, k)
                held.append((s.h >> K.U64(64 - SKETCH_BITS)).astype(np.uint32))
                count += len(s.h)
                if count > len(table):
                    table += np.bincount(np.concatenate(held), minlength=len(table))
                    held, count = [], 0
                parts.append((s.sizes, *s.sig))
            if parts:
                some = True
                n, s1, s2 = (np.concatenate(p) for p in zip(*parts, strict=True))
                m = len(n)
                yield K.batch_of(_PROFILE, {"slice": [None] * m, "counts": [None] * m, "id": ids, "n": n, "s1": s1, "s2": s2})
        if held:
            table += np.bincount(np.concatenate(held), minlength=len(table))
        if some:
            parts = np.split(table, SLICES)
            yield K.batch_of(_PROFILE, {"slice": list(range(SLICES)), "counts": [K.pack(p) for p in parts], **{c: [None] * SLICES for c in ("id", "n", "s1", "s2")}})

    return profile


def boundary(histogram: dict[int, int], table: np.ndarray, pct: int) -> tuple[int, int]:
    """(x, number of keys that will be emitted): the boundary of least estimated cost.

    A light set costs its 2-subsets, a listed one its prefix, each entry being scanned against a list of the
    expected length F2 / F1 (from the count table, less what cells share by chance).
    """
    f1 = float(table.sum())
    load = max(0.0, float((table.astype(np.float64) ** 2).sum()) / f1 - f1 / len(table)) if f1 else 0.0
    best = None
    for x in LADDER:
        cost = keys = 0.0
        for size, count in histogram.items():
            prefix = size - int(_ceil(pct * size, 100)) + 1
            if 2 <= size <= x:
                keys += count * (prefix + 1) * prefix // 2
                cost += count * (prefix + 1) * prefix // 2
            if size > x * pct / 100 and size > 0:
                keys += count * prefix
                cost += count * prefix * (1 + load)
        if best is None or cost < best[0]:
            best = (cost, x, int(keys))
    return best[1], best[2]


def _post(k: int, x_light: int, pct: int, bits: int, ranks):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, rank = [], 0, ranks.value

        def flush() -> pa.RecordBatch:
            nonlocal held, count
            tag, light, place, doc = (np.concatenate([h[i] for h in held]) for i in range(4))
            base = np.cumsum([0] + [len(h[4]) for h in held])
            doc = doc + np.repeat(base[:-1], [len(h[3]) for h in held])
            sig, size = (np.concatenate([h[i] for h in held]) for i in (4, 5))
            # equal sets of a unit send one entry
            _, first = np.unique(sig, return_index=True)
            lead = np.zeros(len(sig), dtype=bool)
            lead[first] = True
            own = np.flatnonzero(lead[doc])
            tag, light, place, doc = tag[own], light[own], place[own], doc[own]
            bucket = (tag >> K.U64(64 - bits)).astype(np.int64) * 2 + light if bits else light.astype(np.int64)
            rows = []
            for b, at in K.by_bucket(bucket):
                d = doc[at]
                cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                sets = np.r_[sig[d[cuts]], size[d[cuts]].astype(np.int64), np.diff(np.r_[cuts, len(d)])]
                rows.append((b, K.pack(sets), K.pack((tag[at] >> K.U64(32 - bits)).astype(np.uint32)), K.pack(place[at].astype(np.uint16 if place.max() < 65536 else np.uint32).astype(np.uint32))))
            held, count = [], 0
            return K.batch_of(_POST, {f.name: [r[i] for r in rows] for i, f in enumerate(_POST)})

        for batch in batches:
            for x in K.texts(K.column(batch, "text"), lower=True):
                s = Sets(x, k)
                cell = rank[(s.h >> K.U64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((s.h, cell, s.of))
                h, of = s.h[order], s.of[order].astype(np.int64)
                place = np.arange(len(h)) - s.bounds[of]
                size = s.sizes[of]
                prefix = size - needed(size, pct) + 1
                listed = (place < prefix) & (100 * size > pct * x_light)
                parts = [(K.mix(h[listed], 11), np.zeros(int(listed.sum()), dtype=bool), place[listed], of[listed])]
                # 2-subsets of light sets, by distance of the two places
                few = np.flatnonzero((size <= x_light) & (size > 1) & (place <= prefix))
                if len(few):
                    hh, oo, pp = h[few], of[few], place[few]
                    for step in range(1, int(pp.max()) + 1):
                        same = oo[step:] == oo[:-step]
                        a, b = hh[:-step][same], hh[step:][same]
                        parts.append((K.mix(K.mix(a, 12) + b * K._GRAM[6, 0], 13), np.ones(len(a), dtype=bool), np.zeros(len(a), dtype=np.int64), oo[step:][same]))
                merged = [np.concatenate([p[i] for p in parts]) for i in range(4)]
                at = np.argsort(merged[3], kind="stable")
                held.append((*(m[at] for m in merged), s.sig[0], s.sizes))
                count += len(at)
                if count >= UNIT_POSTINGS:
                    yield flush()
        if held:
            yield flush()

    return post


def _partnered(t: np.ndarray, n: np.ndarray, p: np.ndarray, light: bool, x_light: int, pct: int) -> np.ndarray:
    """Entries of sorted lists that sizes and places allow to link with another entry of their list.

    Lists of up to 64 entries are tried pair by pair; longer ones are left as they are, which loses nothing.
    """
    starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])[: len(t)]
    run = np.diff(np.r_[starts, len(t)])
    keep = np.repeat(run > 64, run)
    for m in np.unique(run[(run > 1) & (run <= 64)]):
        own = starts[run == m]
        for lo in range(0, len(own), max(1, 1_000_000 // (m * m))):
            at = own[lo : lo + max(1, 1_000_000 // (m * m))][:, None] + np.arange(m)
            ok = fits(n[at][:, :, None], n[at][:, None, :], p[at][:, :, None], p[at][:, None, :], light, x_light, pct)
            ok[:, np.arange(m), np.arange(m)] = False
            keep[at] = ok.any(axis=2)
    return keep


def _lists(x_light: int, pct: int):
    """One bucket of keys: its lists of two or more different sets, named by a hash of their members.

    Sizes that can link differ by a third at most, so each size class of a list (a power of 4/3) has a pivot, the set
    whose key stands first among its own (the one with the fewest rare shingles), then the one of least mixed signature.
    Members meet the pivot of their class, pivots that of the next lower one. Were two lists to share a name, they
    would be searched as one.
    """

    def lists(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        sets = np.concatenate([K.unpack(b, np.int64).reshape(3, -1) for b in K.binaries(table, "sets")], axis=1)
        tag = np.concatenate([K.unpack(b, np.uint32) for b in K.binaries(table, "tags")])
        place = np.concatenate([K.unpack(b, np.uint32) for b in K.binaries(table, "places")]).astype(np.int64)
        at = np.repeat(np.arange(sets.shape[1]), sets[2])
        sig, size = sets[0][at], sets[1][at]
        order = np.lexsort((place, sig, tag))
        t, s = tag[order], sig[order]
        fresh = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])]
        order = order[fresh]
        t, s, n, p = tag[order], sig[order], size[order], place[order]
        some = _partnered(t, n, p, bool(bucket & 1), x_light, pct)
        t, s, n, p = t[some], s[some], n[some], p[some]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])[: len(t)]
        run = np.diff(np.r_[starts, len(t)])
        # near copies share most of their lists: lists of the same members are one, at the least of their places
        members = np.add.reduceat(K.mix(s.view(K.U64), 22), starts) if len(t) else np.empty(0, dtype=K.U64)
        members = K.mix(members + run.astype(K.U64), 23 + (bucket & 1))
        _, first, same = np.unique(members, return_index=True, return_inverse=True)
        of = np.repeat(np.arange(len(starts)), run)
        home = starts[first[same]][of] + np.arange(len(t)) - starts[of] if len(t) else of
        least = p.copy()
        np.minimum.at(least, home, p)
        own = np.flatnonzero(home == np.arange(len(t)))
        of, s, n, p = of[own], s[own], n[own], least[own]
        level = np.floor(np.log(n) / np.log(4 / 3)).astype(np.int64)
        order = np.lexsort((K.mix(s.view(K.U64), 21), p, level, of))
        of, s, n, p, level = (x[order] for x in (of, s, n, p, level))
        head = np.r_[True, (of[1:] != of[:-1]) | (level[1:] != level[:-1])][: len(of)]
        heads = np.flatnonzero(head)
        to = heads[np.cumsum(head) - 1] if len(of) else of
        to[heads] = np.r_[heads[:1], heads[:-1]]
        alone = (to == np.arange(len(of))) | (of[to] != of)
        met = ~alone & fits(n, n[to], p, p[to], bool(bucket & 1), x_light, pct)
        return pa.Table.from_batches([K.batch_of(_ENTRY, {"list": members.view(np.int64)[of], "kind": np.full(len(of), bucket & 1), "sig": s, "size": n, "place": p, "pivot": pa.array(s[to], mask=~met)})])

    return lists


def fits(n, n2, p, p2, light: bool, x_light: int, pct: int):
    """Whether sizes and places allow two entries of a list to link (and, of a scanned list, whether one set is heavy)."""
    ok = 100 * np.minimum(n, n2) >= pct * np.maximum(n, n2)
    return ok if light else ok & (np.maximum(n, n2) > x_light) & (np.minimum(n - p, n2 - p2) >= overlap(n, n2, pct))


def _whole(k: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sig", pa.int64()), ("cells", pa.binary()), ("set", pa.list_(pa.int64()))])
        for batch in batches:
            for x in K.texts(K.column(batch, "text"), lower=True):
                s = Sets(x, k)
                spread = [O.cells(s.h[lo:hi]) for lo, hi in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
                yield K.batch_of(schema, {"sig": s.sig[0], "cells": spread, "set": pa.ListArray.from_arrays(pa.array(s.bounds.astype(np.int32)), pa.array(s.h.view(np.int64)))})

    return whole


def _fit_in_list(x_light: int, pct: int):
    def may(table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size, place, kind = (table.column(c).to_numpy() for c in ("size", "place", "kind"))
        light = (kind[a] == 1)[:, None]
        x, y, p, q = size[a][:, None], size[b][None, :], place[a][:, None], place[b][None, :]
        return np.where(light, fits(x, y, p, q, True, x_light, pct), fits(x, y, p, q, False, x_light, pct))

    return may


def _star_groups(found: DataFrame, named: DataFrame) -> DataFrame:
    """The members of each pivot, in blocks, against the pivot. Only sizes decide which pairs may link."""
    pairs = found.where("pivot is not null").select("pivot", "sig", "size").distinct()
    many = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).select("pivot", O.chunks(F.col("n"), F.col("s")).alias("count"))
    placed = pairs.join(many, "pivot").select(F.xxhash64("pivot", F.pmod(F.hash("sig"), F.col("count"))).alias("grp"), "pivot", "sig", "size")
    members = placed.select("grp", F.lit(0).alias("side"), "sig", "size")
    heads = placed.groupBy("grp", F.col("pivot").alias("sig")).agg(F.max("size").alias("size")).select("grp", F.lit(1).alias("side"), "sig", "size")
    out = members.unionByName(heads).join(named.withColumnRenamed("rep", "comp"), "sig")
    return out.select("grp", F.lit(False).alias("inner"), "side", "sig", "comp", "size", F.lit(0).alias("place"), F.lit(1).alias("kind"))


def _open_groups(placed: DataFrame) -> DataFrame:
    """Entries of lists that touch several components, in blocks.

    Pairs of a list's largest component say nothing new, so its blocks meet those of the other members only; a list
    that fits into one block is one group.
    """
    shares = placed.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).groupBy("list")
    split = shares.agg(F.max(F.struct("n", "comp", "s")).alias("major"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    whole = O.chunks(F.col("n"), F.col("s")) == 1
    split = split.select(
        "list",
        F.when(~whole, F.col("major.comp")).alias("major"),
        F.when(whole, 1).otherwise(O.chunks(F.col("n") - F.col("major.n"), F.col("s") - F.col("major.s"))).alias("minors"),
        F.when(whole, 1).otherwise(O.chunks(F.col("major.n"), F.col("major.s"))).alias("majors"),
    )
    met = placed.join(split, "list").withColumn("is_major", F.coalesce(F.col("comp") == F.col("major"), F.lit(False)))
    kept = ("sig", "comp", "size", "place", "kind")
    minor = met.where(~F.col("is_major"))
    own = F.pmod(F.hash("sig"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors")))
    among = O.paired(minor, [F.col("list"), F.lit(0)], own, F.col("minors"), *kept)
    # a minor block meets every major block of its list
    cross = met.where("major is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_major"), F.col("minors")).otherwise(F.col("majors")) - 1)))
    i, j = F.when(F.col("is_major"), F.col("other")).otherwise(F.col("own")), F.when(F.col("is_major"), F.col("own")).otherwise(F.col("other"))
    across = cross.select(F.xxhash64("list", F.lit(1), i, j).alias("grp"), F.lit(False).alias("inner"), F.col("is_major").cast("int").alias("side"), *kept)
    return among.unionByName(across)


def _component_groups(nodes: DataFrame) -> DataFrame:
    """The sets of each component of three or more, in blocks; of two, each links with the other."""
    sizes = nodes.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).where("n > 2")
    met = nodes.join(sizes.select("comp", O.chunks(F.col("n"), F.col("s")).alias("count")), "comp")
    return O.paired(met, [F.col("comp")], F.pmod(F.hash("sig"), F.col("count")), F.col("count"), "sig", "size", "weight")


def jaccard_classes(docs: DataFrame, shingle: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every input row.

    Words are runs of characters other than space and U+0009..U+000D, A-Z lower-cased; a set holds the distinct
    `shingle`-word windows of a text, or its whole word sequence if shorter. component_id is the smallest id
    reachable by links of Jaccard similarity >= percent / 100; n_links tells with how many other documents this row's
    set links, equal ones included. Defined cases: texts that are null or have no words have size 0 and link with
    nothing; a null id takes part as the smallest id and is given back as null; rows that repeat an id are one node,
    each with its own size and links (for n_links, an id counts once for each different set); very long texts are sets
    like any other; ties of rank go by hash and change no result; an empty table gives an empty table; other columns
    are not read. Sets are known by 64-bit signatures in the lists and 128-bit ones in classes of equal sets.
    """
    base = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), docs[text_col].cast("string").alias("text"))
    profile = materialize(base.mapInArrow(_profile(shingle), PROFILE_SCHEMA), "profile")
    table = gathered(profile.where("slice is not null").select("slice", "counts"), (1 << SKETCH_BITS,))
    sizes = profile.where("slice is null").select("id", "n", "s1", "s2")
    classes = materialize(sizes.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count_distinct("id").alias("weight")), "classes")
    histogram = {r["n"]: r["c"] for r in classes.where(F.col("n") <= 2 * LADDER[-1]).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    rest = classes.where(F.col("n") > 2 * LADDER[-1]).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).alias("k")).first()
    x_light, keys = boundary(histogram, table, percent)
    keys += int(rest["k"] or 0)

    # the count table has a fixed size (2^20 cells, 4 MB), whatever the corpus
    ranks = docs.sparkSession.sparkContext.broadcast(np.minimum(table, 2**32 - 1).astype(np.uint32))
    posts = base.mapInArrow(_post(shingle, x_light, percent, bucket_bits(keys, 1_500_000), ranks), POST_SCHEMA)
    found = posts.groupBy("bucket").applyInArrow(_lists(x_light, percent), ENTRY_SCHEMA)
    # lists of the same members in several buckets are one, at the least of their places
    lists = found.groupBy("list", "kind", "sig", "size").agg(F.min(F.struct("place", "pivot")).alias("at"))
    entries = materialize(lists.select("list", "kind", "sig", "size", F.col("at.place").alias("place"), F.col("at.pivot").alias("pivot")), "lists")

    # the sets of all entries, in whole
    reps = classes.select(F.col("s1").alias("sig"), "rep").join(entries.select("sig").distinct().hint("merge"), "sig", "left_semi").select("rep").distinct()
    texts = base.join(reps.hint("merge"), base["id"] == reps["rep"], "left_semi").select("text")
    sets = materialize(texts.mapInArrow(_whole(shingle), "sig long, cells binary, set array<long>"), "sets")

    may = _fit_in_list(x_light, percent)
    named = classes.select(F.col("s1").alias("sig"), "rep")
    stars = materialize(_star_groups(entries, named), "stars")
    near = materialize(O.screened(stars, sets, percent, may), "near")
    labels = components(materialize(O.compared(near, sets, O.ties(percent, may), O.TIE_SCHEMA), "links"))
    known = named.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("comp"))
    open_ = materialize(_open_groups(entries.select("list", "kind", "sig", "size", "place").join(known, "sig")), "open")
    left = materialize(O.screened(open_, sets, percent, may), "left")
    more = materialize(O.compared(left, sets, O.ties(percent, may), O.TIE_SCHEMA), "ties")
    # what the first links connect is known: the new ties join components
    links = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    labels = components(links)
    forget(entries, stars, near, open_, left)

    # links of each set: all lie inside its component
    nodes = classes.select(F.col("s1").alias("sig"), "rep", F.col("n").alias("size"), "weight").join(labels.withColumnRenamed("node", "rep"), "rep").select("sig", "size", "weight", F.col("component").alias("comp"))
    groups = materialize(_component_groups(nodes), "groups")
    counted = O.compared(groups, sets, O.degrees(percent), O.DEGREE_SCHEMA)
    twos = nodes.groupBy("comp").agg(F.sum("weight").alias("both"), F.count(F.lit(1)).alias("n")).where("n = 2").select("comp", "both")
    counted = counted.unionByName(nodes.join(twos, "comp").select("sig", (F.col("both") - F.col("weight")).alias("links")))
    linked = materialize(counted.groupBy(F.col("sig").alias("s1")).agg(F.sum("links").alias("links")), "degrees")
    forget(sets, groups)

    own = sizes.where("n > 0").join(classes.select("s1", "s2", "rep", "weight"), ["s1", "s2"])
    # a node is a class; ids that repeat with other texts tie their classes together
    least = own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a <> most").select("id", "a")
    tied = materialize(own.join(least, "id").select("a", F.col("rep").alias("b")).where("a <> b"), "tied")
    if not tied.isEmpty():
        labels = components(links.unionByName(tied))
    out = own.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(linked, "s1", "left")
    out = out.select("id", "n", F.coalesce("component", "rep").alias("c"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = out.unionByName(sizes.where("n = 0").select("id", "n", F.col("id").alias("c"), F.lit(0).cast("long").alias("links")))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("c").alias("component_id"), F.col("links").alias("n_links"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components and numbers of links of all documents at 5-word shingles and Jaccard 0.75."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
