"""Exact overlaps of sets inside groups: blocks of bounded size, and the spanning ties or degrees they give.

A group is a block of sets to compare with each other (`inner`), or two blocks to compare with one another (`side`
0 and 1). Every block holds at most about BLOCK_ROWS sets and BLOCK_ITEMS items (a larger set stands alone), so
a hot group is many blocks dealt over many tasks, and only ties or counts leave a task, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernel as K

BLOCK_ROWS = 1024
BLOCK_ITEMS = 400_000
BUCKET_ITEMS = 1_000_000
TIE_SCHEMA = "a long, b long"
DEGREE_SCHEMA = "sig long, links long"
_TIE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_DEGREE = pa.schema([("sig", pa.int64()), ("links", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties (node, least node of its component) that connect what the ties (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        u, v = label[x], label[y]
        if (u == v).all():
            break
        least = np.minimum(u, v)
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _items(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, item) of each item of some sets."""
    n = bounds[rows + 1] - bounds[rows]
    of = np.repeat(np.arange(len(rows)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[rows], n)
    return of, values[at]


def common(values: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many items each set of `a` has in common with each of `b`: a matrix, from the items that both sides hold.

    Items that few sets hold add their pairs one by one, frequent ones by products of 0/1 matrices; the counts are the same.
    """
    na, nb = len(a), len(b)
    ra, ta = _items(values, bounds, a)
    rb, tb = _items(values, bounds, b)
    _, at = np.unique(np.concatenate([ta, tb]), return_inverse=True)
    ia, ib = at[: len(ta)], at[len(ta) :]
    fa, fb = np.bincount(ia, minlength=len(at)), np.bincount(ib, minlength=len(at))
    total = np.zeros(na * nb, dtype=np.int64)
    dense = (fa > 0) & (fb > 0) & (fa * fb * 100 >= na * nb)
    few = (fa > 0) & (fb > 0) & ~dense
    # items of few sets: each place in `a` meets the item's places in `b`
    own, other = np.flatnonzero(few[ia]), np.flatnonzero(few[ib])
    other = other[np.argsort(ib[other], kind="stable")]
    first = np.searchsorted(ib[other], ia[own])
    times = fb[ia[own]]
    ends = np.cumsum(times)
    lo = 0
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, "right")))
        n = times[lo:hi]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        met = rb[other[np.repeat(first[lo:hi], n) + step]]
        total += np.bincount(np.repeat(ra[own[lo:hi]], n) * nb + met, minlength=na * nb)
        lo = hi
    # frequent items: slices of columns
    column = np.cumsum(dense) - 1
    wide = int(dense.sum())
    if wide:
        product = np.zeros((na, nb), dtype=np.float32)
        da, db = dense[ia], dense[ib]
        ca, cb, xa, xb = column[ia[da]], column[ib[db]], ra[da], rb[db]
        step = max(64, 8_000_000 // (na + nb))
        for lo in range(0, wide, step):
            p, q = (ca >= lo) & (ca < lo + step), (cb >= lo) & (cb < lo + step)
            left, right = np.zeros((na, min(step, wide - lo)), dtype=np.float32), np.zeros((nb, min(step, wide - lo)), dtype=np.float32)
            left[xa[p], ca[p] - lo] = 1
            right[xb[q], cb[q] - lo] = 1
            product += left @ right.T
        total += product.astype(np.int64).reshape(-1)
    return total.reshape(na, nb)


def _blocks(table: pa.Table) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(inner, rows of side 0, rows of side 1) of each group; repeated sets of a side count once."""
    grp, side, sig = (table.column(c).to_numpy() for c in ("grp", "side", "sig"))
    inner = table.column("inner").to_numpy()
    order = np.lexsort((sig, side, grp))
    g, d, s = grp[order], side[order], sig[order]
    order = order[np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])]]
    cuts = np.flatnonzero(np.diff(grp[order])) + 1
    for rows in np.split(order, cuts):
        if inner[rows[0]]:
            yield True, rows, rows
        else:
            yield False, rows[side[rows] == 0], rows[side[rows] == 1]


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    array = table.column("set").combine_chunks()
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    return array.values.to_numpy(), array.offsets.to_numpy().astype(np.int64)


def _linked(table: pa.Table, values: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray, ok: np.ndarray, pct: int) -> np.ndarray:
    size = np.diff(bounds)
    keep_a, keep_b = ok.any(axis=1), ok.any(axis=0)
    out = np.zeros(ok.shape, dtype=bool)
    if keep_a.any():
        x, y = a[keep_a], b[keep_b]
        both = common(values, bounds, x, y)
        out[np.ix_(keep_a, keep_b)] = 100 * both >= pct * (size[x][:, None] + size[y][None, :] - both)
    return out & ok


def cells(h: np.ndarray) -> bytes:
    """How many items fall into each of 2^k cells, a byte each, 2^k being over their number; empty if a cell overflows."""
    bits = min(16, int(len(h)).bit_length())
    counts = np.bincount((h & K.U64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _folded(rows: np.ndarray, m: int) -> np.ndarray:
    return rows if rows.shape[1] == m else rows.reshape(len(rows), -1, m).sum(axis=1, dtype=np.uint16)


def at_most(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Upper bounds of the common items of each set of `left` with each of `right`: in a cell at most the lesser count is common."""
    out = np.full((len(left), len(right)), 1 << 40)
    by = [{m: np.flatnonzero([len(x) == m for x in side]) for m in {len(x) for x in side if x}} for side in (left, right)]
    for m, i in by[0].items():
        u = np.frombuffer(b"".join(left[x] for x in i), dtype=np.uint8).reshape(-1, m)
        for n, j in by[1].items():
            v = np.frombuffer(b"".join(right[x] for x in j), dtype=np.uint8).reshape(-1, n)
            p, q = _folded(u, min(m, n)), _folded(v, min(m, n))
            for x, row in zip(i, p, strict=True):
                out[x, j] = np.minimum(row, q).sum(axis=1, dtype=np.int64)
    return out


def _candidates(table: pa.Table, inner: bool, a: np.ndarray, b: np.ndarray, may) -> np.ndarray:
    comp = table.column("comp").to_numpy()
    ok = comp[a][:, None] != comp[b][None, :]
    if inner:
        ok &= np.arange(len(a))[:, None] < np.arange(len(a))
    return ok & may(table, a, b)


def screen(pct: int, may, columns: list[str]):
    """Kernel of one bucket of groups: the rows whose cell counts allow a link with some other row of their group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        size, spread = table.column("size").to_numpy(), K.binaries(table, "cells")
        keep = np.zeros(len(table), dtype=bool)
        for inner, a, b in _blocks(table):
            ok = _candidates(table, inner, a, b, may)
            a, b, ok = a[ok.any(axis=1)], b[ok.any(axis=0)], ok[np.ix_(ok.any(axis=1), ok.any(axis=0))]
            if len(a):
                ok &= at_most([spread[x] for x in a], [spread[x] for x in b]) * (100 + pct) >= pct * (size[a][:, None] + size[b][None, :])
                keep[a[ok.any(axis=1)]] = True
                keep[b[ok.any(axis=0)]] = True
        return table.select(columns).filter(pa.array(keep))

    return run


def ties(pct: int, may):
    """Kernel of one bucket of groups: spanning ties between the components of linked sets of different ones.

    `may(table, a, b)` tells which pairs can link at all.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        values, bounds = _sets(table)
        comp = table.column("comp").to_numpy()
        found = []
        for inner, a, b in _blocks(table):
            ok = _candidates(table, inner, a, b, may)
            x, y = np.nonzero(_linked(table, values, bounds, a, b, ok, pct))
            found.append(forest(comp[a[x]], comp[b[y]]))
        u, v = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        u, v = forest(u, v)
        return pa.Table.from_batches([K.batch_of(_TIE, {"a": u, "b": v})])

    return run


def degrees(pct: int):
    """Kernel of one bucket of groups: the summed weight of the sets that each set links with."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        values, bounds = _sets(table)
        sig, weight = (table.column(c).to_numpy() for c in ("sig", "weight"))
        size = np.diff(bounds)
        total: list[tuple[np.ndarray, np.ndarray]] = []
        for inner, a, b in _blocks(table):
            x, y = size[a][:, None], size[b][None, :]
            ok = 100 * np.minimum(x, y) >= pct * np.maximum(x, y)
            if inner:
                ok &= ~np.eye(len(a), dtype=bool)
            linked = _linked(table, values, bounds, a, b, ok, pct)
            total.append((sig[a], linked @ weight[b]))
            if not inner:
                total.append((sig[b], weight[a] @ linked))
        return pa.Table.from_batches([K.batch_of(_DEGREE, {"sig": np.concatenate([t[0] for t in total]), "links": np.concatenate([t[1] for t in total])})])

    return run


def chunks(rows: Column, items: Column) -> Column:
    """Into how many blocks this many sets with this many items are dealt."""
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(items / BLOCK_ITEMS)).cast("int")


def paired(rows: DataFrame, name: list, own: Column, count: Column, *kept: str) -> DataFrame:
    """Each row in the groups that compare its block (number `own` of `count`) with every block of its kind, itself included."""
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return met.select(F.xxhash64(*name, lo, hi).alias("grp"), (F.col("own") == F.col("other")).alias("inner"), (F.col("own") > F.col("other")).cast("int").alias("side"), *kept)


def _bucketed(rows: DataFrame, sets: DataFrame, column: str, items: int):
    buckets = items // BUCKET_ITEMS + 1
    return rows.join(sets.select("sig", column).hint("merge"), "sig").withColumn("bucket", F.pmod(F.hash("grp"), F.lit(buckets))).groupBy("bucket")


def screened(rows: DataFrame, sets: DataFrame, pct: int, may) -> DataFrame:
    """The rows of groups that whole sets have to decide on: first only cell counts travel, a fraction of the sets' size."""
    return _bucketed(rows, sets, "cells", total(rows) // 4).applyInArrow(screen(pct, may, rows.columns), rows.schema)


def compared(rows: DataFrame, sets: DataFrame, kernel, schema: str) -> DataFrame:
    """The kernel's result over all groups of `rows` (grp, inner, side, sig, size, ...)."""
    return _bucketed(rows, sets, "set", total(rows)).applyInArrow(kernel, schema)


def total(rows: DataFrame) -> int:
    """How many items the sets of all rows hold together."""
    return int(rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"])
