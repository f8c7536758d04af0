"""Character alignment of least edits, then most matches, then most substitutions of one class.

The three criteria are one integer per cell, so a batch of pairs is one dynamic programme over padded arrays: rows
of all pairs advance together, and insertions along a row are a running minimum. Ties trace back from the end by
diagonal, delete, insert.

Only the cells that a path of least edits can touch are computed. A common end is read diagonally, as a match there is
never worse. An upper bound of the edits (places that differ, or what a greedy common subsequence leaves) limits how
far such a path strays from the diagonal. Paths, ties included, are those of the whole table. A pair whose only best path is the
diagonal (`straight`) is not computed at all.

`Steps` holds the steps of a batch as flat arrays, for counters that stay in numpy; `alignment` gives them as a column.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("r", T.StringType()), T.StructField("h", T.StringType())]))
#: Cells of one row of the dynamic programme, and of all its rows, over the pairs computed at once.
ROW_CELLS, BATCH_CELLS = 100_000, 10_000_000
#: Bands are grouped by width, so that pairs computed at once have about the same.
WIDTHS = np.unique(np.r_[1:9, (1.3 ** np.arange(8, 90)).astype(np.int64)])


def char_class(c: str) -> int:
    """0 space, 1 combining mark, 2 other."""
    return 0 if c.isspace() else 1 if unicodedata.category(c).startswith("M") else 2


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in a row, length of each text)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<i4"), np.fromiter(map(len, texts), np.int64, len(texts))


def column_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """code_points of an Arrow column of text without nulls, without a Python object per text; of one byte each where all are ASCII."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), pa.scalar("", column.type))[0].as_py()
    flat = np.frombuffer(whole.encode(), dtype=np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<i4")
    return flat, pc.utf8_length(column).to_numpy().astype(np.int64)


def per_point(points: np.ndarray, value, kind) -> np.ndarray:
    """value(code point) of each, asked once per different one; 0 for -1."""
    table = np.zeros(int(points.max(initial=0)) + 2, dtype=kind)
    seen = np.zeros(len(table), dtype=bool)
    seen[points] = True
    for p in np.flatnonzero(seen[:-1]).tolist():
        table[p] = value(p)
    return table[points]


def _padded(flat: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    out = np.full((len(sizes), int(sizes.max(initial=0)) + 1), fill, dtype=flat.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _same_end(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many last characters each pair has in common."""
    out, live, k = np.zeros(len(n), dtype=np.int64), np.arange(len(n)), 0
    while len(live):
        live = live[(n[live] > k) & (m[live] > k)]
        live = live[a[live, n[live] - 1 - k] == b[live, m[live] - 1 - k]]
        k += 1
        out[live] = k
    return out


def _most_edits(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """An upper bound of the edits of each pair: places that differ and the rest, or what a greedy common subsequence leaves."""
    short = np.minimum(n, m)
    wide = int(short.max(initial=0))
    differ = ((a[:, :wide] != b[:, :wide]) & (np.arange(wide) < short[:, None])).sum(axis=1) + np.abs(n - m)
    rows = np.flatnonzero(n != m)
    if len(rows):
        swap = (n > m)[rows, None]
        wide = max(a.shape[1], b.shape[1])
        fit = lambda x: np.pad(x[rows], ((0, 0), (0, wide - x.shape[1])), constant_values=-3)
        x, y = fit(a), fit(b)
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        small, large = short[rows], np.maximum(n, m)[rows]
        at, every = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        for j in range(int(large.max())):
            at += (x[every, at] == y[:, j]) & (at < small) & (j < large)
        differ[rows] = np.minimum(differ[rows], n[rows] + m[rows] - 2 * at)
    return differ


def _diagonal(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether it is certain that a pair aligns place by place, places that differ, their pairs) of pairs of one length n.

    It is certain if no character is lost at one place and put out at another. No path matches more characters then than the diagonal does, as what
    that leaves unmatched has no partner at all, and a path with k insertions has k deletions too, so it takes k edits more at least. Characters
    are told apart by 6 bits; two that look alike make a pair uncertain only.
    """
    sure, differ = np.ones(len(n), dtype=bool), np.flatnonzero(x != y)
    row = np.repeat(np.arange(len(n)), n)[differ]
    if len(differ):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        lost, put = (np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (t[differ] & 63).astype(np.uint64)), first) for t in (x, y))
        sure[row[first]] = lost & put == 0
    return sure, differ, row


def straight(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Pairs of one length that are certain to align place by place, so that no other path is as good."""
    out = n == m
    out[out] = _diagonal(x[np.repeat(out, n)], y[np.repeat(out, m)], n[out])[0]
    return out


def nested(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the shorter text of each pair is a subsequence of the other, so that no best path substitutes."""
    left, right = np.cumsum(n) - n, len(x) + np.cumsum(m) - m
    order = np.argsort(-np.maximum(n, m), kind="stable")
    swap, size = (n > m)[order], np.maximum(n, m)[order]
    at, read = np.where(swap, right[order], left[order]), np.where(swap, left[order], right[order])
    end, points = at + np.minimum(n, m)[order], np.concatenate((x, y, np.zeros(1, dtype=x.dtype)))
    for live in np.searchsorted(-size, -np.arange(int(size.max(initial=0)))).tolist():
        own = at[:live]
        own += (points[own] == points[read[:live]]) & (own < end[:live])
        read += 1
    out = np.zeros(len(n), dtype=bool)
    out[order] = at == end
    return out


def _band_moves(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, most: np.ndarray, classes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(steps, pairs) moves of some pairs from their ends: 0 from both, 1 from the reference alone, 2 from the output alone, 3 beyond the path.

    Cell k of row i is column i + k - left of the table.
    """
    left = (most - (m - n)) // 2
    width, rows, pairs = int(((most + (m - n)) // 2 + left).max()) + 1, int(n.max()), len(n)
    big = int((n + m).max()) + 1
    step = big * big
    kind, far = (np.int32, 1 << 30) if step * (2 * (rows + width) + big) < 1 << 29 else (np.int64, 1 << 61)
    at = np.arange(rows + width + 1)[:, None] - left - 1
    inside = (at >= 0) & (at < m)
    every = np.arange(pairs)
    at = np.where(inside, at, 0)
    read, read_class = np.where(inside, b[every, at], -2), np.where(inside, classes[1][every, at], -2).astype(np.int8)
    own, own_class = np.ascontiguousarray(a[:, :rows].T), np.ascontiguousarray(classes[0][:, :rows].T)
    along = (step * np.arange(width)).astype(kind)[:, None]
    column = np.arange(width)[:, None] - left
    last = np.where(column >= 0, column * step, far).astype(kind)
    moves = np.full((rows + 1, width, pairs), 2, dtype=np.uint8)
    alone = np.full((width, pairs), far, dtype=kind)
    for i in range(1, rows + 1):
        both = np.where(read_class[i : i + width] == own_class[i - 1], kind(step - 1), kind(step))
        both[read[i : i + width] == own[i - 1]] = -big
        both += last
        np.add(last[1:], kind(step), out=alone[:-1])
        last = np.minimum(both, alone)
        last -= along
        np.minimum.accumulate(last, axis=0, out=last)
        last += along
        now = moves[i]
        now -= last == alone
        now *= last != both
    # all pairs walk back together
    i, k, flat = n.copy(), m - n + left, moves.reshape(-1)
    walked = []
    while True:
        live = (i > 0) | (i + k > left)
        if not live.any():
            break
        went = flat[(i * width + np.where(live, k, 0)) * pairs + every]
        went[~live] = 3
        walked.append(went)
        i -= went < 2
        k += (went == 1).astype(np.int64) - (went == 2)
    return np.stack(walked)


class Steps:
    """The steps of some pairs from the left, pair after pair, as flat arrays.

    starts: where each pair's steps begin (and the end); row: the pair of each step; go: 0 from both, 1 from the reference alone, 2 from the
    output alone; r, h: code points, -1 where there is none; same: whether both are one character.
    """

    def __init__(self, refs: list[str], hyps: list[str]):
        (x, n), (y, m) = code_points(refs), code_points(hyps)
        kinds = per_point(np.r_[x, y], lambda p: char_class(chr(p)), np.int8)
        inner, size = self._moves(x, y, n, m, kinds)
        self.starts = np.r_[0, np.cumsum(size)]
        self.row = np.repeat(np.arange(len(n)), size)
        self.go = np.zeros(int(self.starts[-1]), dtype=np.uint8)
        for pairs, count, go in inner:
            self.go[np.repeat(self.starts[pairs] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(go))] = go
        self.r, self.h = np.full(len(self.go), -1, dtype=np.int32), np.full(len(self.go), -1, dtype=np.int32)
        self.r[self.go < 2], self.h[self.go != 1] = x, y
        self.same = self.r == self.h

    @staticmethod
    def _moves(x, y, n, m, kinds) -> tuple[list[tuple], np.ndarray]:
        """((pairs, number of their steps before the common end, these steps) of each group, steps of every pair)."""
        size, groups = np.maximum(n, m), []
        # pairs of like length together, so that one long text does not pad all; those that are straight need no moves
        order = np.flatnonzero(~straight(x, y, n, m))
        order = order[np.argsort(size[order], kind="stable")]
        before = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(m)]
        lo = 0
        while lo < len(order):
            hi = lo + max(1, int(np.searchsorted(np.arange(1, len(order) - lo + 1) * (size[order[lo:]] + 1), ROW_CELLS * 16)))
            while hi - lo > 1 and size[order[hi - 1]] > 2 * size[order[lo]] + 64:
                hi = lo + max(1, (hi - lo) // 2)
            own = np.sort(order[lo:hi])
            lo = hi
            pick = lambda s, sizes, own=own: np.repeat(s[own] - np.r_[0, np.cumsum(sizes[own])[:-1]], sizes[own]) + np.arange(int(sizes[own].sum()))
            px, py = pick(before[0], n), pick(before[1], m)
            a, b, ca, cb = _padded(x[px], n[own], -1), _padded(y[py], m[own], -2), _padded(kinds[: len(x)][px], n[own], -1), _padded(kinds[len(x) :][py], m[own], -1)
            ends = _same_end(a, b, n[own], m[own])
            nn, mm = n[own] - ends, m[own] - ends
            most = _most_edits(a, b, nn, mm)
            left = np.flatnonzero(nn + mm)
            width = np.searchsorted(WIDTHS, most + 1)
            left = left[np.lexsort((nn[left], width[left]))]
            while len(left):
                same = int(np.searchsorted(width[left], width[left[0]], side="right"))
                wide = int(most[left[:same]].max()) + 2
                fits = np.arange(1, same + 1) * wide
                count = max(1, min(int(np.searchsorted(fits, ROW_CELLS, side="right")), int(np.searchsorted(fits * (nn[left[:same]] + 1), BATCH_CELLS, side="right"))))
                part, left = left[:count], left[count:]
                went = _band_moves(a[part], b[part], nn[part], mm[part], most[part], (ca[part], cb[part]))[::-1].T
                live = went < 3
                steps = live.sum(axis=1)
                size[own[part]] = steps + ends[part]
                groups.append((own[part], steps, went[live]))
        return groups, size

    @property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """How many characters of the reference and of the output stand before each step."""
        out = []
        for used in (self.go < 2, self.go != 1):
            before = np.r_[0, np.cumsum(used)]
            out.append(before[:-1] - before[self.starts[self.row]])
        return out[0], out[1]

    def edits(self) -> np.ndarray:
        return self.count(~self.same)

    def count(self, which: np.ndarray) -> np.ndarray:
        """How many steps of each pair are in `which`."""
        return np.bincount(self.row[which], minlength=len(self.starts) - 1)

    def listed(self, which: np.ndarray, texts: pa.Array) -> pa.Array:
        """Per pair, the texts of its steps in `which` (one text for each such step)."""
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.count(which))].astype(np.int32)), texts)


def substituted(ref: pa.Array, hyp: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, reference character, output character) of each substitution on the paths of some pairs, as by Steps. Null texts are empty.

    Pairs that are certain to align place by place, and those of which one text is a subsequence of the other, need no path.
    """
    ref, hyp = pc.fill_null(ref, ""), pc.fill_null(hyp, "")
    same = pc.equal(pc.utf8_length(ref), pc.utf8_length(hyp)).to_numpy(zero_copy_only=False)
    even, uneven = np.flatnonzero(same), np.flatnonzero(~same)
    of = lambda column, pairs: column_points(column.take(pa.array(pairs)))
    (x, n), (y, _) = of(ref, even), of(hyp, even)
    sure, differ, row = _diagonal(x, y, n)
    differ, row = differ[sure[row]], row[sure[row]]
    found = [(even[row], x[differ], y[differ])]
    (x, n), (y, m) = of(ref, uneven), of(hyp, uneven)
    rest = np.r_[even[~sure], uneven[~nested(x, y, n, m)]]
    if len(rest):
        s = Steps(*texts(ref.take(pa.array(rest)), hyp.take(pa.array(rest))))
        subs = (s.go == 0) & ~s.same
        found.append((rest[s.row[subs]], s.r[subs], s.h[subs]))
    return tuple(np.concatenate(c) for c in zip(*found))


def embedded(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the shorter text of each pair is a subsequence of the other, which characters of x and then of y meet one).

    Characters meet as late as they can, which is the path that Steps walks back from the end: no other has so few edits and so many matches.
    The second array says nothing of pairs that are not nested.
    """
    points, used = np.concatenate((x, y)), np.ones(len(x) + len(y), dtype=bool)
    left, right = np.cumsum(n) - n, len(x) + np.cumsum(m) - m
    order = np.argsort(-np.maximum(n, m), kind="stable")
    swap, size, short = (n > m)[order], np.maximum(n, m)[order], np.minimum(n, m)[order]
    start = np.where(swap, right[order], left[order])
    at, read = start + short - 1, np.where(swap, left[order], right[order]) + size - 1
    for live in np.searchsorted(-size, -np.arange(int(size.max(initial=0)))).tolist():
        own, here = at[:live], read[:live]
        met = (points[own] == points[here]) & (own >= start[:live])
        used[here] = met
        own -= met
        here -= 1
    out = np.zeros(len(n), dtype=bool)
    out[order] = at < start
    return out, used


def outcomes(ref: pa.Array, hyp: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits of each pair, whether each reference character is in an equal step, the same of each output character), as by Steps. Null texts are empty.

    Pairs that are certain to align place by place, and those of which one text is a subsequence of the other, need no path.
    """
    ref, hyp = pc.fill_null(ref, ""), pc.fill_null(hyp, "")
    (x, n), (y, m) = column_points(ref), column_points(hyp)
    edits, hit, right = np.zeros(len(n), dtype=np.int64), np.zeros(len(x), dtype=bool), np.zeros(len(y), dtype=bool)
    even = n == m
    own, read = np.repeat(even, n), np.repeat(even, m)
    left, put = x[own], y[read]
    sure, _, row = _diagonal(left, put, n[even])
    edits[even] = np.bincount(row, minlength=len(sure))
    hit[own] = right[read] = left == put
    certain = np.zeros(len(n), dtype=bool)
    certain[even] = sure
    nested_, used = embedded(x[~own], y[~read], n[~even], m[~even])
    certain[~even] = nested_
    edits[~even] = np.abs(n - m)[~even]
    hit[~own], right[~read] = used[: len(x) - len(left)], used[len(x) - len(left) :]
    rest = np.flatnonzero(~certain)
    if len(rest):
        s = Steps(*texts(ref.take(pa.array(rest)), hyp.take(pa.array(rest))))
        edits[rest] = s.edits()
        hit[np.repeat(~certain, n)], right[np.repeat(~certain, m)] = s.same[s.go < 2], s.same[s.go != 1]
    return edits, hit, right


def least_edits(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A lower bound of the edits of each pair: the longer text's characters that have no partner in the other, wherever they stand."""
    ranks = _ranks(np.r_[x, y])
    wide, out = int(ranks.max(initial=0)) + 1, np.zeros(len(n), dtype=np.int64)
    step, ends = max(1, 4_000_000 // wide), (np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(m)])
    for lo in range(0, len(n), step):
        hi = min(len(n), lo + step)
        left, right = (np.bincount(np.repeat(np.arange(hi - lo) * wide, sizes[lo:hi]) + ranks[first + e[lo] : first + e[hi]], minlength=(hi - lo) * wide) for sizes, e, first in ((n, ends[0], 0), (m, ends[1], len(x))))
        out[lo:hi] = np.maximum(n, m)[lo:hi] - np.minimum(left, right).reshape(hi - lo, wide).sum(axis=1)
    return out


def bare_distances(ref: pa.Array, hyp: pa.Array, edits: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least edits of each pair without output spaces, in NFC then. Null texts are empty.

    edits and right are the outcomes() of the pairs as they are: an output space that is right becomes a deletion, others cost no more without. Where
    this upper bound is no more than what the characters need at least, it is the distance.
    """
    ref, hyp = pc.fill_null(ref, ""), pc.fill_null(hyp, "")
    bare = pc.replace_substring(hyp, " ", "")
    y, m = column_points(hyp)
    most = edits + np.bincount(np.repeat(np.arange(len(m)), m)[right & (y == 32)], minlength=len(m))
    odd = np.flatnonzero(pc.not_equal(pc.binary_length(bare), pc.utf8_length(bare)).to_numpy(zero_copy_only=False))
    if len(odd):
        mask = np.zeros(len(bare), dtype=bool)
        mask[odd] = True
        before = bare
        bare = pc.replace_with_mask(bare, pa.array(mask), pa.array([unicodedata.normalize("NFC", t) for t in bare.take(pa.array(odd)).to_pylist()], bare.type))
        # what NFC changes has no bound
        most[pc.not_equal(bare, before).to_numpy(zero_copy_only=False)] = np.iinfo(np.int64).max
    out, left = edits.copy(), np.flatnonzero(pc.not_equal(bare, hyp).to_numpy(zero_copy_only=False))
    ref, bare, most = ref.take(pa.array(left)), bare.take(pa.array(left)), most[left]
    (x, n), (y, m) = column_points(ref), column_points(bare)
    least = least_edits(x, y, n, m)
    out[left] = least
    rest = least < most
    some = rest & (least == np.abs(n - m))
    rest[some] = ~nested(x[np.repeat(some, n)], y[np.repeat(some, m)], n[some], m[some])
    for part, measure in ((rest & (np.minimum(n, m) <= SHORT), short_distances), (rest & (np.minimum(n, m) > SHORT), distances)):
        at = pa.array(np.flatnonzero(part))
        if len(at):
            out[left[part]] = measure(ref.take(at).to_pylist(), bare.take(at).to_pylist())
    return out


def letters(points: np.ndarray) -> pa.Array:
    """Code points as strings; -1 is null."""
    known: list[int] = []
    at = per_point(points, lambda p: known.append(p) or len(known) - 1, np.int32)
    return pa.array(map(chr, known), pa.string()).take(pa.array(at, mask=points < 0))


def texts(*columns: pa.Array) -> list[list[str]]:
    """Arrow columns of text as lists; null texts are empty."""
    return [["" if t is None else t for t in c.to_pylist()] for c in columns]


def distances(refs: list[str], hyps: list[str]) -> np.ndarray:
    """Least edits of each pair; where one text is a subsequence of the other, the difference of their lengths."""
    (x, n), (y, m) = code_points(refs), code_points(hyps)
    out = np.abs(n - m)
    wide = int(np.maximum(n, m).max(initial=0))
    rest = np.arange(len(n))
    if wide * len(n) <= BATCH_CELLS:
        rest = np.flatnonzero(_most_edits(_padded(x, n, -1), _padded(y, m, -2), n, m) > out)
    if len(rest):
        out[rest] = Steps([refs[k] for k in rest], [hyps[k] for k in rest]).edits()
    return out


#: Pairs whose shorter text has at most so many characters are measured by bits, a row of the table in few machine words.
SHORT = 256


def _ranks(points: np.ndarray) -> np.ndarray:
    seen = np.zeros(int(points.max(initial=0)) + 1, dtype=bool)
    seen[points] = True
    return (np.cumsum(seen) - 1)[points]


def short_distances(refs: list[str], hyps: list[str]) -> np.ndarray:
    """Least edits of pairs whose shorter text has at most SHORT characters: bit-parallel (Myers, in blocks of 64), all pairs at once."""
    # the shorter text is the pattern
    own, read = zip(*[(r, h) if len(r) <= len(h) else (h, r) for r, h in zip(refs, hyps, strict=True)]) if refs else ((), ())
    (x, m), (y, n) = code_points(own), code_points(read)
    out, ranks = np.zeros(len(m), dtype=np.int64), _ranks(np.r_[x, y])
    x, y, starts = ranks[: len(x)], ranks[len(x) :], (np.r_[0, np.cumsum(m)], np.r_[0, np.cumsum(n)])
    letters_ = int(ranks.max(initial=0)) + 2
    order, lo = np.argsort(n, kind="stable"), 0
    while lo < len(order):
        blocks = -(-max(1, int(m[order[lo:]].max())) // 64)
        hi = min(len(order), lo + max(64, 300_000 // (letters_ * blocks)), int(np.searchsorted(n[order], 2 * n[order[lo]] + 64, side="right")))
        own = order[lo:hi]
        lo = hi
        pick = lambda s, sizes, own=own: np.repeat(s[own] - np.r_[0, np.cumsum(sizes[own])[:-1]], sizes[own]) + np.arange(int(sizes[own].sum()))
        # a letter that no text has pads both
        out[own] = _bit_rows(_padded(x[pick(starts[0], m)], m[own], letters_ - 1), _padded(y[pick(starts[1], n)], n[own], letters_ - 1), m[own], n[own], letters_)
    return out


def _bit_rows(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, letters_: int) -> np.ndarray:
    word, one, top = np.uint64, np.uint64(1), np.uint64(63)
    pairs, blocks, every = len(m), -(-max(1, int(m.max())) // 64), np.arange(len(m))
    where = np.zeros((blocks, letters_, pairs), dtype=word)
    a, b = (np.ascontiguousarray(t.T) * pairs + every for t in (a, b))
    where = where.reshape(blocks, -1)
    for i in range(int(m.max())):
        where[i // 64, a[i]] |= one << word(i % 64)
    plus, minus = np.full((blocks, pairs), ~word(0)), np.zeros((blocks, pairs), dtype=word)
    last, bit = (np.maximum(m, 1) - 1) // 64, ((np.maximum(m, 1) - 1) % 64).astype(word)
    edits, ends = m.astype(np.int64), [last == k for k in range(blocks)]
    for j in range(int(n.max())):
        up, down = np.ones(pairs, dtype=word), np.zeros(pairs, dtype=word)
        at, live = b[j], j < n
        for k in range(blocks):
            eq, p, q = where[k][at], plus[k], minus[k]
            xv = eq | q
            eq |= down
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = q | ~(xh | p), p & xh
            own = live if blocks == 1 else live & ends[k]
            edits += (((ph >> bit) & one).view(np.int64) - ((mh >> bit) & one).view(np.int64)) * own
            if k + 1 < blocks:
                over, under = ph >> top, mh >> top
            ph, mh = (ph << one) | up, (mh << one) | down
            plus[k], minus[k] = mh | ~(xv | ph), ph & xv
            if k + 1 < blocks:
                up, down = over, under
    return np.where(m == 0, n, edits)


@F.arrow_udf(T.LongType())
def _short_distance(x: pa.Array, y: pa.Array) -> pa.Array:
    lost = (x.is_null().to_numpy(zero_copy_only=False)) | (y.is_null().to_numpy(zero_copy_only=False))
    refs, hyps = texts(x, y)
    out, left = np.zeros(len(lost), dtype=np.int64), np.flatnonzero(~lost)
    out[left] = short_distances([refs[k] for k in left], [hyps[k] for k in left])
    return pa.array(out, mask=lost)


def line_distance(x: Column, y: Column) -> Column:
    """Least edits of a pair, null if either is; pairs of lines are measured a batch at once, longer ones by levenshtein()."""
    short = (x != y) & (F.least(F.length(x), F.length(y)) <= SHORT)
    return F.when(x == y, F.lit(0).cast("long")).otherwise(F.coalesce(_short_distance(F.when(short, x), F.when(short, y)), F.levenshtein(x, y).cast("long")))


@F.arrow_udf(T.LongType())
def distance(x: pa.Array, y: pa.Array) -> pa.Array:
    """Least edits of a pair, null if either is."""
    lost = (x.is_null().to_numpy(zero_copy_only=False)) | (y.is_null().to_numpy(zero_copy_only=False))
    return pa.array(distances(*texts(x, y)), mask=lost)


def align_batch(refs: list[str], hyps: list[str]) -> list[list[tuple]]:
    """For each pair, its steps from the left: (tag, i, j, reference character, hypothesis character)."""
    s = Steps(refs, hyps)
    go, cut = s.go.tolist(), s.starts.tolist()
    return [_steps(go[lo:hi], ref, hyp) for lo, hi, ref, hyp in zip(cut[:-1], cut[1:], refs, hyps, strict=True)]


TAGS = ("equal", "replace", "delete", "insert")


def _steps_array(refs: list[str], hyps: list[str]) -> pa.Array:
    """The same steps as an Arrow array of OPS, without a Python object per step."""
    s = Steps(refs, hyps)
    i, j = s.places
    tag = np.where(s.go == 0, np.where(s.same, 0, 1), s.go + 1)
    columns = [pa.array(TAGS).take(pa.array(tag)), pa.array(i.astype(np.int32), mask=s.go == 2), pa.array(j.astype(np.int32), mask=s.go == 1), letters(s.r), letters(s.h)]
    return pa.ListArray.from_arrays(pa.array(s.starts.astype(np.int32)), pa.StructArray.from_arrays(columns, names=["tag", "i", "j", "r", "h"]))


def _steps(moves: list[int], ref: str, hyp: str) -> list[tuple]:
    out, i, j = [], 0, 0
    for go in moves:
        if go == 0:
            out.append(("equal" if ref[i] == hyp[j] else "replace", i, j, ref[i], hyp[j]))
        elif go == 1:
            out.append(("delete", i, None, ref[i], None))
        else:
            out.append(("insert", None, j, None, hyp[j]))
        i, j = i + (go < 2), j + (go != 1)
    return out


@F.arrow_udf(OPS)
def _ops(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return _steps_array(*texts(ref, hyp))


def alignment(ref: Column, hyp: Column) -> Column:
    """array<struct<tag, i, j, r, h>> of a pair; null texts are empty."""
    return _ops(ref, hyp)


def n_edits(ops: Column) -> Column:
    return F.size(F.filter(ops, lambda s: s["tag"] != "equal"))


@F.arrow_udf(T.IntegerType())
def _paired_spaces(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    refs, hyps = texts(ref, hyp)
    s = Steps([t.replace(" ", "") for t in refs], [t.replace(" ", "") for t in hyps])
    # node k of a path stands before its step k, and one more at its end; it joins a gap of either side
    size = np.diff(s.starts)
    ends = s.starts[1:] + np.arange(len(size))
    pair, inner = np.repeat(np.arange(len(size)), size + 1), np.ones(len(s.go) + len(size), dtype=bool)
    inner[ends] = False
    left = []
    for lines, used in ((refs, s.go < 2), (hyps, s.go != 1)):
        points, sizes = code_points(lines)
        row, space = np.repeat(np.arange(len(sizes)), sizes), points == 32
        # gaps of all lines in a row: line k has one more than it has other characters
        first = np.r_[0, np.cumsum(np.bincount(row[~space], minlength=len(sizes)) + 1)]
        gaps = np.bincount((np.cumsum(~space) + row)[space], minlength=int(first[-1]))
        moved = np.zeros(len(inner), dtype=np.int64)
        moved[inner] = used
        gone = np.r_[0, np.cumsum(moved)]
        left.append((gaps, gone[:-1] + pair))
    (own, i), (read, j) = left
    out = np.zeros(len(size), dtype=np.int64)
    ahead = np.flatnonzero((own[i] > 0) & (read[j] > 0))
    for k, p, q in zip(pair[ahead].tolist(), i[ahead].tolist(), j[ahead].tolist(), strict=True):
        n = min(own[p], read[q])
        own[p] -= n
        read[q] -= n
        out[k] += n
    return pa.array(out.astype(np.int32))


def matched_spaces(ref: Column, hyp: Column, ops: Column | None = None) -> Column:
    """Output spaces that stand in a gap of the reference that has one, by the alignment of the texts without spaces.

    Each node of the alignment path joins a gap of either side, and spaces pair up to the lesser count, each once. `ops` is not needed any more.
    """
    return _paired_spaces(ref, hyp)
