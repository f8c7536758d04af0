"""Counters of one aligned line: characters read right and put out, edits beside rare characters, openers, look-alike substitutions.

A line is aligned once per reading. `line_counters` counts where it aligns, so that no step becomes a row or a column; others are expressions over the
steps of one alignment (functions/alignment.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import alignment as A

# fixed values: the line opener, and letters with the digits that look like them
OPENER = "꧋"
LOOKALIKES = (("꧆", "꧐"), ("ꦌ", "꧖"), ("ꦦ", "꧘"), ("ꦊ", "꧒"))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def among(c: Column, members: list[str]) -> Column:
    """Whether a character is one of `members`; null is not."""
    return F.coalesce(c.isin(members), F.lit(False)) if members else F.lit(False)


def found(text: Column, members: list[str]) -> Column:
    """The characters of a text that are one of `members`, in order."""
    one = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in members) + "]" if members else "(?!)"
    return F.regexp_extract_all(text, F.lit(one), F.lit(0))


def starts_with(text: Column, opener: str) -> Column:
    """Whether a reading begins with the opener, spaces before it aside."""
    return F.ltrim(text).startswith(opener)


def _chosen(points: np.ndarray, sizes: np.ndarray, members: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place, line) of each character of some lines that is one of `members`."""
    known = {ord(c) for c in members}
    at = np.flatnonzero(A.per_point(points, lambda p: p in known, bool)) if known else np.empty(0, dtype=np.int64)
    return at, np.searchsorted(np.cumsum(sizes), at, side="right")


def line_counters(rare: list[str], groups: dict[str, list[str]], lists: bool = False):
    """UDF of (ref, a, b): a struct of what scored lines count, taken where they are aligned. Null texts are empty.

    Per side: edits, bare (edits without output spaces), first (whether the first character is right); per group, how many of its characters stand in the
    reference, are read right and put out; `ref_rare`. With `lists` also the rare characters themselves, one entry per occurrence: ref, hits and emitted of either side.
    """
    fields = {f"ref:{g}": "long" for g in groups} | {"plain": "long"}
    for s in ("a", "b"):
        fields |= {f"edits_{s}": "long", f"bare_{s}": "long", f"first_{s}": "boolean", **{f"{k}:{g}:{s}": "long" for g in groups for k in ("hit", "out")}}
    if lists:
        fields |= {c: "array<string>" for c in ("list_ref", *[f"{k}_{s}" for s in ("a", "b") for k in ("hits", "hyp")])}
    members = {g: [c for c in m if c in rare] for g, m in groups.items()}

    def listed(points: np.ndarray, lines: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(lines, minlength=n))].astype(np.int32)), A.letters(points.astype(np.int32)))

    @F.arrow_udf(", ".join(f"`{c}` {t}" for c, t in fields.items()))
    def run(ref: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        ref = pc.fill_null(ref, "")
        x, n = A.column_points(ref)
        at, line = _chosen(x, n, rare)
        kinds = {g: np.isin(x[at], [ord(c) for c in m]) for g, m in members.items()}
        number = lambda lines: np.bincount(lines, minlength=len(n))
        out = {f"ref:{g}": number(line[k]) for g, k in kinds.items()} | {"plain": (number(line) == 0).astype(np.int64)}
        if lists:
            out["list_ref"] = listed(x[at], line, len(n))
        starts = np.cumsum(n) - n
        for s, hyp in (("a", a), ("b", b)):
            hyp = pc.fill_null(hyp, "")
            edits, hit, right = A.outcomes(ref, hyp)
            first = np.zeros(len(n), dtype=bool)
            first[n > 0] = hit[starts[n > 0]]
            y, m = A.column_points(hyp)
            put, row = _chosen(y, m, rare)
            read = hit[at]
            out |= {f"edits_{s}": edits, f"bare_{s}": A.bare_distances(ref, hyp, edits, right), f"first_{s}": first}
            for g, k in kinds.items():
                out |= {f"hit:{g}:{s}": number(line[k & read]), f"out:{g}:{s}": number(row[np.isin(y[put], [ord(c) for c in members[g]])])}
            if lists:
                out |= {f"hits_{s}": listed(x[at[read]], line[read], len(n)), f"hyp_{s}": listed(y[put], row, len(n))}
        return pa.StructArray.from_arrays([out[c] if isinstance(out[c], pa.Array) else pa.array(out[c]) for c in fields], names=list(fields))

    return run


#: What lookalike_sums counts for each letter and digit.
ALIKE = ("ref_letter", "ref_digit", *[f"{x}_{s}" for s in "ab" for x in ("letter_as_digit", "digit_as_letter", "false_letter", "false_letter_lines")])


def lookalike_sums(pairs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (ref, a, b): one row of a task's sums, ALIKE of the first letter and digit, then of the next.

    Only lines that have a letter or digit, and in the reading the other, are aligned. Null texts are empty.
    """
    tracked = list(dict.fromkeys(c for p in pairs for c in p))
    bools = lambda column: column.to_numpy(zero_copy_only=False)
    has = lambda text: {c: bools(pc.match_substring(text, c)) for c in tracked}
    number = lambda text, c, rows: pc.count_substring(text.take(pa.array(np.flatnonzero(rows))), c).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(pairs), len(ALIKE)), dtype=np.int64)
        for batch in batches:
            ref, *sides = (pc.fill_null(c, "") for c in batch.columns)
            own = has(ref)
            sums[:, :2] += [[number(ref, c, own[c]).sum() for c in p] for p in pairs]
            for side, hyp in enumerate(sides):
                out = has(hyp)
                may = np.logical_or.reduce([own[x] & out[y] for p in pairs for x, y in (p, p[::-1])])
                may = pa.array(np.flatnonzero(may & bools(pc.not_equal(ref, hyp))))
                _, r, h = A.substituted(ref.take(may), hyp.take(may))
                for k, (x, y) in enumerate(pairs):
                    false = number(hyp, x, out[x] & ~own[x])
                    swaps = [np.count_nonzero((r == ord(c)) & (h == ord(d))) for c, d in ((x, y), (y, x))]
                    sums[k, 2 + 4 * side : 6 + 4 * side] += [*swaps, false.sum(), len(false)]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in sums.reshape(-1).tolist()], names=[f"{x}{k}" for k in range(len(pairs)) for x in ALIKE])

    return run


def plain_errors(ops: Column, rare: list[str]) -> Column:
    """Edits on other than rare characters.

    A block is a run of steps that are not equal. A block that substitutes or deletes a rare reference character is that glyph's reading and counts
    nothing; in the others each step counts, but for insertions of rare characters.
    """
    own = lambda c: among(c, rare)
    zero = F.struct(F.lit(0).alias("done"), F.lit(0).alias("open"), F.lit(False).alias("rare"))
    close = lambda a: a["done"] + F.when(a["rare"], 0).otherwise(a["open"])

    def step(a: Column, s: Column) -> Column:
        equal, touches = s["tag"] == "equal", own(s["r"])
        counts = ~touches & ~((s["tag"] == "insert") & own(s["h"]))
        return F.struct(F.when(equal, close(a)).otherwise(a["done"]).alias("done"), F.when(equal, 0).otherwise(a["open"] + counts.cast("int")).alias("open"), (~equal & (a["rare"] | touches)).alias("rare"))

    return F.aggregate(ops, zero, step, close)


def _plain_edits(s: A.Steps, known: list[int]) -> np.ndarray:
    """plain_errors of each pair, out of flat steps."""
    wrong, touched = ~s.same, np.isin(s.r, known)
    opens = wrong & (np.r_[True, s.same[:-1]] | (s.row != np.r_[-1, s.row[:-1]]))[: len(wrong)]
    block = np.cumsum(opens) - 1
    rare = np.zeros(int(opens.sum()), dtype=bool)
    rare[block[wrong & touched]] = True
    counts = wrong & ~touched & ~((s.go == 2) & np.isin(s.h, known))
    counts[counts] = ~rare[block[counts]]
    return s.count(counts)


def plain_edits(ref: Column, hyp: Column, rare: list[str]) -> Column:
    """plain_errors of a pair, counted where it is aligned. Null texts are empty."""

    @F.arrow_udf(T.LongType())
    def run(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        return pa.array(_plain_edits(A.Steps(*A.texts(ref, hyp)), [ord(c) for c in rare]))

    return run(ref, hyp)


def substitutions(ref: Column, hyp: Column, pairs: list[tuple[str, str]]) -> Column:
    """array<long>: how often each (reference character, output character) is a substitution of a pair, in the order of `pairs`."""
    wanted = {ord(x) << 32 | ord(y): k for k, (x, y) in enumerate(pairs)}
    codes = np.array(sorted(wanted), dtype=np.int64)
    place = np.array([wanted[c] for c in codes.tolist()], dtype=np.int64)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        row, r, h = A.substituted(ref, hyp)
        pair = r.astype(np.int64) << 32 | h
        known = np.isin(pair, codes)
        flat = np.bincount(row[known] * len(pairs) + place[np.searchsorted(codes, pair[known])], minlength=len(pairs) * len(ref))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(ref) + 1, dtype=np.int32) * len(pairs)), pa.array(flat))

    return run(ref, hyp)


RUN = ("edits", "plain_chars", "plain_edits", "ref", "hits", "emitted", "misread", "opener", "opener_read", "false_opener")


def run_counters(ref: Column, hyp: Column, rare: list[str], tracked: list[str], opener: str = OPENER) -> Column:
    """struct<RUN>: how many of each rare_stats lists, or whether, for one line and one run, counted where it is aligned. Null texts are empty."""
    known, plain = [ord(c) for c in dict.fromkeys([*rare, *tracked])], [ord(c) for c in rare]

    @F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in RUN]))
    def run(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        refs, hyps = A.texts(ref, hyp)
        s = A.Steps(refs, hyps)
        (i, j), n = s.places, len(refs)
        has = np.fromiter((t.startswith(opener) for t in refs), bool, n)
        heads = np.fromiter((len(t) - len(t.lstrip(" ")) for t in hyps), np.int64, n)
        false_head = np.fromiter((t.lstrip(" ").startswith(opener) for t in hyps), bool, n)
        first = (s.go < 2) & (i == 0)
        read = s.count(first & s.same) > 0
        taken = s.count(s.same & (j == heads[s.row])) > 0
        # the output character that is the opener's own
        skip = np.full(n, -1, dtype=np.int64)
        skip[s.row[first & s.same]] = j[first & s.same]
        skip = np.where(has, skip, np.where(false_head & ~taken, heads, -1))
        places = np.isin(s.r, known) & ~(has[s.row] & first)
        out = np.isin(s.h, known) & (j != skip[s.row])
        chars = s.count((s.go < 2) & ~np.isin(s.r, plain))
        found = [s.edits(), np.where(has, 0, chars), np.where(has, 0, _plain_edits(s, plain)), s.count(places), s.count(places & s.same), s.count(out), s.count(places & ~s.same), has, has & read, ~has & false_head]
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=list(RUN))

    return run(ref, hyp)


def rare_stats(ref: Column, hyp: Column, ops: Column, rare: list[str], tracked: list[str], opener: str = OPENER) -> Column:
    """The counters of one line and one run: all and plain characters and edits, tracked characters, and the opener.

    `tracked` are the rare characters and the look-alikes. The opener of a line is counted by itself: neither the reference's first character nor
    its reading is among ref, hits, emitted and misread, and its line has no plain characters. On a line without one, an opener at the
    head of the output that no reference character matches is a false opener.
    """
    known = list(dict.fromkeys([*rare, *tracked]))
    has = ref.startswith(opener)
    heads = F.length(hyp) - F.length(F.ltrim(hyp))
    false_head = starts_with(hyp, opener)
    matched = lambda j: F.exists(ops, lambda s: (s["tag"] == "equal") & (s["j"] == j))
    own = F.filter(ops, lambda s: (s["tag"] == "equal") & (s["i"] == 0))
    skip = F.when(has, F.get(own, F.lit(0))["j"]).when(false_head & ~matched(heads), heads)
    places = F.filter(ops, lambda s: among(s["r"], known) & ~(has & (s["i"] == 0)))
    plain = F.size(F.filter(chars(ref), lambda c: ~among(c, rare)))
    first = F.get(F.filter(ops, lambda s: s["i"] == 0), F.lit(0))
    return F.struct(
        F.length(ref).alias("chars"),
        F.size(F.filter(ops, lambda s: s["tag"] != "equal")).alias("edits"),
        F.when(has, 0).otherwise(plain).alias("plain_chars"),
        F.when(has, 0).otherwise(plain_errors(ops, rare)).alias("plain_edits"),
        F.transform(places, lambda s: s["r"]).alias("ref"),
        F.transform(F.filter(places, lambda s: s["tag"] == "equal"), lambda s: s["r"]).alias("hits"),
        F.transform(F.filter(ops, lambda s: among(s["h"], known) & ~s["j"].eqNullSafe(skip)), lambda s: s["h"]).alias("emitted"),
        F.transform(F.filter(places, lambda s: s["tag"] != "equal"), lambda s: F.struct(s["r"].alias("ch"), F.coalesce(s["h"], F.lit("")).alias("seen"))).alias("misread"),
        has.alias("opener"),
        (has & (first["tag"] == "equal")).alias("opener_read"),
        F.when(has, F.coalesce(first["h"], F.lit(""))).alias("opener_seen"),
        (~has & false_head).alias("false_opener"),
    )
