"""The full report of two readings of the same lines: rates, rare characters, openers, look-alikes, paired counts and joint intervals.

Each line is aligned once per reading and becomes a row of counters (scored). All ratios are bootstrapped over the same draws in one
pass: a task multiplies its rows' counters by a matrix of weights that are hashes of (unit, resample), and only the sums of each resample
leave it. Weights of a cluster follow from its name alone, so lines and clusters need neither numbering nor a shuffle of rows.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import line_scores as L
from sparkloom.functions import stats as S

SIDES = ("a", "b")
U64 = np.uint64
#: Resamples and units whose weights are drawn and multiplied at once, and units that a task gathers before.
STEP_REPS, STEP_UNITS, HELD_UNITS = 1000, 128, 16384


@functools.cache
def poisson_table() -> np.ndarray:
    """Poisson(1) weights of the 65,536 values of 16 random bits, by inversion."""
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(cdf, (np.arange(65536) + 0.5) / 65536).astype(np.float32)


@functools.cache
def _least_bits() -> np.ndarray:
    """The least 16 bits of the weights 1, 2, ..."""
    return np.searchsorted(poisson_table(), np.arange(1, int(poisson_table().max()) + 1)).astype(np.uint16)


class Draws:
    """Weights of some units over all resamples, a few units and resamples at a time, so that what is worked on stays in the caches."""

    def __init__(self, reps: int, seed: int):
        self.reps = self.begun((np.arange(1, -(-reps // 4) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) * U64(0xD1B54A32D192ED03))
        size = STEP_UNITS * STEP_REPS
        self.hash, self.shifted = (np.empty(size // 4, dtype=U64) for _ in range(2))
        self.over, self.count, self.weight = (np.empty(size, dtype=kind) for kind in (bool, np.uint8, np.float32))

    @staticmethod
    def begun(h: np.ndarray) -> np.ndarray:
        """The first step of the hash of unit ^ rep, which may be taken of either by itself."""
        return h ^ (h >> U64(30))

    def of(self, units: np.ndarray, first: int, count: int) -> np.ndarray:
        """Weights (units, count) of at most STEP_UNITS units in the resamples from `first`, at most STEP_REPS; both are multiples of 4, as a hash serves four resamples."""
        reps = self.reps[first // 4 : (first + count) // 4]
        shape = (len(units), len(reps))
        h, t = (x[: len(units) * len(reps)].reshape(shape) for x in (self.hash, self.shifted))
        np.bitwise_xor(reps, self.begun(units.view(U64))[:, None], out=h)
        for factor, shift in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
            h *= U64(factor)
            h ^= np.right_shift(h, U64(shift), out=t)
        # one comparison per weight reads less than a table of all 16 bits
        bits = h.view(np.uint16)
        over, total, out = (x[: bits.size].reshape(bits.shape) for x in (self.over, self.count, self.weight))
        least = _least_bits()
        np.greater_equal(bits, least[0], out=total.view(bool))
        for x in least[1:]:
            total += np.greater_equal(bits, x, out=over).view(np.uint8)
        out[...] = total
        return out


def weights(units: np.ndarray, first: int, count: int, seed: int) -> np.ndarray:
    """Weights (count, units) of resamples first, first + 1, ...; first and count are multiples of 4."""
    draws, out = Draws(first + count, seed), np.empty((count, len(units)), dtype=np.float32)
    for lo in range(0, len(units), STEP_UNITS):
        for r in range(0, count, STEP_REPS):
            n = min(STEP_REPS, count - r)
            out[r : r + n, lo : lo + STEP_UNITS] = draws.of(units[lo : lo + STEP_UNITS], first + r, n).T
    return out


def _exact(values: np.ndarray) -> bool:
    """Whether sums of STEP_UNITS weighted rows are whole numbers that float32 holds exactly."""
    most = np.abs(values).max(initial=0.0)
    return bool(np.isfinite(most) and most * STEP_UNITS * float(poisson_table().max()) < 2**24 and (values == np.floor(values)).all())


def add_resamples(sums: np.ndarray, keys: np.ndarray, values: np.ndarray, draws: Draws) -> None:
    """Add the weighted values (units, columns) to the sums (columns, resamples). Units of which columns are 0 throughout are not multiplied."""
    some = values != 0
    # columns in the order of how many units have them, and units after those that have less of them
    order = np.argsort(-some.sum(axis=0), kind="stable")
    cut = len(order) - np.argmax(np.c_[some[:, order][:, ::-1], np.ones(len(keys), dtype=bool)], axis=1)
    rows = np.argsort(-cut, kind="stable")
    keys, values, cut = keys[rows], np.ascontiguousarray(values[rows][:, order]), cut[rows]
    exact = _exact(values)
    kind = np.float32 if exact else np.float64
    values = values.astype(kind)
    found = np.zeros(sums.shape)
    for lo in range(0, len(keys), STEP_UNITS):
        wide = int(cut[lo])
        if not wide:
            break
        own = values[lo : lo + STEP_UNITS, :wide]
        for r in range(0, sums.shape[1], STEP_REPS):
            n = min(STEP_REPS, sums.shape[1] - r)
            drawn = draws.of(keys[lo : lo + STEP_UNITS], r, n)
            found[:wide, r : r + n] += (drawn.T.astype(kind, copy=False) @ own).T
    sums[order] += found


def resampled(rows: DataFrame, line: str, cluster: str, columns: list[str], reps: int, seed: int = 0, by: tuple[str, ...] = ("lines", "clusters")) -> DataFrame:
    """(kind, rep, columns): sums of the columns in each resample of lines and of clusters (those in `by`), and over all (kind `all`)."""
    kinds = {"all": 0, "lines": 1, "clusters": 2}
    fields = [pa.field("kind", pa.int32()), pa.field("rep", pa.int32()), *[pa.field(c, pa.float64()) for c in columns]]
    schema = pa.schema(fields)
    padded = -(-reps // 4) * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, some, draws = np.zeros(len(columns)), np.zeros((2, len(columns), padded)), False, Draws(padded, seed)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def gathered(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(keys, return_inverse=True)
            own = np.zeros((len(keys), len(columns)))
            np.add.at(own, at, values)
            return keys, own

        for batch in batches:
            if not len(batch):
                continue
            some = True
            values = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(columns))], axis=1)
            total += values.sum(axis=0)
            if "lines" in by:
                add_resamples(sums[0], *gathered(batch.column(0).to_numpy(), values), draws)
            if "clusters" not in by:
                continue
            # a cluster's lines are summed over several batches before it is drawn
            held.append(gathered(batch.column(1).to_numpy(), values))
            if len(held) > 1 and sum(len(k) for k, _ in held) > HELD_UNITS:
                add_resamples(sums[1], *gathered(*(np.concatenate(c) for c in zip(*held))), draws)
                held = []
            elif len(held) > 16:
                held = [gathered(*(np.concatenate(c) for c in zip(*held)))]
        if held:
            add_resamples(sums[1], *gathered(*(np.concatenate(c) for c in zip(*held))), draws)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), *[pa.array([x]) for x in total]], schema=schema)
            for kind in (k for k in (0, 1) if ("lines", "clusters")[k] in by):
                yield pa.RecordBatch.from_arrays([pa.array([kind + 1] * reps, pa.int32()), pa.array(np.arange(reps), pa.int32()), *[pa.array(sums[kind, i, :reps]) for i in range(len(columns))]], schema=schema)

    numbers = ", ".join(f"`{c}` double" for c in columns)
    keyed = rows.select(F.xxhash64(line).alias("_line"), F.xxhash64(F.lit(1), cluster).alias("_cluster"), *[F.col(c).cast("double").alias(c) for c in columns])
    found = keyed.mapInArrow(run, f"kind int, rep int, {numbers}").groupBy("kind", "rep").agg(*[F.sum(c).alias(c) for c in columns])
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (v, k)]), F.col("kind"))
    return found.withColumn("kind", name)


def ratio_report(sums: DataFrame, stats: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """(metric, a, b, diff, and per kind low, high, se, valid): ratios of sums, null without a denominator, and 95 % percentile intervals of a - b."""
    rate = lambda n, d: F.try_divide(F.col(n), F.nullif(d, F.lit(0.0)))
    one = F.array(*[F.struct(F.lit(m).alias("metric"), rate(na, da).alias("a"), rate(nb, db).alias("b")) for m, (na, da, nb, db) in stats.items()])
    long = sums.select("kind", F.inline(one)).withColumn("diff", F.col("a") - F.col("b"))
    whole = F.col("kind") == "all"
    out = [F.max(F.when(whole, F.col(c))).alias(c) for c in ("a", "b", "diff")]
    for kind in ("lines", "clusters"):
        own = F.when(F.col("kind") == kind, F.col("diff"))
        se = F.when(F.count(own) > 0, F.coalesce(F.stddev_samp(own), F.lit(0.0)))
        out += [F.percentile(own, F.lit(0.025)).alias(f"{kind}_low"), F.percentile(own, F.lit(0.975)).alias(f"{kind}_high"), se.alias(f"{kind}_se"), F.count(own).alias(f"{kind}_valid")]
    return long.groupBy("metric").agg(*out)


def scored(rows: DataFrame, rare: list[str], groups: dict[str, list[str]], opener: str = L.OPENER, lists: bool = False) -> DataFrame:
    """Counters of each line (id, cluster, ref, a, b): the columns that all parts of the report sum up; with `lists` also what codepoints() reads.

    Null texts are empty; a null or empty cluster is the line's own id.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    base = rows.select("id", F.coalesce(F.nullif(F.col("cluster").cast("string"), F.lit("")), F.col("id").cast("string")).alias("cluster"), *[text(c).alias(c) for c in ("ref", "a", "b")])
    starts = F.col("ref").startswith(opener)
    out = base.withColumn("_s", L.line_counters(rare, groups, lists)("ref", "a", "b")).select(*base.columns, "_s.*")
    out = out.withColumns({"chars": F.length("ref").cast("long"), "starts": starts.cast("long"), "no_start": (~starts).cast("long")})
    out = out.withColumn("plain_chars", F.col("plain") * F.col("chars"))
    for s in SIDES:
        out = out.withColumns({f"plain_edits_{s}": F.col("plain") * F.col(f"edits_{s}"), f"read_{s}": (starts & F.col(f"first_{s}")).cast("long"), f"false_{s}": (~starts & L.starts_with(F.col(s), opener)).cast("long")})
    return out


def murda(rare: list[str]) -> list[str]:
    return [c for c in rare if "MURDA" in unicodedata.name(c, "")]


def ratios(groups: list[str]) -> dict[str, tuple[str, str, str, str]]:
    """The ratios of the report as (numerator, denominator) of either side: error rates, recall and precision by group, openers."""
    out = {"cer": ("edits_a", "chars", "edits_b", "chars"), "cer_hyp_no_space": ("bare_a", "chars", "bare_b", "chars"), "cer_without_rare": ("plain_edits_a", "plain_chars", "plain_edits_b", "plain_chars")}
    for g in groups:
        out[f"recall:{g}"] = (f"hit:{g}:a", f"ref:{g}", f"hit:{g}:b", f"ref:{g}")
        out[f"precision:{g}"] = (f"hit:{g}:a", f"out:{g}:a", f"hit:{g}:b", f"out:{g}:b")
    return out | {"recall:opener": ("read_a", "starts", "read_b", "starts"), "false_start": ("false_a", "no_start", "false_b", "no_start")}


def counts(lines: DataFrame) -> DataFrame:
    """One row: lines, clusters and their sizes, characters, exact shares, paired counts of lines and clusters, the opener's two by two."""
    p = lambda a, b: F.round(S.sign_test(a, b), 9)
    x, y, s = F.col("edits_a"), F.col("edits_b"), F.col("starts") == 1
    ra, rb = F.col("read_a") == 1, F.col("read_b") == 1
    flags = {
        "lines_without_rare": F.col("plain") == 1, **{f"exact_{c}": F.col("ref") == F.col(c) for c in SIDES}, "lines_a_better": x < y, "lines_b_better": x > y, "lines_tie": x == y,
        "openers": s, "opener_both": s & ra & rb, "opener_only_a": s & ra & ~rb, "opener_only_b": s & ~ra & rb, "opener_neither": s & ~ra & ~rb,
    }
    sums = {"reference_chars": "chars", "chars_without_rare": "plain_chars", "false_start_a": "false_a", "false_start_b": "false_b"}
    # lines are read once: what counts them is summed up by cluster first
    per = lines.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), *[F.count_if(c).alias(n) for n, c in flags.items()], *[F.sum(c).alias(n) for n, c in sums.items()])
    sizes = [F.count(F.lit(1)).alias("clusters"), F.min("n").alias("least_lines"), F.percentile("n", F.lit(0.5)).alias("median_lines"), F.max("n").alias("most_lines"), *[c.alias(f"clusters_{n}") for n, c in (("a_better", F.count_if(F.col("x") < F.col("y"))), ("b_better", F.count_if(F.col("x") > F.col("y"))), ("tie", F.count_if(F.col("x") == F.col("y"))))]]
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), *sizes, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*sums, *flags)])
    out = out.withColumns({f"exact_{c}": F.round(F.try_divide(F.col(f"exact_{c}").cast("double"), F.col("lines")), 9) for c in SIDES})
    return out.withColumns({"lines_p": p("lines_a_better", "lines_b_better"), "clusters_p": p("clusters_a_better", "clusters_b_better"), "opener_p": p("opener_only_a", "opener_only_b")})


@F.pandas_udf(T.StringType())
def _name(ch):
    return ch.map(lambda c: unicodedata.name(c, "?"))


def codepoints(lines: DataFrame, rare: list[str]) -> DataFrame:
    """Per rare character, of lines scored with `lists`: occurrences, hits, outputs, recall and precision of either side, and where it occurs (reference, outputs only, absent)."""
    kinds = {"ref": F.col("list_ref"), **{c: F.col(c) for s in SIDES for c in (f"hits_{s}", f"hyp_{s}")}}
    named = lambda c, k: F.transform(c, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("ch")))
    items = F.concat(*[named(c, k) for k, c in kinds.items()])
    n = lines.select(F.inline(items)).groupBy("ch").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    all_ = lines.sparkSession.createDataFrame([(c,) for c in sorted(rare)], "ch string")
    out = F.broadcast(all_).join(n, "ch", "left").na.fill(0)  # one row per rare character on either side
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 9)
    out = out.withColumns({f"recall_{s}": rate(f"hits_{s}", "ref") for s in SIDES} | {f"precision_{s}": rate(f"hits_{s}", f"hyp_{s}") for s in SIDES})
    where = F.when(F.col("ref") > 0, "reference").when((F.col("hyp_a") > 0) | (F.col("hyp_b") > 0), "outputs").otherwise("absent")
    return out.select(F.concat(F.lit("U+"), F.lpad(F.hex(F.expr("ascii(ch)")), 4, "0")).alias("codepoint"), "ch", _name("ch").alias("name"), where.alias("occurs"), *kinds, *[f"{k}_{s}" for k in ("recall", "precision") for s in SIDES])


def lookalikes(lines: DataFrame, pairs=L.LOOKALIKES) -> DataFrame:
    """Per letter and digit of lines (ref, a, b), scored or not: occurrences in the references, either read for the other, and letters put out on lines that have none."""
    columns = [f"{x}{k}" for k in range(len(pairs)) for x in L.ALIKE]
    sums = lines.select("ref", *SIDES).mapInArrow(L.lookalike_sums(pairs), ", ".join(f"{c} long" for c in columns)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(p[0]).alias("letter"), F.lit(p[1]).alias("digit"), *[F.col(f"{x}{k}").alias(x) for x in L.ALIKE]) for k, p in enumerate(pairs)])
    return sums.select(F.inline(rows))


def metrics(lines: DataFrame, groups: list[str], reps: int = 10_000, seed: int = 0) -> DataFrame:
    """Every ratio of the report with its joint bootstrap intervals by lines and by clusters."""
    stats = ratios(groups)
    columns = list(dict.fromkeys(c for own in stats.values() for c in own))
    return ratio_report(resampled(lines, "id", "cluster", columns, reps, seed), stats)


def compare(rows: DataFrame, rare: list[str], reps: int = 10_000, seed: int = 0, opener: str = L.OPENER, pairs=L.LOOKALIKES) -> dict[str, DataFrame]:
    """The whole report of rows (id, cluster, ref, a, b): counts, metrics, codepoints, lookalikes, over the scored lines.

    The scored lines are kept on executors' disks while the parts are read (a lost part is scored again); call
    unpersist() on `scored` afterwards.
    """
    from pyspark import StorageLevel

    groups = {g: m for g, m in (("rare", rare), ("murda", murda(rare))) if m}
    lines = scored(rows, rare, groups, opener, lists=True).persist(StorageLevel.DISK_ONLY)
    return {"scored": lines, "counts": counts(lines), "metrics": metrics(lines, list(groups), reps, seed), "codepoints": codepoints(lines, rare), "lookalikes": lookalikes(lines, pairs)}


def reconciled(found: DataFrame, official: dict[str, Column], tolerance: float = 1e-9) -> DataFrame:
    """(metric, found, official): ratios that differ from the official ones by more than `tolerance`."""
    known = F.create_map(*[x for m, c in official.items() for x in (F.lit(m), c)])
    return found.select("metric", F.col("a").alias("found"), F.element_at(known, F.col("metric")).alias("official")).where(F.abs(F.col("found") - F.col("official")) > tolerance)


def rare_run(rows: DataFrame, rare: list[str], opener: str = L.OPENER, pairs=L.LOOKALIKES) -> DataFrame:
    """One row for one run over lines (ref, hyp): totals, plain rate, tracked characters, openers."""
    tracked = [c for p in pairs for c in p]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = rows.select(text("ref").alias("ref"), text("hyp").alias("hyp"))
    s = one.select(F.length("ref").alias("chars"), L.run_counters(F.col("ref"), F.col("hyp"), rare, tracked, opener).alias("s")).select("chars", "s.*")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = s.agg(F.count(F.lit(1)).alias("lines"), *[total(c).alias(c) for c in ("chars", "edits", "plain_chars", "plain_edits")], *[total(c).alias(c) for c in ("ref", "hits", "emitted", "misread")], *[total(c).alias(f"{c}s") for c in ("opener", "opener_read", "false_opener")])
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 9)
    return out.withColumns({"cer": rate("edits", "chars"), "plain_cer": rate("plain_edits", "plain_chars"), "recall": rate("hits", "ref"), "precision": rate("hits", "emitted"), "opener_recall": rate("opener_reads", "openers")})
