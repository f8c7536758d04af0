"""Spelling forms and inserted marks in readings: counts by line, one run's report, two runs by joint resampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import alignment as A
from sparkloom.functions.line_scores import among, chars
from sparkloom.operators.comparison import ratio_report, resampled

# fixed values: signs that are a form of the standard spelling by themselves, the palatal nasal and what makes it one, and marks above and below
SINGLE = {"ꦉ": "cerek", "ꦊ": "lelet", "ꦽ": "keret", "꧇": "pangkat"}
NASAL, FOLLOWERS = "ꦚ", ("꧀ꦕ", "꧀ꦗ")
FORMS = ("nya", "cerek", "lelet", "keret", "pangkat")
TOP, BOTTOM = list("ꦁꦂꦃꦶꦷꦼ"), list("ꦸꦹꦽꦾꦿ")


def forms(text: Column, single: dict[str, str] = SINGLE, nasal: str = NASAL, followers: tuple = FOLLOWERS) -> Column:
    """array<struct<at, form>>: the places (from 0) of a text that are a form of the standard spelling."""
    named = F.create_map(*[F.lit(x) for p in single.items() for x in p])

    def at(c: Column, i: Column) -> Column:
        joined = among(F.substr(text, i + 2, F.lit(2)), list(followers))
        form = F.when((c == nasal) & joined, "nya").otherwise(F.try_element_at(named, c))
        return F.when(form.isNotNull(), F.struct(i.alias("at"), form.alias("form")))

    return F.filter(F.transform(chars(text), at), lambda x: x.isNotNull())


def _equal_places(ref: Column, hyp: Column, at: Column, put: Column) -> Column:
    """struct: edits, and of the places `at` of a text and `put` of its reading, whether each stands in an equal step."""

    @F.arrow_udf("edits long, hit array<boolean>, right array<boolean>")
    def run(ref: pa.Array, hyp: pa.Array, at: pa.Array, put: pa.Array) -> pa.Array:
        edits, *flags = A.outcomes(ref, hyp)
        out = [pa.array(edits)]
        for text, places, same in zip((ref, hyp), (at, put), flags, strict=True):
            length = pc.utf8_length(pc.fill_null(text, "")).to_numpy().astype(np.int64)
            sizes = np.array(pc.list_value_length(places).to_numpy(zero_copy_only=False), dtype=np.int64)
            asked = np.repeat(np.cumsum(length) - length, sizes) + pc.list_flatten(places).to_numpy(zero_copy_only=False).astype(np.int64)
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(same[asked])))
        return pa.StructArray.from_arrays(out, names=["edits", "hit", "right"])

    return run(ref, hyp, at, put)


def counted(rows: DataFrame, ref: str, hyp: str, name: str, **rules) -> DataFrame:
    """`rows` with a struct `name`: edits, chars, and the forms in the reference, read right, put out, and put out rightly (arrays, one entry each).

    Null texts are empty. A form is read right where its character is in an equal step of the alignment.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    places = lambda c: F.transform(c, lambda x: x["at"])
    names = lambda c: F.transform(c, lambda x: x["form"])
    kept = lambda c, flags: F.filter(names(c), lambda _, i: F.get(F.col(f"_s.{flags}"), i))
    one = rows.withColumns({"_own": forms(text(ref), **rules), "_put": forms(text(hyp), **rules)})
    one = one.withColumn("_s", _equal_places(text(ref), text(hyp), places(F.col("_own")), places(F.col("_put"))))
    own, put = F.col("_own"), F.col("_put")
    found = F.struct(F.col("_s.edits").alias("edits"), F.length(text(ref)).cast("long").alias("chars"), names(own).alias("ref"), kept(own, "hit").alias("hit"), names(put).alias("out"), kept(put, "right").alias("right"))
    return one.withColumn(name, found).drop("_own", "_put", "_s")


def run_report(rows: DataFrame, ref: str, hyp: str, **rules) -> DataFrame:
    """One row: recall and precision of forms, error rate of all lines and of lines without forms; null without a denominator."""
    s = counted(rows, ref, hyp, "s", **rules).select("s.*")
    plain = F.size("ref") == 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = s.agg(*[total(F.size(c)).alias(n) for c, n in (("ref", "in_reference"), ("hit", "read"), ("out", "emitted"), ("right", "emitted_right"))], total("edits").alias("edits"), total("chars").alias("chars"), F.count_if(plain).alias("lines_without_forms"), total(F.when(plain, F.col("edits"))).alias("_e"), total(F.when(plain, F.col("chars"))).alias("_c"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 9)
    return out.withColumns({"recall": rate("read", "in_reference"), "precision": rate("emitted_right", "emitted"), "cer": rate("edits", "chars"), "cer_without_forms": rate("_e", "_c")}).drop("_e", "_c", "edits", "chars")


def by_form(rows: DataFrame, ref: str, hyp: str, names: tuple = FORMS, **rules) -> DataFrame:
    """(form, in_reference, read, emitted, emitted_right) of every form, absent ones at 0."""
    s = counted(rows, ref, hyp, "s", **rules)
    kinds = {"ref": "in_reference", "hit": "read", "out": "emitted", "right": "emitted_right"}
    item = lambda c: F.transform(F.col(f"s.{c}"), lambda x: F.struct(F.lit(c).alias("kind"), x.alias("form")))
    found = s.select(F.inline(F.concat(*[item(c) for c in kinds]))).groupBy("form").agg(*[F.count_if(F.col("kind") == c).alias(n) for c, n in kinds.items()])
    known = rows.sparkSession.createDataFrame([(n,) for n in names], "form string")
    return F.broadcast(known).join(found, "form", "left").na.fill(0)  # one row per form on either side


def _formed(points: np.ndarray, sizes: np.ndarray, single: dict[str, str] = SINGLE, nasal: str = NASAL, followers: tuple = FOLLOWERS) -> tuple[np.ndarray, np.ndarray]:
    """(place, line) of each character of some lines that is a form, as by forms()."""
    named = {ord(c) for c in single if len(c) == 1}
    found = A.per_point(points, lambda p: p in named, bool)
    if len(nasal) == 1 and len(points):
        ends = np.cumsum(sizes)
        at = np.flatnonzero(points == ord(nasal))
        at = at[at + 2 < ends[np.searchsorted(ends, at, side="right")]]
        pair = points[at + 1].astype(np.int64) << 32 | points[at + 2]
        found[at[np.isin(pair, [ord(f[0]) << 32 | ord(f[1]) for f in followers if len(f) == 2])]] = True
    places = np.flatnonzero(found)
    return places, np.searchsorted(np.cumsum(sizes), places, side="right")


def _form_counters(**rules):
    """UDF of (ref, a, b): forms in the reference and per side edits, forms read right, put out and put out rightly, counted where lines are aligned."""
    fields = ["forms", *[f"{c}_{s}" for s in ("a", "b") for c in ("edits", "hit", "out", "right")]]

    @F.arrow_udf(", ".join(f"{c} long" for c in fields))
    def run(ref: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        ref = pc.fill_null(ref, "")
        number = lambda lines: np.bincount(lines, minlength=len(ref))
        own, line = _formed(*A.column_points(ref), **rules)
        out = [number(line)]
        for hyp in (a, b):
            hyp = pc.fill_null(hyp, "")
            edits, hit, right = A.outcomes(ref, hyp)
            put, row = _formed(*A.column_points(hyp), **rules)
            out += [edits, number(line[hit[own]]), number(row), number(row[right[put]])]
        return pa.StructArray.from_arrays([pa.array(c) for c in out], names=fields)

    return run


def compared(rows: DataFrame, reps: int = 10_000, seed: int = 0, **rules) -> DataFrame:
    """Recall, precision and error rates of two readings (id, cluster, ref, a, b) of the same lines, with intervals by lines and by clusters."""
    lines = rows.select("id", F.coalesce(F.nullif(F.col("cluster").cast("string"), F.lit("")), F.col("id").cast("string")).alias("cluster"), F.coalesce(F.length("ref"), F.lit(0)).cast("long").alias("chars"), _form_counters(**rules)("ref", "a", "b").alias("_s"))
    lines = lines.select("id", "cluster", "chars", "_s.*")
    plain = (F.col("forms") == 0).cast("long")
    lines = lines.withColumns({f"plain_{c}": plain * F.col(c) for c in ("chars", "edits_a", "edits_b")})
    stats = {"recall": ("hit_a", "forms", "hit_b", "forms"), "precision": ("right_a", "out_a", "right_b", "out_b"), "cer": ("edits_a", "chars", "edits_b", "chars"), "cer_without_forms": ("plain_edits_a", "plain_chars", "plain_edits_b", "plain_chars")}
    columns = list(dict.fromkeys(c for own in stats.values() for c in own))
    return ratio_report(resampled(lines, "id", "cluster", columns, reps, seed), stats)


def inserted_marks(rows: DataFrame, groups: list[str], ref: str, hyp: str, top: list[str] = TOP, bottom: list[str] = BOTTOM) -> DataFrame:
    """By group: lines, and marks above and below that the output has and the reference lacks (insertions of the alignment)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = {k: [ord(c) for c in members] for k, members in (("top", top), ("bottom", bottom))}

    @F.arrow_udf("top long, bottom long")
    def put(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        s = A.Steps(*A.texts(ref, hyp))
        return pa.StructArray.from_arrays([pa.array(s.count((s.go == 2) & np.isin(s.h, known[k]))) for k in known], names=list(known))

    one = rows.select(*groups, put(F.col(ref), F.col(hyp)).alias("s"))
    n = lambda k: F.sum(f"s.{k}").cast("long")
    return one.groupBy(*groups).agg(F.count(F.lit(1)).alias("lines"), n("top").alias("top"), n("bottom").alias("bottom"))
