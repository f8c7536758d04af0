"""Evaluation operators: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import alignment as A
from sparkloom.functions import metrics as M
from sparkloom.functions import stats as S

R9 = lambda c: F.round(c, 9)


def summary_sets(rows: DataFrame, groups: list[str], ref: str, hyp: str) -> DataFrame:
    """Error rates by each of `groups` and over all, in one pass of grouping sets."""
    sets = [[F.col(g)] for g in groups] + [[]]
    # distances once per row: the grouping sets repeat rows, not work
    measured = rows.select(*groups, M.edits(ref, hyp).alias("_edits"), M.edits_no_space(ref, hyp).alias("_bare"), F.length(ref).alias("_ref"), F.greatest(F.length(ref), F.length(hyp)).alias("_long"), (F.col(ref) == F.col(hyp)).cast("double").alias("_same"))
    return measured.groupingSets(sets, *[F.col(g) for g in groups]).agg(*M.summary_of("_edits", "_bare", "_ref", "_long", "_same"))


def worst(rows: DataFrame, ref: str, hyp: str, order: list[str], k: int = 20) -> DataFrame:
    """The k lines of highest rate; exact ones among them drop out afterwards."""
    top = rows.select(*order, F.col(ref).alias("ref"), F.col(hyp).alias("hyp"), M.line_cer(ref, hyp).alias("q")).orderBy(F.desc("q"), *order).limit(k)
    return top.where("ref <> hyp").select(*order, "ref", "hyp", R9(F.col("q")).alias("cer"))


def parts(rows: DataFrame, kind: str, page: str, ref: str, hyp: str) -> DataFrame:
    return rows.groupBy(kind).agg(R9(M.cer(ref, hyp)).alias("cer"), F.count(F.lit(1)).alias("lines"), F.count_distinct(page).alias("pages"), F.sum(F.length(ref)).alias("chars"))


def parts_add_up(found: DataFrame, whole: Column, tolerance: float = 1e-6) -> Column:
    """Parts weighted by characters must give the whole."""
    return F.abs(F.sum(F.col("cer") * F.col("chars")) / F.sum("chars") - whole) <= tolerance


def gates(rows: DataFrame, ref: str, spec: dict[str, tuple[str, float]]) -> DataFrame:
    """(code, value, target, passed): one pass for all gates."""
    wide = rows.agg(*[R9(M.cer(ref, hyp)).alias(code) for code, (hyp, _) in spec.items()])
    one = F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("value"), F.lit(target).alias("target")) for code, (_, target) in spec.items()])
    return wide.select(F.inline(one)).withColumn("passed", F.col("value") < F.col("target"))


def method_scores(rows: DataFrame, page: str, subset: str, ref: str, methods: dict[str, str], reference: str) -> DataFrame:
    """Figures of each method in each subset, and its rate less the reference method's."""
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(h).alias("hyp")) for m, h in methods.items()])
    long = rows.select(F.col(page).alias("page"), subset, F.col(ref).alias("ref"), F.inline(pairs))
    edits = M.edits("ref", "hyp")
    out = long.groupBy("method", subset).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("page").alias("pages"), F.sum(F.length("ref")).alias("chars"), R9(M.cer("ref", "hyp")).alias("cer"), R9(M.ned("ref", "hyp")).alias("ned"), R9(M.exact("ref", "hyp")).alias("exact"), R9(F.avg((edits >= F.length("ref")).cast("double"))).alias("collapsed")
    )
    base = F.max(F.when(F.col("method") == reference, F.col("cer"))).over(Window.partitionBy(subset))
    return out.withColumn("delta", R9(F.col("cer") - base))


def paired_lines(rows: DataFrame, groups: list[str], ref: str, a: str, b: str) -> DataFrame:
    return rows.select(*groups, M.edits(ref, a).alias("x"), M.edits(ref, b).alias("y")).groupBy(*groups).agg(*S.paired_counts("x", "y"))


def paired_clusters(rows: DataFrame, cluster: str, ref: str, a: str, b: str) -> DataFrame:
    per = rows.groupBy(cluster).agg(F.sum(M.edits(ref, a)).alias("x"), F.sum(M.edits(ref, b)).alias("y"))
    return per.agg(*S.paired_counts("x", "y"))


def cluster_sizes(rows: DataFrame, cluster: str) -> DataFrame:
    return rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("clusters"), F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))


def integrity_violations(lines: DataFrame, preds: DataFrame, a: str, b: str, common_only: bool = False, tolerance: float = 1e-6) -> DataFrame:
    """(problem, id): what keeps lines (id, ref) and predictions (id, pipeline, text, cer) from pairing."""
    v = lambda df, what: df.select(F.lit(what).alias("problem"), "id")
    keys = preds.select("id", "pipeline").distinct()
    found = v(lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate line")
    found = found.unionByName(v(preds.groupBy("id", "pipeline").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate prediction"))
    found = found.unionByName(v(keys.join(lines, "id", "left_anti"), "unknown line"))
    if not common_only:
        wanted = lines.select("id", F.explode(F.array(F.lit(a), F.lit(b))).alias("pipeline"))
        found = found.unionByName(v(wanted.join(keys, ["id", "pipeline"], "left_anti"), "missing prediction"))
    again = preds.join(lines, "id").where(F.abs(F.col("cer") - M.line_cer("ref", "text")) > tolerance)
    return found.unionByName(v(again, "stored rate differs"))


def _steps(rows: DataFrame, ref: str, hyp: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.inline(A.alignment(F.col(ref), F.col(hyp))))


def confusion(rows: DataFrame, ref: str, hyp: str) -> DataFrame:
    """(kind, ref, hyp, n) of the edit steps, spaces left out of both texts."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    steps = rows.select(F.inline(A.alignment(bare(ref), bare(hyp)))).where("tag <> 'equal'")
    kind = F.expr("CASE tag WHEN 'replace' THEN 'sub' WHEN 'delete' THEN 'del' ELSE 'ins' END")
    return steps.groupBy(kind.alias("kind"), F.coalesce("r", F.lit("")).alias("ref"), F.coalesce("h", F.lit("")).alias("hyp")).agg(F.count(F.lit(1)).alias("n"))


def recall_precision(rows: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Per character: occurrences, hits, outputs, recall and precision (null where it does not occur)."""
    s = _steps(rows, ref, hyp)
    both = F.array(F.struct(F.col("r").alias("ch"), F.lit(1).alias("ref"), (F.col("tag") == "equal").cast("int").alias("hit"), F.lit(0).alias("out")), F.struct(F.col("h").alias("ch"), F.lit(0).alias("ref"), F.lit(0).alias("hit"), F.lit(1).alias("out")))
    long = s.select(F.inline(both)).where("ch is not null")
    out = long.groupBy("ch").agg(F.sum("ref").alias("ref"), F.sum("hit").alias("hits"), F.sum("out").alias("emitted"))
    return out.withColumn("recall", R9(M.ratio(F.col("hits"), F.col("ref")))).withColumn("precision", R9(M.ratio(F.col("hits"), F.col("emitted"))))


def top_misreads(rows: DataFrame, ref: str, hyp: str, k: int) -> DataFrame:
    """What each reference character is read as when it is not read right: the k most frequent ('' is not read)."""
    s = _steps(rows, ref, hyp).where("r is not null and tag <> 'equal'").groupBy(F.col("r").alias("ch"), F.coalesce("h", F.lit("")).alias("read_as")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ch").orderBy(F.desc("n"), "read_as")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def gap_pairing(rows: DataFrame, groups: list[str], ref: str, hyp: str) -> DataFrame:
    """Spaces of both sides, those that stand in the same gap, and false ones, by group."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    n = lambda c: F.length(c) - F.length(bare(c))
    one = rows.select(*groups, n(ref).alias("r"), n(hyp).alias("h"), A.matched_spaces(F.col(ref), F.col(hyp)).alias("m"))
    return one.groupBy(*groups).agg(F.sum("r").alias("ref_spaces"), F.sum("h").alias("hyp_spaces"), F.sum("m").alias("matched"), F.sum(F.col("h") - F.col("m")).alias("false_spaces"))


def explorer(rows: DataFrame, page: int, size: int) -> DataFrame:
    """One page of lines with both readings' rates, those with a comma, largest difference first."""
    tag = F.when((F.col("ref") == F.col("a")) | (F.col("ref") == F.col("b")), "exact").otherwise("wrong")
    out = rows.where(F.array_contains(F.split("ref", ""), ",")).select("page", "line_no", "lang", R9(M.line_cer("ref", "a")).alias("a_cer"), R9(M.line_cer("ref", "b")).alias("b_cer"), tag.alias("tag"))
    return out.orderBy((F.col("a_cer") - F.col("b_cer")).desc_nulls_last(), "page", "line_no").offset(page * size).limit(size)


def delta_signs(rows: DataFrame, groups: list[str], ref: str, a: str, b: str) -> DataFrame:
    x, y = M.edits(ref, a), M.edits(ref, b)
    return rows.groupBy(*groups).agg(F.count_if(y < x).alias("better"), F.count_if(y > x).alias("worse"), F.count_if(y == x).alias("same"))


def dose(rows: DataFrame, level: str, most: int, ref: str, a: str, b: str) -> DataFrame:
    """Difference of the rates by level of a condition, levels from `most` on as one."""
    x, y, n = F.sum(M.edits(ref, a)), F.sum(M.edits(ref, b)), F.sum(F.length(ref))
    return rows.groupBy(F.least(level, F.lit(most)).cast("long").alias("dose")).agg(F.count(F.lit(1)).alias("lines"), R9(x / n - y / n).alias("diff"), R9(M.ratio(x, y)).alias("odds"))
