"""Whether an evaluation report may count as a gate, and whether a run is what its declaration says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: lines of an official synthetic gate, its only font, and the augmentation of each
OFFICIAL_LINES, FONT = 10_000, "javatext.ttf"
AUGMENTED = {"G1": "none", "G2": "heavy"}


def gate_problems(reports: DataFrame, real_lines: int) -> DataFrame:
    """(code, run, problem) of reports (code, run, goal, checkpoint, split, augment, pad_ratio, results: map of font to (lines, rejected)): the first rule that a report breaks, else ''.

    The synthetic gates take the test split, one font and one augmentation, and count lines that were rejected for width; the gate on real lines
    takes all of them and no padding. The results hold the whole under `semua`.
    """
    code = F.col("code")
    said = lambda *parts: F.concat_ws(" ", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    total = F.coalesce(F.try_element_at("results", F.lit("semua"))["lines"], F.lit(0))
    own = F.try_element_at("results", F.lit(FONT))
    fonts = F.array_sort(F.filter(F.map_keys("results"), lambda k: k != "semua"))
    folder = F.regexp_extract(F.coalesce("checkpoint", F.lit("")), r"([^/\\]*)[/\\][^/\\]*$", 1)
    wanted = F.element_at(F.create_map(*[F.lit(x) for p in AUGMENTED.items() for x in p]), code)
    real, counted = code == "G3", total + F.coalesce(own["rejected"], F.lit(0))
    rules = [
        (~F.col("goal").eqNullSafe(code), said("goal", shown("goal"), "instead of", code)),
        (folder != F.col("run"), said("checkpoint", shown("checkpoint"), "is not of run", F.col("run"))),
        (real & (F.coalesce("pad_ratio", F.lit(0.0)) != 0), said("padding", shown("pad_ratio"))),
        (real & (total != real_lines), said(total.cast("string"), f"lines instead of {real_lines}")),
        (~real & (~F.col("split").eqNullSafe(F.lit("test")) | ~F.col("augment").eqNullSafe(wanted)), said("split", shown("split"), "and augmentation", shown("augment"), "instead of test and", wanted)),
        (~real & (fonts != F.array(F.lit(FONT))), said("fonts", F.array_join(fonts, ", "), "instead of", FONT)),
        (~real & (counted != OFFICIAL_LINES), said(counted.cast("string"), f"lines instead of {OFFICIAL_LINES}")),
    ]
    return reports.select("code", "run", F.coalesce(*[F.when(broken, what) for broken, what in rules], F.lit("")).alias("problem"))


#: Declared switches and the options that they govern: all above 0 where declared, the first at 0 where not.
SWITCHES = {"track": ("track_prob", "track_max"), "standard": ("standard_prob",), "slant": ("slant_prob", "slant_max"), "neighbor": ("neighbor_prob",)}


def run_problems(specs: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, problem) of declared runs (key, run, track, standard, slant, fixes, neighbor, rare, filtered) against what is recorded (key, name, step, steps, options).

    A run without a record is missing and nothing else is said of it. Null options are 0 and null switches off. Every broken rule is a row.
    """
    option = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    met = specs.join(runs.withColumn("_known", F.lit(True)), "key", "left")
    rules = [(~F.col("name").eqNullSafe(F.col("run")), "record of another run"), (~(option("steps") > 0) | ~F.col("step").eqNullSafe(F.col("steps")), "run not finished")]
    for switch, options in SWITCHES.items():
        low = None
        for o in options:
            low = option(o) <= 0 if low is None else low | (option(o) <= 0)
        rules += [(on(switch) & low, f"{switch} declared, but off"), (~on(switch) & (option(options[0]) != 0), f"{switch} not declared, but on")]
    rare, tight = on("rare"), on("filtered")
    rules += [
        (on("fixes") != on("font_fixes"), "font fixes differ from the declaration"),
        (rare & ~(option("rare_insert_prob") > 0), "rare declared, but off"),
        (~rare & ((option("rare_insert_prob") != 0) | (option("rare_opener_prob") != 0)), "rare not declared, but on"),
        (rare & tight & ~((option("rare_max_similarity") > 0) & on("rare_attach")), "filtered declared, but off"),
        (rare & ~tight & ((option("rare_max_similarity") != 0) | on("rare_attach")), "filtered not declared, but on"),
    ]
    found = F.array_compact(F.array(*[F.when(broken, F.lit(what)) for broken, what in rules]))
    return met.select("key", F.explode(F.when(F.col("_known"), found).otherwise(F.array(F.lit("no record")))).alias("problem"))
