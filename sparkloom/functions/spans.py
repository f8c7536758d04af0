"""Where syllables stand in a line image, names of patterns, and small rules of recognition runs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: frames are 4 columns of an image of 96 rows, and a line needs one and a half frames per character
DOWNSAMPLE, ROWS, FRAMES_PER_CHAR = 4, 96, 1.5


def is_trainable(length: Column, width: Column) -> Column:
    """Whether an image of `width` columns (96 rows) has frames enough for a text."""
    return F.floor(width / DOWNSAMPLE) >= length * FRAMES_PER_CHAR


def syllable_spans(frames: Column, sizes: Column, width: Column, height: Column, padding: float = 0.0) -> Column:
    """array<array<double>>: [from, to] of each syllable as shares of the image's width, within 0 and 1, to four places.

    frames: array<struct<first, last>>, one per character in visual order; sizes: characters of each syllable. Null where the characters do
    not add up to the frames.
    """
    margin = F.round(height * padding)
    wide, high = width + 2 * margin, height + 2 * margin
    columns = F.greatest(F.lit(float(DOWNSAMPLE)), F.round(wide * ROWS / high))
    share = lambda frame: F.round(F.least(F.greatest((frame * DOWNSAMPLE / columns * wide - margin) / width, F.lit(0.0)), F.lit(1.0)), 4)
    before = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    own = F.zip_with(before, sizes, lambda b, n: F.slice(frames, b + 1, n))
    spans = F.transform(own, lambda fs: F.array(share(F.array_min(F.transform(fs, lambda f: f["first"])).cast("double")), share(F.array_max(F.transform(fs, lambda f: f["last"])).cast("double") + 1)))
    return F.when(F.aggregate(sizes, F.lit(0), lambda a, x: a + x) == F.size(frames), spans)


@F.pandas_udf(T.StringType())
def readable_pattern(key: pd.Series) -> pd.Series:
    """A pattern of hex code points by the characters' names, letters as L."""
    gone = ("JAVANESE ", "VOWEL SIGN ", "CONSONANT SIGN ", "SIGN ")

    def name(part: str) -> str:
        if part == "L":
            return part
        full = unicodedata.name(chr(int(part, 16)), part)
        for g in gone:
            full = full.replace(g, "")
        return full.lower()

    return key.map(lambda k: None if k is None else " ".join(name(p) for p in k.split(" ")))


KINDS = {"Lo": "letter", "Mn": "mark", "Mc": "mark", "Cf": "mark", "Nd": "digit", "Po": "punctuation", "Lm": "punctuation"}


def catalogue(rows: DataFrame, text: str, first: int = 0xA980, last: int = 0xA9DF) -> DataFrame:
    """(ch, code, name, kind, n): every assigned character of a block, with how often it occurs in the texts, 0 included."""
    known = [(chr(c), f"U+{c:04X}", unicodedata.name(chr(c)), KINDS.get(unicodedata.category(chr(c)), "other")) for c in range(first, last + 1) if unicodedata.name(chr(c), "")]
    block = rows.sparkSession.createDataFrame(known, "ch string, code string, name string, kind string")
    n = rows.select(F.explode(F.regexp_extract_all(text, F.lit(rf"[\x{{{first:X}}}-\x{{{last:X}}}]"), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(block).join(n, "ch", "left").na.fill(0, ["n"])  # at most one row per character of the block


def recorded_fonts(pipelines: DataFrame, config: str) -> DataFrame:
    """(run, fonts): the number of training fonts that a configuration text states for its run; the last of a run by text counts."""
    run, fonts = F.regexp_extract(config, r"^crnn:([A-Za-z0-9_]+)", 1), F.regexp_extract(config, r"(\d+) font\b", 1)
    return pipelines.select(run.alias("run"), fonts.alias("f"), F.col(config).alias("c")).where("run <> '' and f <> ''").groupBy("run").agg(F.max_by(F.col("f").cast("int"), "c").alias("fonts"))
