"""Corpus construction: paragraphs, lines, filters, first-wins dedup, hash split, injection, statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X

MIN_LEN, MAX_LEN = 20, 80
MIN_WORDS = 5


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, par, words): paragraphs of at least MIN_WORDS valid words; the word array keeps nulls where a line breaks.

    The words come out of a generator, through which the filter is not pushed: they are cleaned once, not per use.
    """
    out = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("par", "raw"))
    words = out.select("doc", F.col("par").cast("long").alias("par"), F.inline(F.array(F.struct(X.clean_words(F.col("raw")).alias("words")))))
    return words.where(X.n_valid(F.col("words")) >= MIN_WORDS)


def _target(seed: int, doc, par: int, turn: int) -> int:
    """A line length from 20 to 80 by hash; the same for a paragraph on any cluster."""
    h = int.from_bytes(hashlib.md5(f"{seed}:{doc}:{par}:{turn}".encode()).digest()[:8], "big")
    return MIN_LEN + h % (MAX_LEN - MIN_LEN + 1)


def chunk(words: list, seed: int, doc, par: int) -> list[str]:
    """Lines of 20 to 80 characters at word borders; a null word breaks, shorter rests go."""
    lines, now, size, turn = [], [], 0, 0
    target = _target(seed, doc, par, 0)
    for word in [*words, None]:
        broken = word is None or len(word) > MAX_LEN
        grown = 0 if broken else size + len(word) + bool(now)
        if broken or (grown > target and size >= MIN_LEN) or grown > MAX_LEN:
            if size >= MIN_LEN:
                lines.append(" ".join(now))
            now, size, turn = [], 0, turn + 1
            target = _target(seed, doc, par, turn)
        if not broken:
            size += len(word) + bool(now)
            now.append(word)
    return lines


def chunk_lines(pars: DataFrame, seed: int = 1234) -> DataFrame:
    """(doc, par, line, text) of paragraphs(); sequential inside a paragraph, so one Arrow-batched step.

    Words hold no white space: a paragraph travels as one string, with a line feed in the place of each break.
    """
    schema = pa.schema([("doc", pa.int64()), ("par", pa.int64()), ("line", pa.int64()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, par, joined in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = [None if w == "\n" else w for w in joined.split(" ")]
                found += [(doc, par, i, t) for i, t in enumerate(chunk(words, seed, doc, par))]
            columns = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pars.select("doc", "par", F.array_join("words", " ", "\n")).mapInArrow(cut, "doc long, par long, line long, text string")


def dedup_first(lines: DataFrame, text: str, order: list[str]) -> DataFrame:
    """`first`: whether a row is the first of its text in a total order; null texts are equal. Only keys are grouped, texts are not sorted."""
    lead = lines.groupBy(F.col(text).alias("_text")).agg(F.min(F.struct(*order)).alias("_lead"))
    return lines.join(lead, lines[text].eqNullSafe(lead["_text"])).withColumn("first", F.struct(*order).eqNullSafe(F.col("_lead"))).drop("_lead", "_text")


def leakage(lines: DataFrame, split: str, text: str) -> DataFrame:
    """Distinct texts that two splits share, summed over the pairs of splits."""
    n = lines.groupBy(text).agg(F.count_distinct(split).alias("n"))
    return n.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("leaked"))


def length_histogram(lines: DataFrame, text: str, least: int = MIN_LEN) -> DataFrame:
    """(bucket, lines) in tens from `least` on, empty buckets included, 80 counted in the last."""
    spark = lines.sparkSession
    got = lines.groupBy((F.floor(F.least(F.length(text), F.lit(MAX_LEN - 1)) / 10) * 10).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    wanted = spark.range(least, MAX_LEN, 10).select(F.col("id").alias("bucket"))
    return wanted.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("lines"))


def histogram_shares(histogram: DataFrame) -> DataFrame:
    """Share of the whole and width against the fullest bucket; a histogram has few rows."""
    w = Window.partitionBy()
    return histogram.select("bucket", "lines", F.round(F.try_divide(F.col("lines").cast("double"), F.sum("lines").over(w)), 9).alias("share"), F.round(F.try_divide(F.col("lines") * 100.0, F.max("lines").over(w)), 2).alias("width"))


def char_counts(rows: DataFrame, text: str) -> DataFrame:
    return rows.select(F.explode(F.split(text, "", -1)).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def line_frequency(rows: DataFrame, text: str) -> DataFrame:
    """(ch, df): rows that hold a character."""
    return rows.select(F.explode(F.array_distinct(F.split(text, "", -1))).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("df"))


def rare_chars(rows: DataFrame, text: str, vocab: DataFrame, share: float = 0.001) -> DataFrame:
    """Vocabulary characters that stand in less than `share` of the rows, absent ones at 0."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = vocab.join(line_frequency(rows, text), "ch", "left").crossJoin(F.broadcast(total)).select("ch", F.coalesce("df", F.lit(0)).alias("df"), "total")
    return out.where(F.col("df") < F.greatest(F.lit(1), F.col("total")) * share).select("ch", "df")


def group_split(sources: DataFrame, key: str, rows: str, test: int, val: int, seed: int = 7) -> DataFrame:
    """Whole groups in hash order: to test until it has `test` rows, then to val, the rest to train.

    `sources` has one row per group, so the running sums order groups, not rows.
    """
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key)
    before = F.coalesce(F.sum(rows).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sources.withColumn("before", before).withColumn("split", F.when(F.col("before") < test, "test"))
    rest = F.coalesce(F.sum(F.when(F.col("split").isNull(), F.col(rows)).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("split", F.coalesce("split", F.when(rest < val, "val").otherwise("train"))).select(key, rows, "split")


def deficits(rows: DataFrame, text: str, vocab: DataFrame, least: int) -> DataFrame:
    """(ch, n, missing): vocabulary characters that occur less than `least` times."""
    out = vocab.join(char_counts(rows, text), "ch", "left").select("ch", F.coalesce("n", F.lit(0)).alias("n"))
    return out.where(F.col("n") < least).withColumn("missing", F.lit(least) - F.col("n"))


def inject(rows: DataFrame, text: str, key: str, vocab: DataFrame, least: int, seed: int = 1234) -> DataFrame:
    """(ch, text): synthetic lines that lift each missing character to `least`, one per host line.

    Hosts are the lines of least hash per character; the character goes to a hash-chosen place. One pass: counts
    are not updated while it draws, so a character may end above `least`.
    """
    few = deficits(rows, text, vocab, least).select("ch", "missing")
    hosts = rows.where(F.length(text) <= MAX_LEN - 2).select(F.col(key).alias("host"), F.col(text).alias("line"))
    top = hosts.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "host"))).orderBy("h", "host").limit(least)
    numbered = top.withColumn("at", F.row_number().over(Window.orderBy("h", "host")))
    met = numbered.join(F.broadcast(few), F.col("at") <= F.col("missing"))
    place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "ch", "host")), 25, 8), 16, 10).cast("long"), F.length("line") + 1).cast("int")
    return met.select("ch", F.concat(F.substring("line", F.lit(1), place), "ch", F.expr("substring(line, cast(pmod(cast(conv(substring(md5(concat_ws(':', ch, host)), 25, 8), 16, 10) as bigint), length(line) + 1) as int) + 1)")).alias("text")).distinct()


def funnel(pars: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents, paragraphs, words, vocabulary, lines, duplicates, kept lines; kept is lines less duplicates.

    Paragraphs are read once: each gives its document and its words as items, counted by kind and value.
    """
    item = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    words = F.transform(F.filter("words", lambda w: w.isNotNull()), lambda w: item("word", w))
    items = pars.select(F.inline(F.concat(F.array(item("doc", F.col("doc").cast("string"))), words))).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    doc = F.col("kind") == "doc"
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    one = items.agg(F.count_if(doc & F.col("value").isNotNull()).alias("articles"), total(doc).alias("paragraphs"), total(~doc).alias("words"), F.count_if(~doc).alias("vocab"))
    two = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("first")).alias("duplicates"), F.count_if("first").alias("kept"))
    return one.crossJoin(two)


def ordered_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in hash order: a smaller sample is the beginning of a larger one."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key).limit(n)


def drop_spaces(text: Column, key: Column, share: float) -> Column:
    """Spaces removed from a hash-chosen share of the rows."""
    u = F.conv(F.substring(F.md5(key.cast("string")), 25, 8), 16, 10).cast("double") / 2**32
    return F.when(u < share, F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)
