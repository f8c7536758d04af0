"""The corpus pipeline: quality rules, line dedup, near-duplicate join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the
shared checkpoint folder and reads them again as the next stage's docs. All stages but the last return the columns
of documents. Stages work on every row that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.jaccard_join import jaccard_classes
from sparkloom.llm.line_dedup import remove_boilerplate
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.quality_rules import apply_rules
from sparkloom.llm.storage import materialize
from sparkloom.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The input row of `out` with its new text, and n_chars to match where there is such a column."""
    chars = F.length(F.coalesce(out["text"], F.lit("")))
    new = {"text": out["text"], "n_chars": chars.cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep; rejected ones go. Null and empty texts are rejected; repeated rows are judged each; an empty table gives an empty table."""
    judged = apply_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines removed, all but their first place. Every document stays, if only as an empty text; null texts stay null; an empty table gives an empty table."""
    return _same_columns(remove_boilerplate(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join: the one of smallest id.

    Of rows that repeat its id and text, one stays; documents without an id stay, as none of them is the first. Documents whose texts are null or
    have no words stay; an empty table gives an empty table; other columns are kept, whatever their names.
    """
    classes = jaccard_classes(docs).where("doc_id is null or doc_id = component_id").select("doc_id").distinct()
    own = "kept_id"
    while own in docs.columns:
        own += "_"
    kept = docs.join(classes.withColumnRenamed("doc_id", own).hint("merge"), docs["doc_id"].eqNullSafe(F.col(own)), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("one")) if rest else kept.distinct()
    return one.select(*[F.col("one")[c].alias(c) if c in rest else F.col(c) for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of 20-word windows removed. A text that repeats nothing stays as it was, white space included; null texts stay null, an empty table gives an empty table."""
    out = remove_repeats(docs)
    text = F.when(out["n_removed"] == 0, F.col("row")["text"]).otherwise(out["text"])
    return _same_columns(out.withColumn("text", text), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the packed sequences; null and empty texts are pieces of no words, an empty table gives an empty table."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", near_duplicates), ("substring_dedup", substring_dedup), ("best_fit_packing", packing)]
#: The verdicts of the first stage and the packing cannot be put into SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; the result is the last stage's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
