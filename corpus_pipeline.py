"""A training-data pipeline over `documents`: clean, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents, whatever these are; where a stage changes a text it also restates n_chars, if there is such a column. An empty table
passes through as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, near_copies, packing, quality_rules
from tidemark.llm.common import written
from tidemark.llm.queries import documents, tokenizer_path


def _with_text(docs: DataFrame, text: Column) -> list[Column]:
    """The fields of the struct column `doc`, with another text."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return [(new[c] if c in new else F.col("doc").getField(c)).alias(c) for c in docs.columns]


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; the others lose the lines that fail. Rows are judged alone, so repeated ones alike."""
    kept = quality_rules.judge(docs).where("quality.kept")
    return kept.select(*_with_text(docs, F.col("quality.clean_text")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that has lost every word goes with them, one that had none stays. Rows of one id are one document; a null id keeps its lines."""
    kept = line_dedup.drop_lines(docs)
    return kept.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(quality_rules.WORD)).select(*_with_text(docs, F.col("kept_text")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: five-word shingles, a similarity of 0.8 or more. Of equal rows the first stays, null ids come last."""
    return near_copies.without_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it, with what mixing defines for odd rows."""
    return mixing.mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each copy with their sequences and offsets; an empty text is one piece with the end id, a repeated row is packed again."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [("quality_rules", quality_rules_stage), ("line_dedup", line_dedup_stage), ("simhash", simhash_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Linked components and best-fit bins have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
