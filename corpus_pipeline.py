"""A training-corpus pipeline of five stages over `documents`. Counts as part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane.llm.bpe import bpe_encode
from paravane.llm.common import table, written
from paravane.llm.decontaminate import decontaminate
from paravane.llm.line_dedup import drop_frequent_lines
from paravane.llm.near_dedup import keep_one_of_each
from paravane.llm.quality import keep_good
from paravane.llm.queries import vocab_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go, and n_chars follows the text (null for a null text)."""
    out = drop_frequent_lines(docs, min_docs=10).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_encode(docs, vocab_path())


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmark), ("bpe", tokens)]

#: SQL can't express the trained classifier, the edit distance to substrings or the byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
