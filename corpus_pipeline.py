"""A training corpus from ``documents``: quality rules, line and near deduplication, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.line_dedup import dedup_lines
from lumaframe.llm.mixing import in_mixed_order, in_written_order, mix_sources
from lumaframe.llm.near_dedup import near_duplicates
from lumaframe.llm.packing import pack_documents
from lumaframe.llm.quality_rules import fit_rules, judge_quality
from lumaframe.llm.queries import TOKENIZER
from lumaframe.llm.scratch import Scratch

#: Columns of ``documents``; every stage but the last returns these.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that the learned decision list keeps.

    Null and empty texts fail the base rules and go. Null or repeated ids and
    repeated rows are judged row by row; without labels only the base rules
    count. Empty input gives empty output.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_quality(docs.select(*COLUMNS), fit_rules(docs, labels)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Texts without repeated three-line windows; documents that become empty keep their row.

    Null texts and rows without id stay as they are; rows that repeat an id
    are one document.
    """
    cut = dedup_lines(docs.select(*COLUMNS), scratch=scratch)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id.

    Texts that are null or without words and rows without id stay; rows that
    repeat an id stay or go together.
    """
    groups = near_duplicates(docs, width=5, percent=80, scratch=scratch)
    dropped = groups.where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """All documents, written in the order that mixes the sources to their target weights.

    A null source is a source of its own; null and repeated ids and repeated
    rows keep their rows.
    """
    return in_mixed_order(mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens, packed in the mixed order.

    The order is that of the files and rows that mixing wrote; nothing is mixed
    again. Sequence ids follow it by each sequence's first piece; what a
    partition's open windows hold at its end is merged into sequences after all
    others.
    """
    ordered = in_written_order(docs.select(*COLUMNS))
    packed = pack_documents(ordered, public_tokenizers.path(TOKENIZER), size=2048, end_id=1, scratch=scratch)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: Learned thresholds, similarity groups and tokenization are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's intermediate tables go when its output is written, its input when the next output is."""
    docs, corpus, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:
            docs = corpus.write(stage(spark, docs, sf_dir, scratch), name)
        if written is not None:
            corpus.discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
