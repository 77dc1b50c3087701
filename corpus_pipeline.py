"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens. Part of the llm subpackage.

Defined cases, of every stage but the last, which returns the columns of its input: null and empty texts fail the quality
rules, so no later stage of run() sees one (alone, line dedup and near-dedup keep them, and they match no item); rows that
repeat are judged each on its own by the rules and the items, and one of them stays after line dedup and near-dedup, the
first by id, then file and place; null ids come first in line dedup and last in near-dedup; ties are broken the same way;
an empty table, of documents or items, gives an empty result or loses nothing; texts of any length are taken whole; other
columns pass through, whatever their names. The last stage gives a row for each row of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm.bpe import bpe
from leafquarry.llm.common import Scratch, table
from leafquarry.llm.decontaminate import decontaminate
from leafquarry.llm.line_dedup import line_dedup
from leafquarry.llm.near_dedup import deduplicate
from leafquarry.llm.quality_rules import passing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and with them documents of which nothing else is left."""
    cut = line_dedup(docs)
    cut = cut.where(~F.col(cut.columns[-1]))  # `emptied`, or another name where docs has one of its own
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; links are from a similarity of 0.8 on."""
    return deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's tokens, with the digests of the ids and of the text decoded from them."""
    return bpe(docs, keep=("lang", "source"), ids=True, digests=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", benchmark_leaks), ("bpe", tokens)]

#: SQL can express neither the perplexity model nor the token merges; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage over all that the one before kept, written and read again in between."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs)
    return docs
