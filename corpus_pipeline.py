"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of ``documents``; the last returns packed pieces.  Stages are
written as Parquet and read again, so a lost executor costs no finished stage.

Cases: null, empty and very short texts fail the base rules; a document whose
every line a document of smaller id holds is empty after line dedup and goes; of
near-duplicates the smallest id stays, of rows of one id one row, and rows
without an id are documents of their own; an empty table gives an empty result,
an empty benchmark drops nothing; other columns are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, line_dedup, near_sets, packing, quality_rules

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that one of smaller id holds; ``n_chars`` follows the text, and those of which nothing is left go."""
    kept = line_dedup.dedup_lines(docs)
    kept = kept.where((F.col("n_dropped") == 0) | (F.length(F.trim("text", F.lit(common.BLANKS))) > 0))
    return kept.select(*[F.char_length("text").cast(t).alias(c) if c == "n_chars" else common.named(c) for c, t in docs.dtypes])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates."""
    return near_sets.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the ids of every document that is left."""
    return packing.digest(packing.pack(docs, BYTE_BPE))


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Expectation-maximisation, XXH64 and the tokenizer have no SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
