"""A corpus pipeline of five stages: toxicity, quality, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs; the result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents; the last adds n_tokens, token_ids and round_trip.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunder.llm import bpe, decontaminate, pu_quality, simhash, toxicity
from sunder.llm.common import dropped, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score below 0.5 stay. Labels are learned from rows that aren't held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), model) < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a quality score of at least 0.3 stay."""
    model = pu_quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(pu_quality.score(F.col("text"), model) >= pu_quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the smallest id stays."""
    return simhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; round_trip says whether the ids decode to the text's bytes."""
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(*docs.columns, F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("tokens", tokenise)]

#: SQL has no character lattices, trained classifiers, SimHash or BPE. tests/llm/test_pipeline.py compares near_duplicates, decontamination and tokens with brute force; of
#: the classifiers, tests have the accuracy on held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)  # the next stage reads the last one only
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
