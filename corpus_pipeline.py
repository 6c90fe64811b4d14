"""From raw documents to packed training sequences: toxicity, exact copies, near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept,
and returns the columns of documents; the last returns one row for each packed piece
with its token ids. Only ids move in the joins that drop or repeat rows, as long as
they fit a checked broadcast; beyond that the texts are shuffled by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import op1_toxicity as toxicity
from touchline.llm import op2_packing as packing
from touchline.llm import op4_exact_dedup as exact
from touchline.llm import op5_mixing as mixing
from touchline.llm import op6_ngram_join as near
from touchline.llm.common import release, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    score = toxicity.scorer(spark, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score(F.col("text")) < toxicity.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest doc_id."""
    return near.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.remixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their place in a sequence."""
    return packing.packed(docs, packing.tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near duplicates", drop_near_copies),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage scores by a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = staged(stage(spark, docs, sf_dir), f"stage{k + 1}")
        if k:
            release(docs)  # written anew, so no later plan reads it
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
