"""From raw documents to token ids in five stages; each works on all that the one before kept.

1. quality: documents that the weak-label classifier rejects go.
2. exact_dedup: of equal texts the one with the largest doc_id stays.
3. ngram_jaccard: of a group of near copies the one with the smallest doc_id stays.
4. mixing: sources are mixed to their weights; a document stands in the mix as often as it is taken, or not at all.
5. bpe: the mix as token ids.

The classifier is trained, groups are closed over links and the BPE automaton is compiled, which SQL can't express: there is no
SQL for the rows, and the tests hold them against a plain version of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, exact, mixing, ngram, quality
from paperloom.llm.registry import vocabulary_path
from paperloom.llm.shared import cut, table

ORACLE_SQL: str | None = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram.keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_docs(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document of the mix."""
    encoded = bpe.encode(docs, vocabulary_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
