"""A corpus pipeline of five stages: toxicity, line dedup, near duplicates, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Nulls, empty texts, repeated rows and extra columns are handled as each operator states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, common, decontaminate, jaccard_join, line_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, by a lexicon learnt from the labelled ones among them, is below 0.5."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, common.read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line of five words or more kept at one place of the corpus."""
    return line_dedup.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over word 5-grams, the document with the smallest doc_id.

    Documents without words are no group and stay, as do rows of null doc_id."""
    found = jaccard_join.groups(docs)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(jaccard_join.within(gone), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with benchmark items; those that are little else go."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the token ids and of the decoded bytes."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("encoding", encode),
]

#: The stages fit models and match fuzzily, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    at = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{number}-{name}")
        docs = spark.read.parquet(f"{at}/{number}-{name}")
    return docs
