"""Corpus pipeline over the documents table: from raw documents to token codes.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. The order that mixing gives is lost
when its files are read (splits are planned by size), so the last stage takes it from the places of the rows in
the files, keeps it as a column and sorts by it.

Defined results. Stages that drop rows judge every row by its own text, whatever its doc_id: a null or repeated one changes nothing. Rows
with null or empty texts, or without letters and digits, are clean: they pass all stages and end as codes without tokens. Very long texts are judged
whole. Repeated rows (same doc_id and text) are one document: they stay or go together. Extra columns are kept up to the last stage, whatever
their names. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import decontaminate, jaccard, mixing, token_output, toxicity
from threadloom.llm._spark import durable, placed


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It is fitted on those of ``docs`` that labels name; where these lack a class nobody
    goes. A score that ties with the language's threshold stays; a null language has the threshold of all. See toxicity for the rest."""
    return toxicity.drop_toxic(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays (one without only where no other has one; of ties the one
    with the least hash of its text). A document without a partner stays. See jaccard for the rest."""
    return jaccard.drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty items are nowhere. A subsequence just as long as asked for (a tie) is a
    leak. See decontaminate for the rest."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the curriculum; those of scarce sources come again. None is lost: null sources are one source, empty texts
    take no room, ties are ordered by the text's hash. See mixing for the rest."""
    return mixing.mixed(docs)


def token_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, codes of every row, and its place in the curriculum, in the order of places (no two rows have one place). Null and
    empty texts have no tokens, null doc_ids stay null. See token_output for the rest."""
    return token_output.token_output(placed(docs, "place", "doc_id", "text").orderBy("place"), place="place")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_codes),
]

#: A trained classifier, latent retrieval and a tokenizer can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each one's rows written to the shared folder and reread."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs, f"stage{k}")
    return docs
