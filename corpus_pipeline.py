"""A corpus through five stages: toxicity, near-duplicates, benchmark leaks, mixing, token ids.

Each stage works on all that its predecessor kept, written as Parquet and read again in between. An empty table stays
empty; a null text counts as empty everywhere, and empty texts are one near-duplicate group; rows with equal id, text
and source are interchangeable, and one of them stays after near_dedup; texts are read whole, however long; more columns,
whatever their names, go along up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import decontaminate, mixing, simhash, token_store, toxicity
from arbora.llm.common import new_path, table
from arbora.llm.queries import TOXIC_AT, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model is fitted on these documents' labels."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), TOXIC_AT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 or more, by their SimHash."""
    return simhash.keep_one(docs, simhash.similar_documents(docs, width=5, similarity=0.8))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no test item leaks."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights: a row for each copy taken."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, written and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_store.stored(docs, tokenizer_file())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("mix", mix_sources), ("tokens", write_tokens)]

#: Learnt scores, alignment and tokenizers are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
