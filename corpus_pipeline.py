"""A corpus pipeline in five stages, each over all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the
shared folder and reads it again as the next stage's docs. All but the last return the columns of
documents. A stage's rows are deleted once the next one's are written.

Defined cases, for every stage: a null or empty text has no language and goes with the first
stage (the others keep it: no words, no hits, no tokens); rows are told apart by doc_id and text,
so a shared or missing doc_id costs no other row, and repeated rows are one component of which one
stays; very long texts are read whole; an empty table gives an empty result; columns of any name
beside those of documents stay as they are up to the mixture. ORACLE_SQL is None: SQL can express neither the language model nor the tokenizer;
tests/llm compares run() with a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import count_vectors, decontaminate, grammar_shards, langid, mixture
from wakeline.llm.tables import discard, read, ready, shared_dir

MIN_SCORE, TOKEN_SHARE = 0.5, 0.8
ORACLE_SQL = None


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of no language (no letter) or a score under MIN_SCORE."""
    ready(spark)
    return langid.of_known_language(docs, MIN_SCORE)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, of its smallest doc_id; documents without words stay."""
    ready(spark)
    return count_vectors.one_of_each(docs)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return decontaminate.remove_contamination(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """TOKEN_SHARE of all tokens, with equal weights in the tree of domain, language and source; no document twice."""
    ready(spark)
    return mixture.mix(docs, TOKEN_SHARE, max_epochs=1).where("copies > 0").select(*docs.columns)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    grammar_shards.write_shards(docs, path)
    return grammar_shards.read_shards(spark, path)


STAGES = [
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_documents),
    ("mixing", mix_sources),
    ("token_shards", write_token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            discard(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
