"""A corpus pipeline: toxic documents go, near copies go, benchmark leaks go, sources are mixed, token files are written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`; a document that the mix takes twice comes twice. The
last writes the token files of what is left and returns, per document read back from them, its place, length and checksum.
Every stage starts by letting go the shuffle files that the one before left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from castwright.llm import decontaminate, mixing, ngram_join, tokens, toxicity
from castwright.llm.common import land, release, scratch, ship, work_folder
from castwright.llm.queries import held_out, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (6): documents with a score of 0.5 or more go."""
    ship(spark)
    with scratch(spark):  # the model is all that is kept
        model, _ = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()), "toxic")
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (7): five-word shingles, similarity 0.8 or more; one document of each group stays."""
    ship(spark)
    release(spark)
    return ngram_join.one_of_each(docs, percent=80, words=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (2): documents that hold an item go."""
    ship(spark)
    release(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (8): in shuffled shards."""
    release(spark)
    return mixing.mix(docs).drop(mixing.SHARD)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID / binary output (5)."""
    ship(spark)
    release(spark)
    path = work_folder(spark)
    tokens.write_ids(docs, path, tokenizer_path(), end_id=2)
    return tokens.read_ids(spark, path, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
# Trained scores, tokenizers and latent spaces have no SQL; the stages are tested against brute force and planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir))
    return docs
