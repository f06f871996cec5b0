"""The registered queries of the operators, over whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castwright.llm import decontaminate, hnsw, lexical, mixing, ngram_join, packing, periodic, pii, quality, suffix_dedup, tokens, toxicity, wrapper
from castwright.llm.common import ship, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return f(spark, folder)

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(table(spark, folder, "documents"))


@query
def op5_token_output(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark)
    tokens.write_ids(table(spark, folder, "documents"), path, tokenizer_path(), end_id=2)
    return tokens.read_ids(spark, path, with_ids=False)


@query
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"))


def held_out() -> Column:
    """Rows that no fit may use: every fifth by the crc32 of the id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model, scored = toxicity.train(docs, labels.where(~held_out()), "toxic")
    found = toxicity.probabilities(scored, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    # Grades: 0 poor, 1 good but toxic, 2 good. Selected: probably 1 or better.
    grades = labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).alias("grade"))
    model = quality.train(docs, grades.where(~held_out()))
    return quality.grade(docs, model).select("doc_id", held_out().alias("held_out"), "expected_grade", "tail", "selected").where("selected")


@query
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op9_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return wrapper.main_text(table(spark, folder, "pages"))


@query
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, folder, "documents"), with_text=False)


@query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(table(spark, folder, "documents"), periodic.planted_repeats))


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE["op12_lexical_search"] = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
times AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM times, totals GROUP BY term, all_docs
),
scored AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * all_docs) // all_terms))) AS part
  FROM times JOIN weights USING (term) JOIN sizes USING (doc_id), totals
),
ranked AS (
  SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN scored USING (term) GROUP BY item_id, doc_id HAVING sum(part) > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM ranked
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


@query
def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path(), end_id=2)
