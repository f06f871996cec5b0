"""Stages carry columns of any name, and blocks of very many short texts take linear time."""

import time
import zlib

from pyspark.sql import functions as F

from castwright.llm import decontaminate, ngram_join, tokens
from castwright.llm.queries import tokenizer_path

NAMES = ["__row", "__word", "__id", "__tid", "__maybe", "row", "id", "tid", "kept", "maybe", "__mask", "__bit"]


def with_names(spark, texts):
    rows = [(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


def test_stages_keep_columns_of_any_name(spark):
    words = [" ".join(f"w{(i * 37 + k * 11) % 997}" for k in range(60)) for i in range(12)]
    docs = with_names(spark, [*words, words[3], words[5], None, ""])
    want = {r.doc_id: r for r in docs.collect()}
    kept = ngram_join.one_of_each(docs, percent=80, words=5)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [*range(12), 14, 15] and all(r == want[r.doc_id] for r in rows)
    items = spark.createDataFrame([(0, words[7])], "item_id long, text string")
    rows = decontaminate.without_leaks(docs, items).collect()
    assert 7 not in {r.doc_id for r in rows} and len(rows) == len(want) - 1 and all(r == want[r.doc_id] for r in rows)


def test_very_many_empty_texts(spark, tmp_path):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).coalesce(1)
    started = time.time()
    tokens.write_ids(docs, f"{tmp_path}/ids", tokenizer_path(), end_id=2)
    found = tokens.read_ids(spark, f"{tmp_path}/ids", with_ids=False)
    facts = found.agg(F.count(F.lit(1)), F.sum("n_tokens"), F.max("start"), F.max(F.abs(F.col("start") - F.col("doc_id"))), F.countDistinct("ids_crc32"), F.min("ids_crc32")).first()
    assert tuple(facts) == (200_000, 200_000, 199_999, 0, 1, zlib.crc32(b"\x02\0\0\0"))
    assert time.time() - started < 120
