"""Ranked lexical search of many items at once, with shared partial sums.

1. The items' terms are cut in Spark; items go to blocks of about `TERMS` terms, and every block is ranked against all documents.
2. One pass counts the documents, their terms, and the documents that hold each term of the block.
3. Term sets that items of the block share are mined: terms of the same items become one set first; then, with an item's sets in order of
   how many items hold them, the neighbouring pairs that items share most often are joined, again and again, until no pair occurs
   twice. This gives a graph (`Plan`) in which each shared set is the sum of two smaller ones, and an item the sum of a few sets.
4. A second pass scores: for some hundred documents at a time the terms' scores are laid out once, each shared set's partial sum is made once, level
   by level, and every item adds up its own few sets. A task keeps the best `top` documents of each item; a window picks the best of all tasks'.

Scores are 64-bit integers, so sums do not depend on their order. A block's plan has a bounded size and travels with the tasks.

Null and empty texts have no terms: such documents count for nothing, such items have no rows. Each item row is ranked on its own, also if ids
repeat or are null; repeated documents are ranked once per row; documents with a null id come after others of the same score. Empty tables give an
empty result. Ids keep their types; other columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwright.llm.common import checked, land, text_bytes
from castwright.llm.words import in_chunks

TOP, TERMS, CELLS, CHUNK = 50, 1 << 17, 1 << 21, 1 << 19
# Fixed: ASCII letters, digits and all bytes of other characters make terms; A to Z count as a to z.
_TERM_BYTES = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256)).lower()
# Fixed: a document's place between short (50) and average (100) texts, the scale of a term's score, and its damping.
SHORT, SCALE, DAMP = 50, 1_000_000_000, 20


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, in order."""
    return text.translate(_TERM_BYTES).split()


@dataclass
class Plan:
    """How to add up a block of items from their terms.

    Rows 0 .. len(terms) - 1 of a table of sums stand for the terms. `levels` adds rows: row `first` + i is the sum of rows left[i] and right[i].
    An item is the sum of the rows `parts[offsets[k]:offsets[k + 1]]`.
    """

    terms: dict[bytes, int]
    levels: list[tuple[int, np.ndarray, np.ndarray]]
    parts: np.ndarray
    offsets: np.ndarray
    rows: int

    def sums(self, table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Given the terms' scores (term, document) in the first rows, the items' scores, some items at a time: first item, scores."""
        for first, left, right in self.levels:
            np.add(table[left], table[right], out=table[first : first + len(left)])
        limit = max(1, CELLS // table.shape[1])
        low = 0
        while low < len(self.offsets) - 1:
            high = max(low + 1, int(np.searchsorted(self.offsets, self.offsets[low] + limit, "right")) - 1)
            ends = self.offsets[low : high + 1]
            yield low, np.add.reduceat(table[self.parts[ends[0] : ends[-1]]], ends[:-1] - ends[0], axis=0)
            low = high


def mined(items: list[list[bytes]]) -> Plan:
    """The plan of items, each a list of different terms, one at least."""
    holders: dict[bytes, list[int]] = defaultdict(list)
    for k, terms in enumerate(items):
        for term in terms:
            holders[term].append(k)
    numbers = {term: i for i, term in enumerate(holders)}
    children: dict[int, tuple[int, int]] = {}
    together: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for term, found in holders.items():
        together[tuple(found)].append(numbers[term])
    sequences: list[list[int]] = [[] for _ in items]
    for found, rows in sorted(together.items(), key=lambda x: (-len(x[0]), x[0])):  # by how many items hold the set, then by place
        while len(found) > 1 and len(rows) > 1:  # terms of the same items: added two by two
            joined = []
            for a, b in zip(rows[::2], rows[1::2], strict=False):
                children[len(numbers) + len(children)] = (a, b)
                joined.append(len(numbers) + len(children) - 1)
            rows = joined + rows[len(rows) // 2 * 2 :]
        for k in found:
            sequences[k] += rows
    while True:
        counts = Counter(pair for own in sequences for pair in pairwise(own))
        shared = {pair: n for pair, n in counts.items() if n > 1}
        if not shared:
            break
        names: dict[tuple[int, int], int] = {}
        for k, own in enumerate(sequences):
            out, i = [], 0
            while i < len(own):
                pair = (own[i], own[i + 1]) if i + 1 < len(own) else None
                after = (own[i + 1], own[i + 2]) if i + 2 < len(own) else None
                if pair in shared and shared[pair] >= shared.get(after, 0):
                    if pair not in names:
                        names[pair] = len(numbers) + len(children)
                        children[names[pair]] = pair
                    out.append(names[pair])
                    i += 2
                else:
                    out.append(own[i])
                    i += 1
            sequences[k] = out
        if not names:
            break
    return arranged(numbers, children, sequences)


def arranged(numbers: dict[bytes, int], children: dict[int, tuple[int, int]], sequences: list[list[int]]) -> Plan:
    """Number the shared sets level by level, so that each level is one addition of rows."""
    depth: dict[int, int] = {}
    for node, (a, b) in children.items():  # children come before their parents
        depth[node] = 1 + max(depth.get(a, 0), depth.get(b, 0))
    order = sorted(children, key=lambda node: (depth[node], node))
    place = {node: len(numbers) + i for i, node in enumerate(order)}
    levels, low = [], 0
    while low < len(order):
        high = low
        while high < len(order) and depth[order[high]] == depth[order[low]]:
            high += 1
        pairs = [children[node] for node in order[low:high]]
        left, right = (np.array([place.get(p[side], p[side]) for p in pairs], np.int64) for side in (0, 1))
        levels.append((len(numbers) + low, left, right))
        low = high
    parts = np.array([place.get(node, node) for own in sequences for node in own], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(own) for own in sequences])]).astype(np.int64)
    return Plan(numbers, levels, parts, offsets, len(numbers) + len(order))


def counted(texts: list[bytes], terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms per text; and text, term, occurrences of the terms that are asked for."""
    cut = [terms_of(text) for text in texts]
    sizes = np.array([len(words) for words in cut], np.int64)
    known = [np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words)) for words in cut]
    term = np.concatenate([*known, np.zeros(0, np.int64)])
    text = np.repeat(np.arange(len(texts)), sizes)
    asked = term >= 0
    keys, times = np.unique(text[asked] * len(terms) + term[asked], return_counts=True)
    return sizes, keys // len(terms), keys % len(terms), times


def statistics(docs: DataFrame, terms: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the number of documents that hold each of `terms`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(len(terms), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for chunk in in_chunks(text_bytes(batch["text"]), CHUNK):
                sizes, _, term, _ = counted(chunk, terms)
                held += np.bincount(term, minlength=len(terms))
                total += [np.count_nonzero(sizes), sizes.sum()]
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate([[-1, -2], used]), "n": np.concatenate([total, held[used]])})

    found = checked(docs, "text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row per term of the block
    numbers = dict(zip(found["term"].tolist(), found["n"].tolist(), strict=True))
    return numbers.get(-1, 0), numbers.get(-2, 0), np.array([numbers.get(i, 0) for i in range(len(terms))], np.int64)


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)


class Best:
    """The best `top` documents of each item so far, best first, of equal ones those with the least key; nulls last."""

    def __init__(self, items: int, top: int, kind: pa.DataType) -> None:
        self.top, self.floor = top, np.zeros(items, np.int64)
        self.item, self.score, self.key = [], [], []
        self.waiting, self.limit, self.kind = 0, (1 << 17) + 2 * top * items, kind

    def add(self, item: np.ndarray, score: np.ndarray, key: pa.Array) -> None:
        self.item.append(item), self.score.append(score), self.key.append(key)
        self.waiting += len(item)
        if self.waiting > self.limit:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        item, score = (np.concatenate([*parts, np.zeros(0, np.int64)]) for parts in (self.item, self.score))
        key = pa.chunked_array(self.key, self.kind).combine_chunks()
        place = pc.rank(key, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
        order = np.lexsort((place, -score, item))
        item, score = item[order], score[order]
        first = np.searchsorted(item, item)
        kept = np.arange(len(item)) - first < self.top
        last = np.arange(len(item)) - first == self.top - 1
        self.floor[item[last]] = score[last]
        item, score, key = item[kept], score[kept], key.take(pa.array(order[kept]))
        self.item, self.score, self.key, self.waiting = [item], [score], [key], len(item)
        return item, score, key


def ranked_block(docs: DataFrame, ids: pa.Array, items: list[list[bytes]], id_field: T.StructField, top: int) -> DataFrame | None:
    """Columns item (place in the block), item_id, doc_id, score: the best of each task's documents for the items of a block."""
    plan = mined(items)
    documents, words, held = statistics(docs, plan.terms)
    if not words:
        return None
    weight = weights(documents, held)
    rows = checked(docs, "doc_id", "text")
    shape = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", id_field.dataType), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    width = min(512, max(8, CELLS // plan.rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, table = None, np.zeros((plan.rows, width), np.int64)
        for batch in batches:
            best = best or Best(len(items), top, batch["doc_id"].type)
            done = 0
            for chunk in in_chunks(text_bytes(batch["text"]), CHUNK):
                sizes, text, term, times = counted(chunk, plan.terms)
                m = SHORT + SHORT * sizes * documents // words
                value = weight[term] * (SCALE * times // (1000 * times + DAMP * m[text]))
                for low in range(0, len(chunk), width):
                    a, b = np.searchsorted(text, [low, low + width])
                    table[: len(plan.terms)] = 0
                    table[term[a:b], text[a:b] - low] = value[a:b]
                    for first, sums in plan.sums(table):
                        floor = np.maximum(best.floor[first : first + len(sums)], 1)
                        item, place = np.nonzero(sums >= floor[:, None])
                        if len(item):
                            best.add(item + first, sums[item, place], batch["doc_id"].take(pa.array(place + done + low)))
                done += len(chunk)
        if best and best.waiting:
            item, found, key = best.prune()
            yield pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(item)), key, pa.array(found)], ["item", "item_id", "doc_id", "score"])

    return rows.mapInArrow(score, shape)


def item_terms(items: DataFrame) -> DataFrame:
    """Columns item_id, terms (different ones, as bytes), of the items that have any; landed in blocks of about `TERMS` terms."""
    rows = checked(items, "item_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[*dict.fromkeys(terms_of(text))] for text in text_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    shape = T.StructType([rows.schema["item_id"], T.StructField("terms", T.ArrayType(T.BinaryType()))])
    found = rows.mapInArrow(cut, shape).where(F.size("terms") > 0)
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, math.ceil(total / TERMS))))
    return land(found.withColumn("block", block.cast("int")), "block")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` best documents (doc_id, text) of each row of `items` (item_id, text): item_id, rank (from 1), doc_id, score."""
    parsed = item_terms(items)
    found = []
    for (block,) in sorted(parsed.select("block").distinct().collect()):  # a row per block of items
        own = parsed.where(F.col("block") == block).select("item_id", "terms").toArrow().combine_chunks()  # bounded by the block's size
        terms = own["terms"].to_pylist()
        ids = own["item_id"].combine_chunks() if isinstance(own["item_id"], pa.ChunkedArray) else own["item_id"]
        rows = ranked_block(docs, ids, terms, items.schema["item_id"], top)
        if rows is not None:
            found.append(rows.withColumn("block", F.lit(block)))
    if not found:
        shape = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], shape)
    best_first = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
