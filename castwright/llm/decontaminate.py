"""Benchmark decontamination: latent semantic retrieval, then alignment and answer checks.

1. Words (lower case, outer marks stripped) are hashed to 32 bits once and landed; the low bits are the term. A passage is
   two neighbouring strides of `STRIDE` words; strides do not cross documents.
2. TF-IDF over the terms of the benchmark: document frequency of every term over all strides; terms on more than `COMMON` of all
   strides weigh nothing.
3. Distributed randomised SVD: with random W of `RANK` columns, one pass sums B = A' (A W) over all passages A (rows of one
   length). Each task sums its own part, parts are added in two levels. The small factors give an orthonormal basis of the
   leading right singular space and its singular values; coordinates are divided by their square roots, so that the few
   directions that all passages of a language share do not drown the rest.
4. Every passage and every benchmark item (cut into pieces of a passage's length) is projected; pairs with a cosine of at least
   `COSINE` are candidates. Items go in blocks of about `ITEMS`, each a bounded broadcast. A piece with few weighted words has no
   direction to speak of; all passages are its candidates.
5. A candidate is confirmed step by step: share of the piece's word bits in the passage, share of the item's words in the text
   around it, then the longest common subsequence of words: at least `SURE` of the item, or `LIKELY` if its answer (the
   last quarter of its words) is there to that degree as well. So paraphrases with changed, added or dropped words are found.
   Items under `SHORT` words must occur word for word.

Result: a row for each document and item found. Null and empty texts and items match nothing; items alike are
separate items; a null id is reported as null; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.llm.common import checked, land, marked, maybe_in, scratch
from castwright.llm.words import in_chunks, pieces, word_hashes

STRIDE, TERMS, RANK, COMMON, COSINE, BITS, SURE, LIKELY, SHORT, ITEMS = 24, 1 << 16, 48, 0.1, 0.3, 0.45, 0.75, 0.6, 10, 4096
SLICES, WIDTH = 64, 256
STRIP = ".,;:!?\"'()[]{}<>%#&$*|-_/\\"
_MARKS = np.isin(np.arange(256), [*STRIP.encode()])


def hashed(text: str) -> np.ndarray:
    return all_hashed([text])[0]


def all_hashed(texts: list[str]) -> list[np.ndarray]:
    """32-bit hashes of the words of each text; words of marks only have none."""
    data = [(x if x.isascii() else " ".join(x.split())).lower().encode("utf-8", "surrogatepass") for x in texts]
    hashes, starts, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for part in pieces(b" ".join(data)):
        found, at = word_hashes(part, _MARKS)
        hashes.append(found)
        starts.append(at + base)
        base += len(part)
    ids = (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32)
    firsts = np.searchsorted(np.concatenate(starts), np.cumsum([0] + [len(x) + 1 for x in data]))
    return [ids[a:b] for a, b in zip(firsts, firsts[1:])]


def words_table(docs: DataFrame) -> DataFrame:
    """Landed doc_id, ids (little-endian 32-bit word hashes); documents without words are left out, as they match nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            found = (ids for part in in_chunks(text.as_py() or "" for text in batch["text"]) for ids in all_hashed(part))
            for key, ids in zip(batch["doc_id"].to_pylist(), found, strict=True):
                if len(ids):
                    keys.append(key)
                    out.append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, batch["doc_id"].type), "ids": pa.array(out, pa.binary())})

    rows = checked(docs, "doc_id", "text")
    return land(rows.mapInArrow(read, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary"))


def strides(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts, the start of each stride among them, and the text that owns it."""
    sizes = np.array([len(t) for t in texts])
    counts = -(-sizes // STRIDE)
    owner = np.repeat(np.arange(len(texts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.concatenate(texts), (np.cumsum(sizes) - sizes)[owner] + inner * STRIDE, owner


def chunks(batch: pa.RecordBatch, most: int = 60_000) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Row numbers and texts of a batch, about `most` words at a time."""
    rows: list[int] = []
    texts: list[np.ndarray] = []
    held = 0
    for i, value in enumerate(batch["ids"]):
        rows.append(i)
        texts.append(np.frombuffer(value.as_py(), "<u4"))
        held += len(texts[-1])
        if held > most:
            yield rows, texts
            rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def numbers(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The stride of each word."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))


def frequencies(words: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Strides that hold each term of the vocabulary, and the number of all strides."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, every = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, texts in chunks(batch):
                ids, starts, _ = strides(texts)
                terms = (ids % TERMS).astype(np.int64)
                own = vocabulary[terms]
                terms, stride = terms[own], numbers(ids, starts)[own]
                order = by_term(terms)
                terms, stride = terms[order], stride[order]
                new = np.ones(len(terms), bool)
                new[1:] = (terms[1:] != terms[:-1]) | (stride[1:] != stride[:-1])
                total += np.bincount(terms[new], minlength=TERMS)
                every += len(starts)
        yield pa.RecordBatch.from_pydict({"term": np.append(np.flatnonzero(total), -1), "n": np.append(total[total > 0], every)})

    found = words.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # TERMS + 1 rows at most
    out = np.zeros(TERMS + 1, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["n"]
    return out[:TERMS], int(out[TERMS])


def by_term(terms: np.ndarray) -> np.ndarray:
    """The stable order of terms; 16 bits are sorted by counting."""
    return np.argsort(terms.astype(np.uint16), kind="stable")


def with_next(rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each stride together with the next one of the same text."""
    rows[:-1] += np.where((owner[1:] == owner[:-1])[:, None], rows[1:], rows.dtype.type(0))
    return rows


def stride_sums(vectors: np.ndarray, terms: np.ndarray, stride: np.ndarray, n: int) -> np.ndarray:
    """Sum of the vectors of each stride's weighted words."""
    out = np.zeros((n, vectors.shape[1]), np.float32)
    if len(terms):
        first = np.flatnonzero(np.concatenate([[True], stride[1:] != stride[:-1]]))
        out[stride[first]] = np.add.reduceat(vectors[terms], first, axis=0)
    return out


def weighted(ids: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms with a weight, and their strides."""
    terms = ids % TERMS
    own = idf[terms] > 0
    return terms[own], numbers(ids, starts)[own]


def coordinates(words: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """TERMS x rank: the latent coordinates of a term, weighted by its idf."""
    spark = words.sparkSession
    test = np.random.default_rng(seed).standard_normal((TERMS, rank)).astype(np.float32)
    shared = spark.sparkContext.broadcast((test * idf[:, None], idf))
    step = TERMS // SLICES

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, rank), np.float32)
        projected, weights = shared.value
        for batch in batches:
            for _, texts in chunks(batch):
                ids, starts, owner = strides(texts)
                terms, stride = weighted(ids, starts, weights)
                if not len(terms):
                    continue
                rows = with_next(stride_sums(projected, terms, stride, len(starts)), owner)
                norm = with_next(np.bincount(stride, weights[terms] ** 2, len(starts))[:, None], owner)
                rows /= np.maximum(norm, 1e-6)
                # Each stride stands in its own passage and in the one before.
                rows[1:] += np.where((owner[1:] == owner[:-1])[:, None], rows[:-1], np.float32(0))
                order = by_term(terms)
                ordered = terms[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                total[ordered[first]] += np.add.reduceat(rows[stride[order]], first, axis=0)
        part = TaskContext.get().partitionId() // SLICES
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "part": pa.array([part] * SLICES, pa.int32()), "data": [total[i * step : (i + 1) * step].tobytes() for i in range(SLICES)]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float32) for x in rows["data"]], axis=0, dtype=np.float32)
        return pd.DataFrame({"slice": [key[0]], "part": [0], "data": [total.tobytes()]})

    shape = "slice int, part int, data binary"
    sums = words.select("ids").mapInArrow(partial, shape).groupBy("slice", "part").applyInPandas(add, shape).groupBy("slice").applyInPandas(add, shape)
    found = dict(sums.select("slice", "data").toPandas().itertuples(index=False))  # TERMS x rank numbers in all
    full = np.concatenate([np.frombuffer(found[i], np.float32) if i in found else np.zeros(step * rank, np.float32) for i in range(SLICES)])
    gathered = full.reshape(TERMS, rank) * idf[:, None]  # A'A W
    if not gathered.any():
        return np.zeros((TERMS, rank), np.float32)
    axes, small = np.linalg.qr(gathered)
    core = test.T @ gathered
    squares, turn = np.linalg.eigh(_symmetric(small @ np.linalg.pinv(_symmetric(core)) @ small.T))
    squares = np.maximum(squares, squares.max() * 1e-3)  # of the singular values
    return (axes @ turn / squares**0.25 * idf[:, None]).astype(np.float32)


def _symmetric(x: np.ndarray) -> np.ndarray:
    return (x + x.T) / 2


def bitmaps(ids: np.ndarray, stride: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per passage, a bit for each hashed word: shape (passages, WIDTH / 64)."""
    flags = np.zeros((len(owner), WIDTH), np.uint8)
    flags[stride, (ids >> np.uint32(20)) % WIDTH] = 1
    return np.packbits(with_next(flags, owner) > 0, axis=1).view(np.uint64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b.tolist():
        if m := masks.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def confirmed(item: np.ndarray, around: np.ndarray) -> float:
    """Share of the item found in order; 0 if not enough, or without its answer."""
    held = set(around.tolist())
    if sum(map(held.__contains__, item.tolist())) / len(item) < LIKELY:
        return 0.0
    share = common(item, around) / len(item)
    if share >= SURE:
        return share
    answer = item[-max(3, len(item) // 4) :]
    return share if share >= LIKELY and common(answer, around) >= LIKELY * len(answer) else 0.0


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, share (of the item's words found in order) for every document and item found."""
    words = words_table(docs)
    items = checked(benchmark, "item_id", "text").where("text is not null")
    terms = items.select("text").mapInArrow(_terms, "term int").distinct().toPandas()["term"].to_numpy(np.int64)  # TERMS rows at most
    vocabulary = np.zeros(TERMS, bool)
    vocabulary[terms] = True
    df, n = frequencies(words, vocabulary)
    idf = np.where((df > 0) & (df <= COMMON * n), np.log((n + 1) / (df + 1)), 0).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((coordinates(words, idf), idf))
    numbered = land(items.select("item_id", "text").repartitionByRange("item_id"))
    blocks = -(-numbered.count() // ITEMS)
    shape = f"doc_id {words.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, share double"
    parts = []
    for block in range(max(blocks, 1)):
        own = numbered.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1))) == block).collect()  # about ITEMS rows
        known = [(r["item_id"], ids) for r in own if len(ids := hashed(r["text"]))]
        parts.append(words.mapInArrow(_searcher(known, shared), shape))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, in which no benchmark item is found; their names may be any."""
    row = F.xxhash64("`doc_id`", "`text`")
    with scratch(docs.sparkSession) as stay:
        found = stay(find_leaks(docs.select(row.alias("doc_id"), "`text`"), benchmark).select(F.col("doc_id").alias("row")).distinct())
    split = marked(docs.select(row.alias("row"), F.struct("*").alias("kept")), maybe_in(found, "row"), "row", "maybe")
    doubtful = split.where("maybe").join(found, "row", "left_anti")
    return split.where("not maybe").unionByName(doubtful).select("kept.*")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashed(t.as_py() or "") % TERMS for t in batch["text"]]
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.unique(np.concatenate([np.zeros(0, np.uint32), *found])).astype(np.int32))})


def _searcher(items: list[tuple], shared):  # noqa: ANN001, ANN202
    """The search of one block of items, for `mapInArrow`."""
    short = [(key, ids) for key, ids in items if len(ids) < SHORT]
    pieces = [(key, ids, a) for key, ids in items if len(ids) >= SHORT for a in range(0, max(1, len(ids) - STRIDE), 2 * STRIDE)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, idf = shared.value
        parts = [ids[a : a + 2 * STRIDE] for _, ids, a in pieces]
        targets = np.array([space[p % TERMS].sum(0) for p in parts], np.float32).reshape(len(pieces), space.shape[1])
        targets /= np.maximum(np.linalg.norm(targets, axis=1), 1e-9)[:, None]
        weak = np.array([(idf[p % TERMS] > 0).sum() < 6 for p in parts], bool)
        item_bits = np.concatenate([np.zeros((0, WIDTH // 64), np.uint64), *[bitmaps(p, np.zeros(len(p), np.int64), np.zeros(1, np.int64)) for p in parts]])
        least_bits = BITS * np.bitwise_count(item_bits).sum(1)
        for batch in batches:
            keys, out = batch["doc_id"].to_pylist(), []
            for rows, texts in chunks(batch):
                ids, starts, owner = strides(texts)
                ends = np.cumsum([len(t) for t in texts])
                if pieces:
                    terms, stride = weighted(ids, starts, idf)
                    vectors = with_next(stride_sums(space, terms, stride, len(starts)), owner)
                    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                    at, which = np.nonzero((vectors @ targets.T >= COSINE) | weak)
                    bits = bitmaps(ids, numbers(ids, starts), owner)
                    near = np.bitwise_count(bits[at] & item_bits[which]).sum(1) >= least_bits[which]
                    for at_, which_ in zip(at[near].tolist(), which[near].tolist(), strict=True):
                        key, item, a = pieces[which_]
                        text = owner[at_]
                        low = max(starts[at_] - a - len(item) // 2, ends[text] - len(texts[text]))
                        high = min(starts[at_] + 2 * STRIDE + len(item) - a + len(item) // 2, ends[text])
                        if share := confirmed(item, ids[low:high]):
                            out.append((keys[rows[text]], key, share))
                for key, item in short:
                    hits = np.flatnonzero(ids[: len(ids) - len(item) + 1] == item[0]) if len(ids) >= len(item) else []
                    for first in hits:
                        text = int(np.searchsorted(ends, first, "right"))
                        if first + len(item) <= ends[text] and (ids[first : first + len(item)] == item).all():
                            out.append((keys[rows[text]], key, 1.0))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([o[0] for o in out], batch["doc_id"].type), "item_id": pa.array([o[1] for o in out], pa.int64()), "share": pa.array([float(o[2]) for o in out], pa.float64())})

    return search
