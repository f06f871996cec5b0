"""Token ids in Huffman-coded files: global counts, canonical length-limited codes, independent blocks.

1. Documents are range-partitioned and sorted by id; each partition is one shard.
2. A shard's texts are tokenized and cut into blocks of whole documents (a block ends with the document that
   reaches `BLOCK` ids). The id blocks are landed once.
3. One count per id over all documents gives a length-limited Huffman code (package-merge, at most `LIMIT` bits).
   Codes are canonical: the table of code lengths is the whole code book.
4. Blocks are coded on their own. Each holds the bit offset of every `LANE`-th id, so that a reader can start
   there; the decoder reads all these lanes in step through one look-up table.

File format: a folder with `codes` (id, bits) and `blocks`, Parquet tables written by Spark's committer, so a lost
executor leaves no broken file. A row of `blocks`: shard, block, offset (ids of the shard before it), doc_ids,
counts (ids of each document, in order), n (their sum), bits (payload: big-endian 64-bit words, codes from the highest
bit down), checkpoints (little-endian 64-bit bit offsets of ids 0, LANE, 2 LANE, ...). Shards ascend in doc_id.

Null texts are empty; each document ends with `end_id`, so an empty one has one id. Rows with a null id come first; rows
with one id stay separate rows, ordered by text. An empty table gives empty tables.
"""

from __future__ import annotations

import os
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwright.llm.common import checked, land

BLOCK, LANE, LIMIT, CACHE = 1 << 16, 128, 18, 600_000
# Fixed: marks that end a word, of those that never join a letter (an apostrophe may).
MARKS = ".,;:!?%#&$*"
# The pairs of the white space that a text may be cut at.
PAIRS = ("  ", " \n", "\n ", "\n\n")
# Letters below this are letters in every Unicode version.
LATIN = "\u0250"
PROBES = ["the", "Unlikely", "\u00e9t\u00e9s", "\u017bubr", "zqxj"]
# Printable Latin-1 bytes show as themselves, the others, in order, as the characters from 256 on.
HIDDEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or b >= 161 and b != 173))}
SHOWN = "".join(chr(HIDDEN.get(b, b)) for b in range(256))


class NotWhole(Exception):
    """A piece is not one run without white space."""


class Words(dict):
    """Ids of pieces, as bytes, found when first asked for. At `CACHE` pieces the store starts anew, so it stays small whatever the corpus."""

    def __init__(self, find: Callable[[str], bytes]) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids = self.find(piece)
        return ids


class Pieces:
    """Ids of texts, by words whose ids are kept, so that the library is asked once for each word in store.

    A byte-level vocabulary splits a text before it merges: a word takes at most one space before it, and letters
    are split from marks. So where no two white space characters meet, none stands at an end, and all are single spaces or
    line breaks, a text may be cut before every space, around every line break, and between a letter and the ASCII marks that
    end a word, without changing an id. The cut shows it: each piece is then one run without white space, but for a line break
    before it. Any other text goes to the library whole.
    """

    def __init__(self, path: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        # A piece of `words` stands for itself with a space before it, or has a line break instead; `firsts` begin a text.
        self.words, self.firsts, self.marks = Words(self.find), Words(self.find_first), Words(self.encode)
        self.line_break = self.encode("\n")
        # A word of letters is one unit of a byte-level splitter, so its model may be asked without the splitter; only if it agrees.
        self.code = {"<u2": "H", "<u4": "I"}[dtype]
        self.model = self.tokenizer.model.tokenize
        same = [self.unit(lead + w) == self.encode(lead + w) for w in PROBES for lead in ("", " ")]
        self.direct = all(same)

    def forget(self) -> None:
        """Give the store back; the tokenizer stays."""
        self.words.clear()
        self.firsts.clear()
        self.marks.clear()

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def unit(self, text: str) -> bytes:
        """Ids of what the splitter leaves in one piece: the model reads it spelled as a visible character for each byte."""
        return array(self.code, [t.id for t in self.model(charmap_decode(text.encode(), "strict", SHOWN)[0])]).tobytes()

    @staticmethod
    def letters(word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < LATIN)

    def find(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii() and self.direct:
            return array(self.code, [t.id for t in self.model("\u0120" + piece)]).tobytes()
        if piece[:1] == "\n":
            return self.line_break + self.firsts[piece[1:]]
        core = piece.rstrip(MARKS)
        if self.direct and self.letters(core):
            return self.unit(" " + core) if core == piece else self.words[core] + self.marks[piece[len(core) :]]
        if piece.split() != [piece]:  # white space that Unicode or Python knows, or nothing
            raise NotWhole
        return self.encode(" " + piece)

    def find_first(self, piece: str) -> bytes:
        core = piece.rstrip(MARKS)
        if self.direct and self.letters(core):
            return self.unit(core) if core == piece else self.firsts[core] + self.marks[piece[len(core) :]]
        if piece.split() != [piece]:
            raise NotWhole
        return self.encode(piece)

    def of(self, text: str) -> bytes:
        """Ids of a whole text."""
        if any(map(text.__contains__, PAIRS)):
            return self.encode(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return self.firsts[first] + b"".join([*map(self.words.__getitem__, rest)])
        except NotWhole:
            return self.encode(text)


_ENCODERS: dict[tuple[str, str], Pieces] = {}


def encoder(tokenizer: str, dtype: str) -> Pieces:
    """The encoder of this worker; a task that is done with it lets it `forget` its words."""
    if (tokenizer, dtype) not in _ENCODERS:
        _ENCODERS[tokenizer, dtype] = Pieces(tokenizer, dtype)
    return _ENCODERS[tokenizer, dtype]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, dtype: str = "<u2") -> DataFrame:
    """Landed blocks of ids: shard, block, offset, doc_ids, counts, ids. `dtype`: `<u2` for vocabularies up to 65,536, else `<u4`."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, dtype)
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        shard, block, offset, held = TaskContext.get().partitionId(), 0, 0, 0
        keys: list[int | None] = []
        counts: list[int] = []
        parts: list[bytes] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "block": [block], "offset": [offset], "doc_ids": [keys], "counts": [counts], "ids": [b"".join(parts)]}, schema=schema
            )

        for batch in batches:
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = own.of(text.as_py() or "") + end
                keys.append(key)
                counts.append(len(ids) // width)
                held += len(ids) // width
                parts.append(ids)
                if held >= BLOCK:
                    yield row()
                    offset, block, held, keys, counts, parts = offset + held, block + 1, 0, [], [], []
        own.forget()
        if keys:
            yield row()

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])
    rows = checked(docs, "doc_id", "text")
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return land(ordered.mapInArrow(blocks, "shard int, block int, offset long, doc_ids array<long>, counts array<long>, ids binary"), codec="zstd")


def id_counts(blocks: DataFrame, dtype: str = "<u2") -> DataFrame:
    """Columns id, n: how often each id occurs in all blocks. A task counts its blocks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                found = np.bincount(np.frombuffer(ids.as_py(), dtype))
                if len(found) > len(total):
                    total, found = found.astype(np.int64), total
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used.astype(np.int64), "n": total[used]})

    return blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code under the best code of at most `limit` bits (package-merge); counts are positive."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    level, marks = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both, leaf = np.concatenate([leaves, pairs]), np.concatenate([np.ones(n, bool), np.zeros(len(pairs), bool)])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        marks.append(leaf[rank])
    sorted_bits, take = np.zeros(n, np.int64), 2 * n - 2
    for mark in reversed(marks):  # the first `take` items of a level: its smallest leaves, and packages of the level below
        own = int(mark[:take].sum())
        sorted_bits[:own] += 1
        take = 2 * (take - own)
    bits = np.zeros(n, np.uint8)
    bits[order] = sorted_bits
    return bits


def canonical(symbols: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Codes of the symbols: by length, then symbol, each the next number of its length."""
    order, codes, code, last = np.lexsort((symbols, bits)), np.zeros(len(symbols), np.uint64), 0, 0
    for i in order:
        code <<= int(bits[i]) - last
        codes[i], last = code, int(bits[i])
        code += 1
    return codes


def pack(codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words that hold the codes one after the other, and the bit offset of each."""
    ends = np.cumsum(bits, dtype=np.int64)
    at = ends - bits
    words = np.zeros(int(ends[-1] + 63 >> 6) + 1 if len(bits) else 1, np.uint64)
    if not len(bits):
        return words, at
    word, room = at >> 6, 64 - (at & 63) - bits
    over = np.flatnonzero(room < 0)
    head = codes << room.view(np.uint64)  # no code has 64 bits, and those over the edge come next
    head[over] = codes[over] >> (-room[over]).view(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[first]] = np.bitwise_or.reduceat(head, first)
    words[word[over] + 1] |= codes[over] << (64 + room[over]).view(np.uint64)
    return words, at


def look_up(symbols: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, int]:
    """For every value of the next `width` bits the symbol, shifted by 8 bits, and its length."""
    width = int(bits.max()) if len(bits) else 1
    codes = canonical(symbols, bits).astype(np.int64)
    small = not len(symbols) or int(symbols.max()) < 1 << 24
    table = np.zeros(1 << width, np.uint32 if small else np.int64)
    order = np.argsort(codes << (width - bits.astype(np.int64)), kind="stable")
    span = 1 << (width - bits[order].astype(np.int64))
    filled = int(span.sum())
    table[:filled] = np.repeat(symbols[order] << 8 | bits[order], span)
    return table, width


def unpack(words: np.ndarray, starts: np.ndarray, n: int, table: np.ndarray, width: int) -> np.ndarray:
    """The `n` ids of a block, all lanes in step; a code has at most 32 bits, so it lies in the 64 bits from its half word on."""
    ahead = np.zeros(2 * len(words), np.uint64)
    ahead[::2] = words
    ahead[1:-1:2] = words[:-1] << np.uint64(32) | words[1:] >> np.uint64(32)
    out = np.zeros((LANE, len(starts)), table.dtype)
    at, down = starts.astype(np.int64), np.uint64(64 - width)
    full = (n - 1) % LANE + 1  # the last lane may be shorter
    for k in range(LANE):
        if k == full:
            at = at[:-1]
        found = table[(ahead[at >> 5] << (at & 31).view(np.uint64) >> down).view(np.int64)]
        out[k, : len(at)] = found
        at += found & 255
    return (out.T >> 8).astype(np.uint32).reshape(-1)[:n]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, dtype: str = "<u2", limit: int = LIMIT) -> None:
    """Encode every document of `docs` (doc_id, text) and write the folder `path`."""
    spark = docs.sparkSession
    blocks = tokenized(docs, tokenizer, end_id, dtype)
    counted = id_counts(blocks, dtype).toPandas()  # a row per id of the vocabulary at most
    symbols = counted["id"].to_numpy(np.int64)
    bits = code_lengths(counted["n"].to_numpy(np.int64), limit) if len(symbols) else np.zeros(0, np.uint8)
    table = pa.table({"id": pa.array(symbols), "bits": pa.array(bits.astype(np.int32))})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/codes")
    size = int(symbols.max()) + 1 if len(symbols) else 1
    code_of, bits_of = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
    code_of[symbols], bits_of[symbols] = canonical(symbols, bits), bits

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = np.frombuffer(row["ids"][0].as_py(), dtype)
                words, at = pack(code_of[ids], bits_of[ids])
                lanes = at[::LANE].astype("<i8").tobytes()
                kept = [row[c] for c in ("shard", "block", "offset", "doc_ids", "counts")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([len(ids)], pa.int64()), pa.array([words.astype(">u8").tobytes()], pa.binary()), pa.array([lanes], pa.binary())],
                    names=["shard", "block", "offset", "doc_ids", "counts", "n", "bits", "checkpoints"],
                )

    shape = "shard int, block int, offset long, doc_ids array<long>, counts array<long>, n long, bits binary, checkpoints binary"
    blocks.mapInArrow(coded, shape).write.option("compression", "none").parquet(f"{path}/blocks")


def decoder(spark: SparkSession, path: str) -> Callable[[bytes, bytes, int], np.ndarray]:
    """A function that decodes one block (bits, checkpoints, n) of the folder; it may be used inside tasks."""
    codes = spark.read.parquet(f"{path}/codes").toPandas()  # a row per id of the vocabulary at most
    symbols, bits = codes["id"].to_numpy(np.int64), codes["bits"].to_numpy(np.uint8)
    built: list[tuple[np.ndarray, int]] = []

    def decode(payload: bytes, lanes: bytes, n: int) -> np.ndarray:
        if not built:
            built.append(look_up(symbols, bits))
        return unpack(np.frombuffer(payload, ">u8").astype(np.uint64), np.frombuffer(lanes, "<i8"), n, *built[0])

    return decode


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and its ids."""
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()  # a row per shard
    base, seen = {}, 0
    for shard, n in sorted(totals):
        base[shard], seen = seen, seen + n
    decode = decoder(spark, path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch[c][row].as_py()  # noqa: B023, E731
                counts = np.array(get("counts"), np.int64)
                ids = decode(get("bits"), get("checkpoints"), get("n")).astype("<u4")
                starts = np.concatenate([[0], np.cumsum(counts)])
                own = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
                found = {"doc_id": pa.array(get("doc_ids"), pa.int64()), "start": starts[:-1] + base[get("shard")] + get("offset"), "n_tokens": counts, "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())}
                if with_ids:
                    found["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(found)

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.mapInArrow(documents, shape)
