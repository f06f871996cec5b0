"""Repeated byte strings: sampled suffixes are named, the remaining ones merged by them, neighbours compared.

The plan of a difference-cover suffix sort, with two changes that keep it within a few times the input on disk. The
sample is a set of positions such that two equal strings of `LENGTH` bytes always hold a sampled position at the same offset; a
difference cover gives this by position alone with three or more suffixes in every hundred bytes, here it is
chosen by content, with about one in 150. And names come from hashes, not from recursive sorting of triples, since only
equality over `LENGTH` bytes is asked for, not order.

1. Sample. Of each `LENGTH`-byte window the anchor is the `GRAM`-byte string with the smallest hash, leftmost on ties. Equal windows
   have equal anchors at equal offsets. An anchor owns a run of neighbouring windows; its context is the bytes they cover.
2. Names. Only anchors whose string occurs again stay. Anchors with equal contexts form one class; where it has two members all
   its windows repeat, and one member stands for it.
3. Merge. Where a string has several contexts, every remaining suffix (window) of one representative a class is named by
   string, offset and its bytes; the names are sorted and neighbours compared. Strings with up to `HOT` contexts meet in the
   slice of the string; the windows of others are spread by their own names. So a passage in a third of all documents
   is spread as well.
4. Repeated windows go back to all members, are merged per document, and cut.

Equality is judged by 64-bit hashes (two for a window: string and bytes). Texts are UTF-8 bytes, null ones empty; shorter texts than
`LENGTH` stay whole. Rows alike are copies of each other: all their windows repeat. Windows never cross documents. Null ids are kept as ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.llm.common import checked, land, marked, maybe_in, text_bytes
from castwright.llm.words import mixed

LENGTH, GRAM, HOT, ROWS = 400, 100, 2048, 50_000
_SPREAD = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_STEP_BACK = pow(_STEP, -1, 1 << 64)


class Rolling:
    """Polynomial hashes modulo 2^64 over spread bytes; powers are kept up to the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:
            size = max(1 << 16, 2 * n)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_STEP, _STEP_BACK))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(_SPREAD[data] * self.up[:n], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each data[start:end]."""
        return mixed((sums[end] - sums[start]) * self.down[start])


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from running minima of blocks to both sides."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, rolling: Rolling, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows: gram hash, context hash, first and last window, anchor."""
    n = len(data)
    sums = rolling.sums(data)
    at = np.arange(n - gram + 1)
    hashes = mixed((sums[gram:] - sums[: n - gram + 1]) * rolling.down[: n - gram + 1])
    keys = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    place = (sliding_min(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    high = np.concatenate([low[1:] - 1, [len(place) - 1]])
    anchor = place[low]
    context = mixed(rolling.of(sums, low, high + length) + mixed((anchor - low).astype(np.uint64) << np.uint64(20) | (high - low).astype(np.uint64)))
    return hashes[anchor].view(np.int64), context.view(np.int64), low, high, anchor


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Landed table row, low, high: runs of repeated windows of the rows of `docs` (row is a hash of id and text)."""
    rows = keyed(docs)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
            held = 0

            def out() -> pa.RecordBatch:
                names = ["gram", "context", "low", "high", "anchor", "row"]
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(np.int64)) for p in parts], names=names)

            for row, text in zip(batch["row"].to_pylist(), text_bytes(batch["text"]), strict=True):
                if len(text) < length:
                    continue
                found = anchors(np.frombuffer(text, np.uint8), rolling, length, gram)
                for p, values in zip(parts, [*found, np.full(len(found[0]), row, np.int64)], strict=True):
                    p.append(values)
                held += len(found[0])
                if held > ROWS:
                    yield out()
                    parts, held = [[], [], [], [], [], []], 0
            if held:
                yield out()

    table = land(rows.mapInArrow(sample, "gram long, context long, low long, high long, anchor long, row long"))
    again = table.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    kept = land(table.join(again, "gram"))
    # Context classes, one representative each; strings that have several of them are compared window by window.
    heads = land(kept.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("row", "low", "high", "anchor")).alias("head")))
    several = heads.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
    open_heads = heads.join(several, "gram").select("gram", "context", "contexts", "head.*")
    per_row = land(open_heads.groupBy("row").agg(F.collect_list(F.struct("gram", "context", "contexts", "low", "high", "anchor")).alias("heads")))
    # Bytes of the representatives, from the documents that hold one. Rows alike give the same bytes; one is enough.
    texts = marked(rows, maybe_in(per_row, "row"), "row", "__maybe").where("__maybe").join(per_row, "row").select("row", "text", "heads")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, heads in zip(text_bytes(batch["text"]), batch["heads"], strict=True):
                found = heads.as_py()
                names = ("gram", "context", "contexts")
                yield pa.RecordBatch.from_pydict({
                    **{c: pa.array([h[c] for h in found], pa.int64()) for c in names},
                    "offset": pa.array([h["anchor"] - h["low"] for h in found], pa.int32()),
                    "data": pa.array([text[h["low"] : h["high"] + length] for h in found], pa.binary()),
                })

    pieces = land(texts.mapInArrow(contexts, "gram long, context long, contexts long, offset int, data binary"))

    def names_of(grams: np.ndarray, offsets: np.ndarray, data: list[bytes], rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows of the contexts: context number, place, name (string, offset to the anchor, bytes)."""
        sizes = np.array([len(d) for d in data])
        starts = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(data)), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        sums = rolling.sums(np.frombuffer(b"".join(data), np.uint8))
        at = starts[owner] + place
        return owner, place, mixed(rolling.of(sums, at, at + length) + mixed(grams[owner] + mixed((offsets[owner] - place).astype(np.uint64))))

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["gram", "context"])
        rolling, out = Rolling(), []
        owner, place, names = names_of(group["gram"].to_numpy(np.int64).view(np.uint64), group["offset"].to_numpy(np.int64), list(group["data"]), rolling)
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        twice = np.zeros(len(names), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        # Runs of repeated windows, none across two contexts.
        run = twice & np.concatenate([[True], ~twice[:-1] | (owner[1:] != owner[:-1])])
        last = twice & np.concatenate([~twice[1:] | (owner[1:] != owner[:-1]), [True]])
        first, final = np.flatnonzero(run), np.flatnonzero(last)
        out = group.iloc[owner[first]][["gram", "context"]].reset_index(drop=True)
        out["start"], out["stop"] = place[first], place[final]
        return out

    slices = max(8, rows.rdd.getNumPartitions())
    dealt = pieces.where(F.col("contexts") <= HOT).withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(slices * 4)).cast("int"))
    light = dealt.groupBy("slice").applyInPandas(compare, "gram long, context long, start long, stop long")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                grams = part["gram"].to_numpy().view(np.uint64)
                owner, place, names = names_of(grams, part["offset"].to_numpy().astype(np.int64), part["data"].to_pylist(), rolling)
                yield pa.RecordBatch.from_arrays([pa.array(part["gram"].to_numpy()[owner]), pa.array(part["context"].to_numpy()[owner]), pa.array(place), pa.array(names.view(np.int64))], names=["gram", "context", "start", "name"])

    spread = pieces.where(F.col("contexts") > HOT).dropDuplicates(["gram", "context"]).mapInArrow(windows, "gram long, context long, start long, name long")
    twice = spread.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    heavy = spread.join(twice, "name").select("gram", "context", "start", F.col("start").alias("stop"))
    runs = land(light.unionByName(heavy).groupBy("gram", "context").agg(F.collect_list(F.struct("start", "stop")).alias("runs")))
    whole = heads.where("members > 1").select("gram", "context", F.lit(True).alias("whole"))
    found = heads.select("gram", "context").join(whole, ["gram", "context"], "left").join(runs, ["gram", "context"], "left").where("whole or runs is not null")
    full = F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("high") - F.col("low")).alias("stop")))
    back = kept.join(found, ["gram", "context"]).select("row", "low", F.explode(F.when(F.col("whole"), full).otherwise(F.col("runs"))).alias("run"))
    return land(back.select("row", (F.col("low") + F.col("run.start")).alias("low"), (F.col("low") + F.col("run.stop")).alias("high")))


def keyed(docs: DataFrame) -> DataFrame:
    rows = checked(docs, "doc_id", "text")
    return rows.withColumn("row", F.xxhash64("doc_id", "text"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and `kept` (the remaining bytes)."""
    found = repeated(docs, length, gram)
    per_row = land(found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("runs")))
    rows = keyed(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for text, runs in zip(text_bytes(batch["text"]), batch["runs"].to_pylist(), strict=True):
                ranges: list[list[int]] = []
                for run in runs or ():
                    low, high = run["low"], run["high"] + length
                    if ranges and low <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], high)
                    else:
                        ranges.append([low, high])
                rest, at = [], 0
                for low, high in ranges:
                    rest.append(text[at:low])
                    at = high
                rest.append(text[at:])
                left = b"".join(rest)
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                spans.append(len(ranges))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            columns = {"doc_id": batch["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    # Only documents that may hold a repeated window travel to meet their runs.
    split = marked(rows, maybe_in(per_row, "row"), "row", "__maybe")
    none = F.lit(None).cast(per_row.schema["runs"].dataType)
    hit = split.where("__maybe").join(per_row, "row", "left").select("doc_id", "text", "runs")
    rest = split.where("not __maybe").select("doc_id", "text", none.alias("runs"))
    return hit.unionByName(rest).mapInArrow(cut, shape)
