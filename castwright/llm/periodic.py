"""Periodic runs of words, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q and a length of at least max(`LEAST`, `POWER` * q) that no
neighbouring word extends. Each text is judged on its own, many texts at a time:

1. Prefix doubling sorts the suffixes of the word sequence. After the step for length B, the occurrences of any block of B
   words are one interval of the suffix array. Words of different texts never count as equal.
2. Blocks of B = 8, 16, 32, ... words start at multiples of B. A run of period q holds a whole block, with B the largest of these up to
   q (8 at least), and the block's copy q words later: the run without its last q words has at least 2 * B - 1 words.
3. So every block that occurs twice asks for its occurrences in the window of starts from B to 2 * B - 1 words behind it (for the smallest
   blocks also 1 to 7): a wavelet tree over the suffix array answers by range successor queries.
4. Occurrences of a block that start within its own length are an arithmetic progression. Up to two of them: each gives
   a candidate period. Three or more: the block itself is periodic, and a longer period must carry the stretch of the block's
   period onto that of its copies, so only the differences of the stretches' left and right ends are candidates.
5. Candidates are extended both ways word by word. A stretch found with two periods is a run of the smaller one.

Work is n log n for n words. Null and empty texts have no words. A text needs memory for its own words, some 100 bytes each, however long.
Rows are kept one to one, repeated ones and those with a null id too (a null id counts as the empty string in the contract's hash); an
empty table gives an empty one. Other columns don't matter: only `doc_id` and `text` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwright.llm.common import checked, text_bytes
from castwright.llm.words import in_chunks

LEAST, POWER, SMALLEST, CHUNK = 24, 3, 8, 1 << 20


class WaveletTree:
    """Counts and order statistics over ranges of a sequence of numbers from 0 to `size` - 1, many queries at a time."""

    def __init__(self, values: np.ndarray, size: int) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []
        for bit in reversed(range(size.bit_length())):
            ones = (values >> bit) & 1
            before = np.zeros(len(values) + 1, np.int64)
            np.cumsum(1 - ones, out=before[1:])
            self.levels.append((bit, before))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range [low, high) are less than the bound, which is `size` at most."""
        count = np.zeros(len(low), np.int64)
        for bit, before in self.levels:
            zeros, low0, high0 = before[-1], before[low], before[high]
            one = (bound >> bit) & 1 == 1
            count += np.where(one, high0 - low0, 0)
            low, high = np.where(one, zeros + low - low0, low0), np.where(one, zeros + high - high0, high0)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each range [low, high), which holds more than k."""
        out = np.zeros(len(low), np.int64)
        for bit, before in self.levels:
            zeros, low0, high0 = before[-1], before[low], before[high]
            left = high0 - low0
            one = k >= left
            k = np.where(one, k - left, k)
            out += np.where(one, 1 << bit, 0)
            low, high = np.where(one, zeros + low - low0, low0), np.where(one, zeros + high - high0, high0)
        return out


def agreement(words: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, step: int = 1) -> np.ndarray:
    """For how many steps, `limit` at most, the words from i and from j on stay equal."""
    out, live, width = np.zeros(len(i), np.int64), np.flatnonzero(limit > 0), 16
    while len(live):
        ahead = out[live, None] + np.arange(width)
        inside = ahead < limit[live, None]
        ahead = np.where(inside, ahead, 0) * step
        unlike = ~inside | (words[i[live, None] + ahead] != words[j[live, None] + ahead])
        stopped = unlike.any(axis=1)
        out[live] += np.where(stopped, unlike.argmax(axis=1), width)
        live = live[~stopped]
        width = min(2 * width, max(16, (1 << 18) // max(len(live), 1)))
    return out


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and size of the group of equal neighbours that each of the sorted keys is in."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(first, len(keys)))
    return np.repeat(first, sizes), np.repeat(sizes, sizes)


def occurrences(words: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array of the places whose next `SMALLEST` words occur twice, and the blocks that do: (B, starts, interval).

    Prefix doubling; a block of B words is asked for only where runs of period B, so of POWER * B words, fit into the longest text.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    first, size = groups_of(words[order])
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = first, -1
    live = size > 1
    places, own = order[live], first[live]
    length, blocks, suffixes = 1, [], np.zeros(0, np.int64)
    while len(places) and (length < SMALLEST or length * 2 * POWER <= max(longest, 2 * POWER * SMALLEST)):
        key = own * (n + 1) + rank[np.minimum(places + length, n)] + 1
        order = np.argsort(key, kind="stable")
        places, old = places[order], own[order]
        first, size = groups_of(key[order])
        start = groups_of(old)[0]
        own = old + first - start
        rank[places] = own
        length *= 2
        live = size > 1
        if length >= SMALLEST:
            if length == SMALLEST:  # from here on an index of the suffix array counts only the places that are left
                places, size = places[live], size[live]
                rank[places] = own[live]
                suffixes, slot, live = places.copy(), groups_of(own[live])[0], np.ones(len(places), bool)
                own = rank[places]
            else:
                slot = slot[order] + first - start
                suffixes[slot + np.arange(len(places)) - first] = places
            whole = live & (places % length == 0)
            blocks.append((length, places[whole], slot[whole], slot[whole] + size[whole]))
            slot = slot[live]
        places, own = places[live], own[live]
    return suffixes, blocks


def candidates(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods such that every run holds one of them: the words from the place on agree with those a period later."""
    suffixes, blocks = occurrences(words, longest)
    if not len(suffixes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = np.sort(suffixes)
    tree = WaveletTree(np.searchsorted(known, suffixes), len(known))
    at, periods, n = [], [], len(words)
    for length, b, low, high in blocks:
        windows = [(length, 2 * length)] + [(1, length)] * (length == SMALLEST)
        for near, far in windows:
            c0 = tree.below(low, high, np.searchsorted(known, b + near))
            c1 = tree.below(low, high, np.searchsorted(known, b + far))
            some = c1 > c0
            x, lo, hi, c, many = b[some], low[some], high[some], c0[some], (c1 - c0)[some]
            first = known[tree.smallest(lo, hi, c)]
            last = known[tree.smallest(lo, hi, c + many - 1)]
            if near == 1:  # the period is not longer than the block, so the next occurrence is one period away
                at.append(x), periods.append(first - x)
                continue
            few = many <= 2
            at += [x[few], x[few]]
            periods += [first[few] - x[few], last[few] - x[few]]
            x, first, last = x[~few], first[~few], last[~few]
            p = known[tree.smallest(lo[~few], hi[~few], c[~few] + 1)] - first
            right = x + length + agreement(words, x + length - p, x + length, np.minimum(first - x, n - x - length))
            other = right < first + length  # else block and copies lie in one stretch of the shorter period
            x, first, last, p, right = x[other], first[other], last[other], p[other], right[other]
            copied = last + length + agreement(words, last + length - p, last + length, np.minimum(3 * length, n - last - length))
            left = x - agreement(words, x - 1, x - 1 + p, np.minimum(2 * length, x), -1)
            copied_left = first - agreement(words, first - 1, first - 1 + p, first - x, -1)
            for q in (copied - right, copied_left - left):
                fits = (q >= length) & (q < 2 * length)
                at.append(x[fits]), periods.append(q[fits])
    return np.concatenate(at), np.concatenate(periods)


def runs_of(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period. Equal numbers are equal words; no word is in two texts."""
    at, period = candidates(words, longest)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    # A candidate is followed to the next one of its period, which goes on from there.
    more = np.append(period[1:] == period[:-1], False)
    limit = np.where(more, np.append(at[1:], 0) - at, len(words) - at - period)
    reach = agreement(words, at, at + period, np.minimum(limit, len(words) - at - period))
    linked = more & (reach == limit)
    head = np.concatenate([[True], ~linked[:-1]])
    tail = ~linked
    start, period, end = at[head], period[head], (at + period + reach)[tail]
    start = start - agreement(words, start - 1, start - 1 + period, start, -1)
    length = end - start
    kept = length >= np.maximum(LEAST, POWER * period)
    found = np.stack([start, length, period], axis=1)[kept]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):  # one stretch, several periods: the smallest counts
        found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found


def analysed(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text, as words: its runs, and the words that are no repetition, joined by one space."""
    counts = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    numbers = np.empty(starts[-1], np.int64)
    for text, low, high in zip(texts, starts[:-1], starts[1:], strict=True):
        seen: dict[bytes, int] = {}  # a word's number is its first place
        numbers[low:high] = np.fromiter(map(seen.setdefault, text, range(low, high)), np.int64, high - low)
    runs = runs_of(numbers, int(counts.max(initial=0)))
    parts = np.searchsorted(runs[:, 0], starts)
    for k, text in enumerate(texts):
        own = runs[parts[k] : parts[k + 1]] - np.array([starts[k], 0, 0])
        if len(own):
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, own[:, 0] + own[:, 2], 1)
            np.add.at(change, own[:, 0] + own[:, 1], -1)
            text = [text[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        yield own, b" ".join(text)


def find_runs(docs: DataFrame, rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, runs (array of start, length, period, in words), collapsed (the text without repetitions).

    `rewrite(doc_id, n)` may give, for each of the n words, the number of the word that stands in its place.
    """
    rows = checked(docs, "doc_id", "text")
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    shape = T.StructType([rows.schema["doc_id"], T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    fields = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for chunk in in_chunks(text_bytes(batch["text"]), CHUNK):
                keys = batch["doc_id"].slice(done, len(chunk))
                done += len(chunk)
                texts = [text.split() for text in chunk]
                if rewrite is not None:
                    for k, key in enumerate(keys.to_pylist()):
                        if texts[k] and (order := rewrite(key, len(texts[k]))) is not None:
                            texts[k] = [texts[k][i] for i in order]
                found = [*analysed(texts)]
                flat = np.concatenate([runs for runs, _ in found])
                ends = np.concatenate([[0], np.cumsum([len(runs) for runs, _ in found])])
                values = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=[*fields])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([keys, lists, pa.array([c.decode() for _, c in found], pa.string())], ["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(find, shape)


def planted_repeats(key: object, n: int) -> np.ndarray | None:
    """A rewriting that makes every tenth text (by the crc32 of its id) periodic from some word on."""
    h = zlib.crc32(str("" if key is None else key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def digests(found: DataFrame) -> DataFrame:
    """Per row of `find_runs`: doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli) and two checksums."""
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),  # in order of start, then period, so the first of equals stays
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
