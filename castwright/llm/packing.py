"""Packing documents into sequences of a fixed length by a grouping genetic algorithm on islands.

1. Every document's ids are counted and cut: one longer than a sequence gives whole sequences behind a first piece that may be shorter.
   Pieces that fill a sequence are done; the others are packed.
2. Pieces are dealt into groups of about `GROUP` by a hash of their row number, so that a run of like lengths is spread. A group is
   packed by `ISLANDS` islands, each a Spark task on its own population of `POPULATION` packings. Islands start differently: best fit by
   falling size (noise added for all but the first), and exact fill (largest piece first, then the one, two or three that fill the rest).
3. A child takes over some whole full bins of one parent; bins of the other that hold any of their pieces are dissolved, as are some of the worst. The
   pieces without a place replace smaller ones where that fills a bin further, and the rest go, by falling size, where they fit best. It replaces a
   parent or the worst of the population if it is better: fewer bins, then the greater sum of squared fills.
4. After each of `EPOCHS` rounds the best packing of an island moves to the next island of the group. Rounds are landed. A group stops at its lower bound.
5. The worst bins of a group, and some full ones to trade with, are dissolved and packed again with those of other groups, until one group is left.

Null and empty texts hold the end id only. Rows are kept one to one, repeated ones and those with null ids too. An empty table gives an empty result.
Ids keep their type; other columns don't matter. Numbers of sequences are arbitrary but the same in every run on the same landed pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwright.llm.common import checked, land
from castwright.llm.tokens import encoder

CAPACITY, GROUP, ISLANDS, POPULATION, EPOCHS, CHILDREN, TRIES = 1024, 1 << 14, 2, 4, 2, 40, 24


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Landed pieces of all documents: row (a number of its own), doc_id, piece, start, length, ids_crc32."""
    rows = checked(docs, "doc_id", "text")
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [T.LongType(), rows.schema["doc_id"].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, "<u4")
        end, row = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for k, text in enumerate(batch["text"]):
                ids = own.of(text.as_py() or "") + end
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                out[0] += [k] * (len(edges) - 1)
                out[1] += range(len(edges) - 1)
                out[2] += edges[:-1]
                out[3] += [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]
                out[4] += [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            numbers = pa.array(np.arange(row, row + len(out[0])))
            row += len(out[0])
            columns = [pa.array(c, t) for c, t in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([numbers, batch["doc_id"].take(pa.array(out[0], pa.int64())), *columns], names)

    return land(rows.mapInArrow(cut, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])))


class Sizes:
    """Pieces by size, with a bit set of the sizes there are, so that the fitting size is found at once."""

    def __init__(self, size: list[int], pieces: list[int], capacity: int) -> None:
        self.size, self.held, self.mask = size, [[] for _ in range(capacity + 1)], 0
        for i in pieces:
            self.add(i)

    def add(self, i: int) -> None:
        s = self.size[i]
        self.held[s].append(i)
        self.mask |= 1 << s

    def take(self, s: int) -> int:
        own = self.held[s]
        i = own.pop()
        if not own:
            self.mask ^= 1 << s
        return i

    def largest(self, most: int) -> int:
        """The largest size up to `most`, or 0."""
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1)

    def rest(self) -> list[int]:
        """What is left, largest first."""
        return [i for own in reversed(self.held) for i in own]


def best_fit(bins: np.ndarray, size: list[int], fills: list[int], pieces: list[int], capacity: int) -> None:
    """Put each piece, in the order given, into the fullest bin it fits in, or a new one; changes `bins` and `fills`."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, fill in enumerate(fills):
        if fill < capacity:
            room[capacity - fill].append(b)
            mask |= 1 << (capacity - fill)
    for i in pieces:
        s = size[i]
        fitting = mask >> s
        if fitting:
            left = s + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, b = capacity, len(fills)
            fills.append(0)
        bins[i], fills[b], left = b, fills[b] + s, left - s
        if left:
            room[left].append(b)
            mask |= 1 << left


def exact_fill(size: list[int], capacity: int) -> np.ndarray:
    """Bins from the largest piece on, each closed by the one, two or three pieces that fill it, if there are, else by the largest that fit."""
    bins, b = np.zeros(len(size), np.int64), -1
    count = np.bincount(size, minlength=capacity + 1).tolist()
    mask = turned = 0
    for s, n in enumerate(count):
        if n:
            mask |= 1 << s
            turned |= 1 << (capacity - s)
    held = Sizes(size, [*range(len(size))], capacity)

    def use(s: int) -> None:
        nonlocal turned
        bins[held.take(s)] = b
        if not held.held[s]:
            turned ^= 1 << (capacity - s)

    def pair(gap: int, without: int = 0) -> int:
        """The larger of two sizes that fill the gap, one piece of size `without` left aside; or 0."""
        both = held.mask & (turned >> (capacity - gap)) & ((1 << gap) - 1)
        while both:
            s = both.bit_length() - 1
            need = {s: 1, gap - s: 1} if 2 * s != gap else {s: 2}
            if all(len(held.held[x]) >= n + (x == without) for x, n in need.items()):
                return s
            both &= ~(1 << s) & ~(1 << (gap - s))
        return 0

    while held.mask:
        b += 1
        s = held.mask.bit_length() - 1
        use(s)
        gap = capacity - s
        while gap and (largest := held.largest(gap)):
            if largest == gap:
                use(gap)
                break
            if x := pair(gap):
                use(x), use(gap - x)
                break
            tried, first = held.mask & ((1 << gap) - 1), largest
            for _ in range(TRIES):
                if not tried:
                    break
                x = tried.bit_length() - 1
                tried ^= 1 << x
                if pair(gap - x, x):
                    first = x
                    break
            use(first)
            gap -= first
    return bins


def replaced(bins: np.ndarray, size: list[int], fills: list[int], loose: list[int], capacity: int) -> list[int]:
    """Let loose pieces take the place of smaller ones where the bin is fuller then; what is loose afterwards, largest first."""
    sizes, full = Sizes(size, loose, capacity), np.array(fills) == capacity
    placed = np.flatnonzero(bins >= 0)
    placed = placed[~full[bins[placed]]]
    placed = placed[np.argsort(np.array(size)[placed], kind="stable")]
    for i, b in zip(placed.tolist(), bins[placed].tolist(), strict=True):
        gap = capacity - fills[b]
        if gap and (s := sizes.largest(size[i] + gap)) > size[i]:
            bins[sizes.take(s)], bins[i] = b, -1
            fills[b] += s - size[i]
            sizes.add(i)
    return sizes.rest()


def fitness(bins: np.ndarray, lengths: np.ndarray) -> tuple[int, int]:
    """Less is better: the number of bins, then the squared fills."""
    fills = np.bincount(bins, weights=lengths).astype(np.int64)
    return int(np.count_nonzero(fills)), -int((fills * fills).sum())


def child(one: np.ndarray, other: np.ndarray, lengths: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """A packing with some full bins of `other`, the bins of `one` that hold none of their pieces, and the rest packed anew."""
    fills = np.bincount(other, weights=lengths)
    well = np.flatnonzero(fills == capacity)
    well = well if len(well) else np.flatnonzero(fills >= np.median(fills))
    first, many = rng.integers(len(well)), rng.integers(1, max(2, len(well) // 20 + 1))
    given = np.zeros(len(fills), bool)
    given[well[(first + np.arange(many)) % len(well)]] = True
    taken = given[other]
    mine = np.bincount(one, weights=lengths)
    dissolved = np.zeros(len(mine), bool)
    dissolved[one[taken]] = True
    worst = np.flatnonzero(mine < capacity)
    if len(worst):
        dissolved[rng.choice(worst, min(len(worst), rng.integers(1, 100)), replace=False)] = True
    bins = np.where(dissolved[one], -1, one)
    bins[taken] = len(mine) + other[taken]
    placed = bins >= 0
    bins[placed] = np.unique(bins[placed], return_inverse=True)[1]
    size, held = lengths.tolist(), np.bincount(bins[placed], weights=lengths[placed]).astype(np.int64).tolist()
    loose = replaced(bins, size, held, np.flatnonzero(~placed).tolist(), capacity)
    best_fit(bins, size, held, loose, capacity)
    return np.unique(bins, return_inverse=True)[1]


def founders(lengths: np.ndarray, island: int, rng: np.random.Generator, capacity: int) -> list[np.ndarray]:
    """The first packings of an island."""
    size, out = lengths.tolist(), []
    for k in range(POPULATION):
        if k == 0 and island % 2:
            out.append(exact_fill(size, capacity))
            continue
        bins = np.zeros(len(size), np.int64)
        noise = 1 + (0.02 * k) * rng.standard_normal(len(size))
        best_fit(bins, size, [], np.argsort(-lengths * noise, kind="stable").tolist(), capacity)
        out.append(bins)
    return out


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    return max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))


def evolved(lengths: np.ndarray, population: list[np.ndarray], seed: int, capacity: int) -> list[np.ndarray]:
    """The population after `CHILDREN` children, best first."""
    rng, bound = np.random.default_rng(seed), least_bins(lengths, capacity)
    ranked = sorted(((fitness(bins, lengths), k, bins) for k, bins in enumerate(population)), key=lambda x: x[:2])
    for n in range(CHILDREN):
        if ranked[0][0][0] <= bound or len(ranked) < 2:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        bins = child(ranked[a][2], ranked[b][2], lengths, rng, capacity)
        now = fitness(bins, lengths)
        out = a if now <= ranked[a][0] else len(ranked) - 1
        if now < ranked[out][0] or out == a:
            ranked[out] = (now, len(population) + n, bins)
            ranked.sort(key=lambda x: x[:2])
    return [bins for _, _, bins in ranked]


def evolve(islands: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """One round on every island: rows group, island, lengths, population (packings, best first), bins_used, squares."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                seed = [row["group"] & 0x7FFFFFFF, row["island"], epoch]
                population = [np.frombuffer(p, "<u2").astype(np.int64) for p in row["population"] or []]
                population = population or founders(lengths, row["island"], np.random.default_rng(seed), capacity)
                if row["guest"] is not None:  # the neighbour's best takes the place of the worst
                    population[-1] = np.frombuffer(row["guest"], "<u2").astype(np.int64)
                found = evolved(lengths, population, seed, capacity)
                used, squares = fitness(found[0], lengths)
                packed = [bins.astype("<u2").tobytes() for bins in found]
                yield pa.RecordBatch.from_pylist([{"group": row["group"], "island": row["island"], "lengths": row["lengths"], "population": packed, "bins_used": used, "squares": squares}], schema)

    schema = pa.schema([("group", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int64())), ("population", pa.list_(pa.binary())), ("bins_used", pa.int64()), ("squares", pa.int64())])
    return islands.mapInArrow(go, "group long, island int, lengths array<long>, population array<binary>, bins_used long, squares long")


def packed_groups(groups: DataFrame, many: int, capacity: int) -> DataFrame:
    """The best packing of each group (group, lengths): group, bins (the bin of each piece)."""
    tasks = min(many * ISLANDS, 1 << 14)
    state = groups.select("group", F.explode(F.array([F.lit(i) for i in range(ISLANDS)])).alias("island"), "lengths")
    state = state.withColumns({"population": F.lit(None).cast("array<binary>"), "guest": F.lit(None).cast("binary")})
    for epoch in range(EPOCHS):
        after = land(evolve(state.repartition(tasks), epoch, capacity))
        best = after.select("group", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.col("population")[0].alias("guest"))
        state = after.drop("bins_used", "squares").join(best, ["group", "island"])
    order = F.struct("bins_used", "squares", "island")
    return after.groupBy("group").agg(F.min_by(F.col("population")[0], order).alias("bins"))


def placed(groups: DataFrame, release: int, seed: int, capacity: int) -> DataFrame:
    """Per piece of the groups (group, rows, lengths, bins): row, length, sequence (the row of the bin's first piece), offset, released.

    About `release` pieces of each group are released: of the worst bins, and half as many of others, taken at random. 0 releases none.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, rows, bins = (np.array(row["lengths"], np.int64), np.array(row["rows"], np.int64), np.frombuffer(row["bins"], "<u2").astype(np.int64))
                order = np.argsort(bins, kind="stable")
                lengths, rows, bins = lengths[order], rows[order], bins[order]
                first = np.searchsorted(bins, bins)
                before = np.cumsum(lengths) - lengths
                fills, members = np.bincount(bins, weights=lengths).astype(np.int64), np.bincount(bins)
                freed = np.zeros(len(fills), bool)
                worst = np.argsort(fills, kind="stable")
                freed[worst[(np.cumsum(members[worst]) <= release) & (fills[worst] < capacity)]] = True
                others = np.random.default_rng([row["group"] & 0x7FFFFFFF, seed]).permutation(np.flatnonzero(~freed))
                if freed.any():
                    freed[others[np.cumsum(members[others]) <= release // 2]] = True
                yield pa.RecordBatch.from_pydict({"row": rows, "length": lengths, "sequence": rows[first], "offset": before - before[first], "released": freed[bins]})

    return groups.mapInArrow(place, "row long, length long, sequence long, offset long, released boolean")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_pieces(docs, tokenizer, end_id, capacity)
    done = [pieces.where(F.col("length") == capacity).select("row", F.col("row").alias("sequence"), F.lit(0).cast("long").alias("offset"))]
    waiting, level = pieces.where(F.col("length") < capacity).select("row", "length"), 0
    while True:
        many = math.ceil(waiting.count() / GROUP)
        if not many:
            break
        group = F.pmod(F.xxhash64(F.col("row"), F.lit(level)), F.lit(many))
        own = F.sort_array(F.collect_list(F.struct("length", "row")), asc=False)  # GROUP pieces in the mean, as rows differ
        groups = land(waiting.groupBy(group.alias("group")).agg(own.alias("own")).select("group", F.col("own.row").alias("rows"), F.col("own.length").alias("lengths")))
        best = packed_groups(groups.select("group", "lengths"), many, capacity)
        found = land(placed(groups.join(best, "group"), GROUP // 8 if many > 1 else 0, level, capacity))
        done.append(found.where(~F.col("released")).select("row", "sequence", "offset"))
        if many == 1:
            break
        waiting, level = found.where("released").select("row", "length"), level + 1
    places = reduce(DataFrame.unionByName, done)
    return pieces.join(places, "row").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset")
