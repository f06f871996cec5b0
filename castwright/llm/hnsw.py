"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

1. Equal vectors form one class, which keeps its `KEEP` smallest ids; so a vector with a third of all rows is one node.
2. Classes are dealt at random (by a hash of the vector) to shards of `SHARD` nodes or more (`shard_size`).
3. Each shard's graph: node levels fall geometrically. On each level a node is linked to nodes chosen among its nearest
   on that level, a candidate only if it is nearer to the node than to every node chosen before; links go both ways
   until a node is full. The nearest nodes are found exactly, in blocks, as a shard is small. Inner products are made a
   distance by one more component, sqrt(R^2 - |x|^2) with R the largest norm of the shard. Neighbours are flat int32 arrays.
4. Blocks of queries visit every shard. All queries of a block walk the graph in step: greedily down the upper levels, then
   with a beam of `BEAM` on the lowest, wider by the root of what a shard is larger than `SHARD`. Scores of what they find are then taken in double precision on the original vectors.
5. A query's results from all shards are merged.

Rows whose vector is null, zero, or holds a null or non-finite component take no part, neither as query nor as candidate; a
null id neither. Vectors of different length do not meet. Repeated rows (same id and vector) count once. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castwright.llm.common import checked, land

SHARD, LINKS, NEAR, BEAM, AT_ONCE, BLOCK = 4096, 16, 48, 96, 4, 512
# The largest shard, in nodes and bytes of vectors, and the factor of its growth: of the cost of a visit and that of a compared pair.
MOST, SHARD_BYTES, BALANCE = 32_768, 1 << 25, 1_250


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, dim, v (little-endian doubles) of the rows that take part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, packed = [], [], []
            for i, value in zip(batch[0].to_pylist(), batch[1], strict=True):
                if i is None or not value.is_valid or value.values.null_count or not len(value.values):
                    continue
                x = value.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0.0 is 0.0
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    dims.append(len(x))
                    packed.append(x.tobytes())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "dim": pa.array(dims, pa.int32()), "v": pa.array(packed, pa.binary())})

    return checked(vectors, key, vector).mapInArrow(pack, "id long, dim int, v binary")


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """dim, v, ids (the `keep` smallest, ascending) of each distinct vector; a task keeps its own smallest first."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"dim": pa.array([d for d, _ in found], pa.int32()), "v": pa.array([v for _, v in found], pa.binary()), "ids": pa.array([*found.values()], pa.list_(pa.int64()))})

        for batch in batches:
            for i, dim, v in zip(batch["id"].to_pylist(), batch["dim"].to_pylist(), batch["v"].to_pylist(), strict=True):
                own = found.setdefault((dim, v), [])
                own.append(i)
                if len(own) > 2 * keep:
                    own[:] = sorted({*own})[:keep]
            if len(found) > 50_000:
                yield out()
                found.clear()
        yield out()

    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return rows.mapInArrow(local, "dim int, v binary, ids array<long>").groupBy("dim", "v").agg(ids.alias("ids"))


def links_of(x: np.ndarray, degree: int, near: int = NEAR) -> np.ndarray:
    """Neighbours of every row of `x` (by distance), -1 where there are fewer: int32 of shape (n, 2 * degree)."""
    n, out = len(x), np.full((len(x), 2 * degree), -1, np.int32)
    if n < 2:
        return out
    near, half = min(near, n - 1), (x * x).sum(1) / 2
    kept = np.full((n, degree), -1, np.int32)
    for a in range(0, n, 256):
        b = min(a + 256, n)
        closeness = x[a:b] @ x.T - half  # higher is nearer
        closeness[np.arange(b - a), np.arange(a, b)] = -np.inf
        found = np.argpartition(-closeness, near - 1, axis=1)[:, :near]
        found = np.take_along_axis(found, np.argsort(-np.take_along_axis(closeness, found, 1), axis=1, kind="stable"), 1)
        points = x[found]
        between = np.einsum("pid,pjd->pij", points, points)
        between = half[found][:, :, None] + half[found][:, None, :] - between  # half squared distances of candidates
        own = half[a:b, None] - np.take_along_axis(closeness, found, 1)
        chosen, count = np.zeros(found.shape, bool), np.zeros(b - a, np.int64)
        for j in range(near):
            blocked = (chosen & (between[:, :, j] < own[:, j, None])).any(1)
            take = ~blocked & (count < degree)
            chosen[:, j], count = take, count + take
        # Chosen first, then the nearest others.
        order = np.argsort(~chosen, axis=1, kind="stable")[:, :degree]
        kept[a:b, : order.shape[1]] = np.take_along_axis(found, order, 1)
    out[:, :degree] = kept
    # Links back, nearest first, into the second half.
    source, target = np.repeat(np.arange(n, dtype=np.int32), degree), kept.ravel()
    source, target = source[target >= 0], target[target >= 0]
    far = ((x[source] - x[target]) ** 2).sum(1)
    order = np.lexsort((far, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    fits = place < degree
    out[target[fits], degree + place[fits]] = source[fits]
    return out


def build(vectors: np.ndarray, seed: int = 0, degree: int = LINKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of the graph from the lowest up: (nodes, neighbours as node numbers of the shard)."""
    x = vectors.astype(np.float32)
    norms = (x * x).sum(1)
    x = np.concatenate([x, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], 1)
    height = (-np.log(np.random.default_rng(seed).random(len(x))) / np.log(degree)).astype(int)
    levels, nodes, level = [], np.arange(len(x), dtype=np.int32), 0
    while len(nodes):
        found = links_of(x[nodes], degree)
        levels.append((nodes, np.where(found >= 0, nodes[found], -1).astype(np.int32)))
        level += 1
        nodes = np.flatnonzero(height >= level).astype(np.int32)
    return levels


def search(queries: np.ndarray, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], beam: int = BEAM) -> np.ndarray:
    """Node numbers found for each query, best first, -1 where there are fewer: shape (queries, beam)."""
    q, x, n = queries.astype(np.float32), vectors.astype(np.float32), len(vectors)
    rows = np.arange(len(q))[:, None]
    at = np.repeat(levels[-1][0][:1], len(q)).astype(np.int64)
    best = (q * x[at]).sum(1)
    for nodes, neighbours in levels[:0:-1]:
        place = np.zeros(n, np.int64)
        place[nodes] = np.arange(len(nodes))
        while True:
            around = neighbours[place[at]]
            scores = np.where(around >= 0, np.einsum("qd,qkd->qk", q, x[around]), -np.inf)
            pick = scores.argmax(1)
            better = scores[rows[:, 0], pick] > best
            if not better.any():
                break
            at[better], best[better] = around[rows[:, 0], pick][better], scores[rows[:, 0], pick][better]
    beam = min(beam, n)
    ids, scores, done = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32), np.ones((len(q), beam), bool)
    ids[:, 0], scores[:, 0], done[:, 0] = at, best, False
    seen = np.zeros((len(q), n + 1), bool)
    seen[rows[:, 0], at] = True
    base = levels[0][1]
    live = np.arange(len(q))  # queries with nodes to expand
    while len(live):
        i, s, d = ids[live], scores[live], done[live]
        front = ~d & (np.cumsum(~d, 1) <= AT_ONCE)  # the best that are not yet expanded
        d |= front
        who, slot = np.nonzero(front)
        around = base[i[who, slot]]
        who, around = np.repeat(who, around.shape[1]), around.ravel()
        new = (around >= 0) & ~seen[live[who], around]
        pairs = np.unique(who[new] * n + around[new])  # one place for a node that two expanded nodes share
        who, around = pairs // n, pairs % n
        seen[live[who], around] = True
        fresh = np.einsum("ij,ij->i", q[live[who]], x[around])
        near = fresh > s[who, -1]  # the others would not enter the beam
        who, around, fresh = who[near], around[near], fresh[near]
        counts = np.bincount(who, minlength=len(live))
        if len(who):
            shape, column = (len(live), counts.max()), np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
            more, gains, closed = np.full(shape, -1, np.int64), np.full(shape, -np.inf, np.float32), np.ones(shape, bool)
            more[who, column], gains[who, column], closed[who, column] = around, fresh, False
            i, s, d = np.concatenate([i, more], 1), np.concatenate([s, gains], 1), np.concatenate([d, closed], 1)
            order = np.argsort(-s, axis=1, kind="stable")[:, :beam]
            i, s, d = (np.take_along_axis(v, order, 1) for v in (i, s, d))
        ids[live], scores[live], done[live] = i, s, d
        live = live[~d.all(1)]
    return ids


def shard_size(nodes: int, dim: int) -> int:
    """Nodes of a shard. The exact links cost a node in proportion to it, the visits of the queries in inverse proportion, and both
    are least together where it grows as the root of the nodes; a shard must fit into a task, whatever the length of its vectors."""
    fits = max(SHARD, min(MOST, SHARD_BYTES // (8 * max(dim, 1))))
    return min(fits, max(SHARD, math.isqrt(BALANCE * nodes)))


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: int = 21, shard: int | None = None) -> DataFrame:
    """The landed index: a row per shard (shard, dim, v: its vectors, ids, nodes and links of all levels, flat)."""
    nodes = land(classes(usable(vectors, key, vector), keep))
    count, dim = nodes.agg(F.count(F.lit(1)), F.max("dim")).first()
    shards = max(1, -(-count // (shard or shard_size(count, dim or 1))))

    def graph(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v")  # the same graph on every run
        dim = int(key[1])
        x = np.frombuffer(b"".join(rows["v"]), "<f8").reshape(-1, dim)
        levels = build(x)
        sizes = [len(level[0]) for level in levels]
        counts = np.array([len(i) for i in rows["ids"]], "<i4")
        flat = np.concatenate([np.asarray(i, "<i8") for i in rows["ids"]])
        return pd.DataFrame({
            "shard": [key[0]], "dim": [dim], "v": [x.tobytes()], "ids": [flat.tobytes()], "counts": [counts.tobytes()], "sizes": [sizes],
            "nodes": [np.concatenate([level[0] for level in levels]).astype("<i4").tobytes()], "links": [np.concatenate([level[1] for level in levels]).astype("<i4").tobytes()],
        })

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    shape = "shard int, dim int, v binary, ids binary, counts binary, sizes array<int>, nodes binary, links binary"
    return land(dealt.groupBy("shard", "dim").applyInPandas(graph, shape))


def nearest(vectors: DataFrame, chosen: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM) -> DataFrame:
    """For each row of `vectors` that `chosen` selects, its k nearest other rows: query_id, rank, vec_id, score."""
    index = build_index(vectors, key, vector, keep=k + 1)
    homes = index.select("shard", "dim")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas()
            for dim, rows in table.groupby("dim"):
                for a in range(0, len(rows), BLOCK):
                    part = rows.iloc[a : a + BLOCK]
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([int(dim)], pa.int32()), "q_ids": [part["id"].to_numpy("<i8").tobytes()], "q": [b"".join(part["v"])]})

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                q, x = np.frombuffer(row["q"], "<f8").reshape(-1, dim), np.frombuffer(row["v"], "<f8").reshape(-1, dim)
                q_ids, ids, counts = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["counts"], "<i4")
                nodes, links = np.frombuffer(row["nodes"], "<i4"), np.frombuffer(row["links"], "<i4").reshape(len(row["nodes"]) // 4, -1)
                cuts = np.concatenate([[0], np.cumsum(row["sizes"])])
                levels = [(nodes[a:b], links[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                wide = int(beam * max(1.0, len(x) / SHARD) ** 0.5)  # a larger shard holds more of a query's nearest
                found = search(q, x, levels, max(wide, k + 1))
                # Every id of a found class, with the exact score.
                who, slot = np.nonzero(found >= 0)
                node = found[who, slot]
                exact = np.einsum("ij,ij->i", q[who], x[node])
                starts = np.concatenate([[0], np.cumsum(counts)])
                times = counts[node]
                who, exact = np.repeat(who, times), np.repeat(exact, times)
                own = ids[np.repeat(starts[node], times) + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)]
                keep = own != q_ids[who]
                who, exact, own = who[keep], exact[keep], own[keep]
                order = np.lexsort((own, -exact, who))
                who, exact, own = who[order], exact[order], own[order]
                first = np.arange(len(who)) - np.searchsorted(who, who) < k
                yield pa.RecordBatch.from_pydict({"query_id": q_ids[who[first]], "vec_id": own[first], "score": exact[first]})

    queries = usable(vectors.where(chosen), key, vector).distinct().mapInArrow(blocks, "dim int, q_ids binary, q binary")
    visits = queries.join(homes, "dim").join(index, ["shard", "dim"])  # every block of queries once at every shard of its length
    found = visits.mapInArrow(visit, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
