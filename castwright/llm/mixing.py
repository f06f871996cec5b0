"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

All steps are DataFrame expressions; no Python runs on the executors.

1. Every document has a size in words. A source's quota is its share of the mix in words.
2. Documents are dealt to blocks by a seeded hash, sqrt(documents) blocks a source, so both the number of blocks of a
   source and the documents of a block stay small beside the table. (Source, block) is also the key of every join:
   a source with a third of all rows is spread over all its blocks.
3. The quota is drawn as whole passes over the source plus a remainder. The remainder takes blocks
   in a seeded order until it is spent; the block where it ends gives documents in a seeded order up to the
   document that crosses the end, if that brings the total nearer. So the miss is below one document per source.
4. The drawn blocks are split among output shards by a binary tree. At each node the blocks of each source go left
   by a multivariate-hypergeometric draw (the sources one after the other, each hypergeometric given what is
   left of the left child's seats), so every shard has an exact number of blocks and the counts of all shards are disjoint.
5. Inside a shard documents are ordered by a seeded hash: a local shuffle without a global sort.

Results depend on ids, texts and the seed only, not on the partitioning. Rows alike in all columns are
numbered by an arbitrary order among themselves, which does not change the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castwright.llm.common import WORD, checked, land


def word_count(text: Column) -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Columns source, source_size, docs, target, from the columns source and size.

    The sources in code-point order (null last) weigh `weights`, repeating. They share `share` times all
    sizes by weight. A target stops at `most` times its source's size; what is over is shared again by weight
    among the others, until none is above (no more rounds than there are sources; the ratio size / weight tells
    the order in which sources fill up, so one window finds the last round directly).
    """
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    values = F.array(*[F.lit(float(w)) for w in weights])
    weighed = grouped.withColumn("weight", F.element_at(values, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    fill = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    # Were all sources before this one in `fill` at their cap, this many words a unit of weight would be left.
    level = F.greatest(total * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)), F.lit(0.0)) / F.sum("weight").over(after)
    levels = weighed.withColumn("cap", cap).withColumn("level", level)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    # The first source that is not full sets the level of all after it.
    open_level = F.min(F.when(~full, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(Window.partitionBy())["level"]
    rate = F.when(F.col("cap") <= open_level * F.col("weight"), F.col("cap")).otherwise(open_level * F.col("weight"))
    return levels.select("source", "source_size", "docs", F.coalesce(rate, "cap").alias("target"))


def hypergeometric(good: Column, bad: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `drawn` draws without replacement are good: the inverse of the distribution at `uniform`.

    Sums the probabilities over the whole support, from the log factorials of the bounds; the support has no more
    values than the smaller of the counts. Log factorials come from Stirling's series (exact to 1e-9 from 10 on).
    """

    def log_factorial(n: Column) -> Column:
        x = n + 1.0
        shift = F.log(x) + F.log(x + 1) + F.log(x + 2) + F.log(x + 3) + F.log(x + 4) + F.log(x + 5) + F.log(x + 6) + F.log(x + 7)
        z = x + 8.0
        return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + F.lit(1.0) / (z * 12.0) - F.lit(1.0) / (z * z * z * 360.0) - shift

    def log_choose(n: Column, k: Column) -> Column:
        return log_factorial(n) - log_factorial(k) - log_factorial(n - k)

    low, high = F.greatest(F.lit(0).cast("long"), drawn - bad), F.least(good, drawn)

    def step(state: Column, k: Column) -> Column:
        mass = F.exp(log_choose(good, k) + log_choose(bad, drawn - k) - log_choose(good + bad, drawn))
        # The answer is the last value before which the sum is still below `uniform`.
        return F.struct((state["sum"] + mass).alias("sum"), F.when(state["sum"] < uniform, k).otherwise(state["at"]).alias("at"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("at"))
    return F.aggregate(F.sequence(low, high), start, step, lambda s: s["at"])


def uniform_of(*columns: Column) -> Column:
    """A number in (0, 1) that follows from the columns."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def split_tree(blocks: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Columns source, shard, n: the blocks of each source (source, n) dealt to `shards` equal shards.

    `shards` is a power of two. One step of the tree splits every node in two; per node the sources come in
    code-point order, and each draws from the seats that the earlier ones left. The table has a row per source and node.
    """
    levels = shards.bit_length() - 1
    if shards != 1 << levels:
        raise ValueError("shards must be a power of two")
    nodes = blocks.select("source", F.lit(0).cast("long").alias("shard"), F.col("n").cast("long"))
    for level in range(levels):
        # A node's sources are folded one after the other, as each draw needs what the earlier ones took.
        rows = F.sort_array(F.collect_list(F.struct(F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("key"), "source", "n")))
        folded = nodes.groupBy("shard").agg(rows.alias("rows"), F.sum("n").alias("all"))
        zero = F.lit(0).cast("long")
        empty = F.array().cast("array<struct<source:string,shard:bigint,n:bigint>>")
        start = F.struct(F.floor((F.col("all") + 1) / 2).cast("long").alias("seats"), F.col("all").alias("rest"), empty.alias("out"))
        depth = F.lit(level)

        def deal(state: Column, row: Column) -> Column:
            u = uniform_of(F.lit(seed), depth, F.col("shard"), row["key"])  # noqa: B023
            left = F.when(state["seats"] <= 0, zero).otherwise(hypergeometric(row["n"], state["rest"] - row["n"], state["seats"], u))  # noqa: B023

            def after(left: Column) -> Column:
                children = F.array(
                    F.struct(row["source"].alias("source"), (F.col("shard") * 2).alias("shard"), left.alias("n")),
                    F.struct(row["source"].alias("source"), (F.col("shard") * 2 + 1).alias("shard"), (row["n"] - left).alias("n")),
                )
                return F.struct((state["seats"] - left).alias("seats"), (state["rest"] - row["n"]).alias("rest"), F.concat(state["out"], children).alias("out"))

            return F.transform(F.array(left), after)[0]  # the draw is bound, so it is made once

        nodes = folded.select(F.inline(F.aggregate("rows", start, deal, lambda s: s["out"])))
    return nodes.filter("n > 0")


SRC, BLOCK, KEY, SIZE, COPIES, SHARD, ORDER, ROW = "__src", "__block", "__key", "__size", "__copies", "__shard", "__order", "__row"
# Words of a shard, about: a task shuffles one shard locally.
SHARD_WORDS = 1 << 24


def keyed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Reserved columns: the source as a join key (null has its own), and a seeded key of the row."""
    src = F.coalesce(F.concat(F.lit("0"), F.col("`source`").cast("string")), F.lit("1"))
    return docs.withColumns({SRC: src, KEY: F.xxhash64(F.lit(seed), F.col("`doc_id`"), F.col("`text`"))})


def slim(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, key and a number of every row, landed, so that the texts are read once for all counts."""
    rows = keyed(docs, seed).withColumns({SIZE: word_count(F.col("`text`")), ROW: F.monotonically_increasing_id()})
    return land(checked(rows, "doc_id", "source", SRC, KEY, SIZE, ROW))


def shape_of(sized: DataFrame, share: float) -> tuple[int, int]:
    """Blocks of a source: the square root of the number of all documents. Shards: a power of two that grows with the mix, 16 at least."""
    docs, words = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum(SIZE), F.lit(0))).first()
    return max(1, math.isqrt(docs)), 1 << max(4, math.ceil(words * share / SHARD_WORDS - 1).bit_length())


def block_plan(sized: DataFrame, blocks: int, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """A row for each source and block: how often its documents are drawn.

    Columns __src, source_size, target, __block, passes (draws of every document of the block), cut (documents
    whose key is at most this are drawn once more; null: none), rank (the block's place in its source's order).
    """
    names = sized.groupBy(SRC).agg(F.first("source").alias("source"))
    wanted = targets(sized.select("source", F.col(SIZE).alias("size")), weights, share, most)
    same = names["source"].eqNullSafe(wanted["source"])
    goal = names.join(wanted, same).select(SRC, "source_size", "target")
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    placed = sized.select(SRC, F.pmod(F.col(KEY), F.lit(blocks)).alias(BLOCK), KEY, SIZE)
    words = placed.groupBy(SRC, BLOCK).agg(F.sum(SIZE).alias("words"))
    order = Window.partitionBy(SRC).orderBy(F.xxhash64(F.lit(seed), SRC, BLOCK), BLOCK)
    plan = words.join(goal, SRC).withColumns({"rank": F.row_number().over(order), "upto": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    plan = plan.withColumn("ends", (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    edge = plan.filter("ends").select(SRC, BLOCK, (F.col("rest") - (F.col("upto") - F.col("words"))).alias("left"))
    # Documents of the block where the remainder ends, by key; equal keys go together.
    run = Window.partitionBy(SRC, BLOCK).orderBy(KEY).rangeBetween(Window.unboundedPreceding, 0)
    sums = placed.join(edge, [SRC, BLOCK]).withColumn("sum", F.sum(SIZE).over(run))
    nearest = sums.groupBy(SRC, BLOCK).agg(F.min(F.struct(F.abs(F.col("sum") - F.col("left")).alias("off"), F.col(KEY).alias("key"))).alias("best"), F.max("left").alias("left"))
    cuts = nearest.filter("best.off < left").select(SRC, BLOCK, F.col("best.key").alias("edge"))
    last = F.lit((1 << 63) - 1).cast("long")
    plan = plan.join(cuts, [SRC, BLOCK], "left").withColumn("cut", F.when(F.col("upto") <= F.col("rest"), last).when(F.col("ends"), F.col("edge")))
    return plan.select(SRC, "source_size", "target", BLOCK, F.col("whole").alias("passes"), "cut", "rank")


def drawn(rows: DataFrame, plan: DataFrame, blocks: int) -> DataFrame:
    """`rows` (with the reserved key columns) joined to their block's plan, with __copies: how often each is drawn."""
    found = rows.withColumn(BLOCK, F.pmod(F.col(KEY), F.lit(blocks))).join(plan, [SRC, BLOCK])
    return found.withColumn(COPIES, F.col("passes") + F.when(F.col(KEY) <= F.col("cut"), 1).otherwise(0))


def deal(rows: DataFrame, sized: DataFrame, weights: Sequence[float], share: float, most: float, shards: int | None, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """The drawn copies of `rows` (with the reserved key columns) with their shard, the plan they follow, and the number of blocks."""
    blocks, grown = shape_of(sized, share)
    shards = shards or grown
    plan = land(block_plan(sized, blocks, weights, share, most, seed))
    # Every drawn block copy takes one slot of its source: pass by pass, in the source's block order.
    slots = plan.select(SRC, BLOCK, "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("copy"), "passes", "cut")
    slots = slots.filter((F.col("copy") < F.col("passes")) | F.col("cut").isNotNull())
    in_source = Window.partitionBy(SRC).orderBy("copy", "rank")
    slots = slots.withColumn("slot", F.row_number().over(in_source).cast("long"))
    counts = slots.groupBy(F.col(SRC).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    tree = land(split_tree(counts, shards, seed))
    # Shards take consecutive slots, so they are disjoint; the block order is already random.
    seats = tree.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("shard")) - F.col("n"))
    seats = seats.select(F.col("source").alias(SRC), F.col("shard").alias(SHARD), F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("slot"))
    homes = land(slots.join(seats, [SRC, "slot"]).select(SRC, BLOCK, F.col("copy").alias("__copy"), SHARD))
    taken = drawn(rows, plan.select(SRC, BLOCK, "passes", "cut"), blocks).filter(F.col(COPIES) > 0)
    copies = taken.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(COPIES).cast("long") - 1)))
    out = copies.join(homes, [SRC, BLOCK, "__copy"]).withColumn(ORDER, F.xxhash64(F.lit(seed + 1), KEY, "__copy"))
    return out.repartitionById(shards, F.col(SHARD).cast("int")).sortWithinPartitions(SHARD, ORDER), plan, blocks


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = 0) -> DataFrame:
    """The mixed rows of `docs` (needs doc_id, text, source; other columns are carried), in shuffled shards.

    Adds `__shard`: 0 to shards - 1 (a power of two; by default one shard for about `SHARD_WORDS` words). A document drawn twice
    comes twice, in different shards as a rule. Each shard is one partition, locally shuffled. Empty texts have no words, add nothing
    to a quota, and are drawn with their block. Columns named like the reserved ones (`__...`) are refused.
    """
    reserved = {SRC, BLOCK, KEY, SIZE, COPIES, SHARD, ORDER, ROW, "__copy"} & set(docs.columns)
    if reserved:
        raise ValueError(f"reserved column names: {sorted(reserved)}")
    dealt, _, _ = deal(keyed(docs, seed), slim(docs, seed), weights, share, most, shards, seed)
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns], SHARD)


def mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target, taken: its words in the mix, summed over the rows that the shards hold.

    Null texts count no words; a null source is a source of its own; rows alike are drawn alike; an empty table
    gives no rows.
    """
    sized = slim(docs, seed)
    dealt, plan, blocks = deal(sized, sized, weights, share, most, None, seed)
    taken = dealt.groupBy(ROW).agg(F.sum(SIZE).alias("taken"))
    goals = plan.select(SRC, BLOCK, "source_size", "target")  # by block, so that no source is a hot key
    found = sized.withColumn(BLOCK, F.pmod(F.col(KEY), F.lit(blocks))).join(goals, [SRC, BLOCK]).join(taken, ROW, "left")
    return found.select("doc_id", F.col(SIZE).alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
