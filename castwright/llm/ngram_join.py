"""N-gram Jaccard join by universe partitions: pigeonhole over hashed segments, exact verification, components.

Sets. A text's words (A-Z lowered, ASCII white space) give 4-word shingles, hashed to 64 bits. Texts with one set form
a class, known by a 64-bit hash of the set; all further work is on classes.

Segments. Linked sets differ in at most H shingles, H from the larger sizes of their size band. Bands grow by 1 / threshold, so
linked sets lie in one band or in neighbours; each set is indexed for its own band and as the larger partner for the
band below. The hashed universe is cut into m = H + 1 + spare segments (spare grows with H); a pair with at most H differences
agrees exactly in at least 1 + spare segments. Allocation by cost: a segment empty in a set is the costliest (it agrees with every
other empty one), so a set skips its empty segments as long as they are at most spare, which leaves one agreement at
least; sets with more of them index those too. So no linked pair is lost. For the same reason linked sets share at
least 1 + spare - (fewest empty segments of the two) signatures, and sets or pairs that share fewer are dropped unseen.

Candidates. Signatures are cut into slices, grouped inside each task first (a signature held by a third of all sets costs
one entry a task), then across tasks. Members of a signature point to its head, the member that shares most signatures with
others: of copies that were changed one by one it is the least changed. Each set is first verified
against the head that shares most signatures. After components, only signatures that still hold several components matter.
Their members meet with parity sketches, which bound the differences of two sets from below, and only pairs across components that
the sketches allow become rows (`nearby`): in a group of thousands of changed copies these are few. Each set is first verified against the
nearest one of another component; a set that the sketches bring near none has no link left to find and leaves (`unsettled`), however many
members its signatures have. Of the others, all such pairs of signatures with up to `LIGHT` members are verified. Sets of larger ones are indexed
again by segments twice as large with one-deletion neighbourhoods (m = ceil((H + 1) / 2), a linked pair differs by at most one shingle
in some segment), and compared in the same way. The comparing of two sketches is quadratic in the members of a signature; memory and rows are not.

Verification compares the sketches, so that only pairs close to the threshold move their sets, then the full shingle sets of both classes.
Links inside one component are not enumerated further.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.llm.common import checked, land, maybe_in, prefiltered, scratch, text_bytes
from castwright.llm.graph import components, merged
from castwright.llm.words import in_chunks, mixed, pieces, word_hashes

WORDS, PERCENT, SPARE, LIGHT, FLUSH, SEEN = 4, 85, 3, 48, 3_000_000, 500_000
# Of a cell of `nearby`: members of one signature, members, shingles of their sets (two to four bits of sketch each); pairs, or words of sketches, held at a time.
GRID, CELL, SHARE, PAIRS, NONE = 8192, 1 << 18, 1 << 27, 1 << 21, np.iinfo(np.int64).max
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, a text without words none."""
    return shingle_sets([text], words)[0]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The shingles of each text. All words of the texts are hashed as one row; a shingle sums its words' hashes by place."""
    hashes, starts, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for part in pieces(b" ".join(texts).lower()):
        found, at = word_hashes(part)
        hashes.append(found)
        starts.append(at + base)
        base += len(part)
    h = np.concatenate(hashes)
    firsts = np.searchsorted(np.concatenate(starts), np.cumsum([0] + [len(text) + 1 for text in texts])).tolist()
    places = mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for i in range(words):
        total += h[i : i + len(total)] * places[i]
    total = mixed(total + np.uint64(words))
    out = []
    for start, end in zip(firsts, firsts[1:]):
        n = end - start
        if n >= words:
            found = np.sort(total[start : end - words + 1])
            new = found[1:] != found[:-1]
            out.append(found if new.all() else found[np.concatenate([[True], new])])
        else:
            out.append(mixed((h[start:end] * places[:n]).sum(keepdims=True) + np.uint64(n)) if n else h[:0])
    return out


def class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit name of the set; never 0, which stands for the empty set."""
    if not len(tokens):
        return 0
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh3_64_intdigest(tokens.tobytes()) or 1))[0]


@cache
def bands(percent: int = PERCENT, most: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band."""
    lows = [1]
    while lows[-1] < most:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * 100 // percent)))
    return np.array(lows, np.int64)


def differences(band: int, percent: int = PERCENT) -> int:
    """H: the most differing shingles of a linked pair whose smaller set lies in the band."""
    small = int(bands(percent)[band + 1]) - 1
    return (100 - percent) * (small + small * 100 // percent) // (100 + percent)


def signatures(tokens: np.ndarray, percent: int = PERCENT, deletions: bool = False) -> tuple[np.ndarray, int]:
    """All signatures of a set: for its own band, and for the band below as the larger partner; and how many a linked set shares at least."""
    own = int(np.searchsorted(bands(percent), len(tokens), "right")) - 1
    out, least = [], 1 << 40
    spread = mixed(tokens ^ _FACTORS[1])
    for band in (own, own - 1):
        h = differences(band, percent) if band >= 0 else 0
        if not h:  # such sets would have to be equal, and equal sets are one class
            continue
        spare = SPARE + h // 40  # of about 250 segments one is empty by chance
        m = (h + 2) // 2 if deletions else h + 1 + spare
        turn = mixed(np.array([band + 1], np.uint64)) | np.uint64(1)
        segment = ((tokens * turn >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, segment, spread)
        salt = mixed(np.arange(m, dtype=np.uint64) + np.uint64(band << 32 | deletions << 62))
        if deletions:
            out += [mixed(sums + salt), mixed(sums[segment] - spread + salt[segment])]
            continue
        empty = np.bincount(segment, minlength=m) == 0
        count = int(empty.sum())
        least = min(least, 1 + spare - min(count, spare))
        out.append(mixed(sums + salt)[~empty if count <= spare else slice(None)])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), least


_RECORD = np.dtype([("sig", "<u4"), ("cls", "<i8")])
_MEMBER = np.dtype([("sig", "<i8"), ("cls", "<i8")])
_DOC = np.dtype([("doc_id", "<i8"), ("known", "?"), ("n", "<i8"), ("cls", "<i8"), ("tid", "<i8"), ("least", "<i8")])
_ARROW = pa.schema([("slice", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])
_PACKED = "slice int, kind byte, data binary"


class Gather:
    """Signatures of a task, packed by slice.

    A signature met twice in the task gives its members here, which travel to any slice; one record of each
    signature goes to the slice of the signature.
    """

    def __init__(self, slices: int) -> None:
        self.slices, self.sigs, self.classes, self.size, self.turn = slices, [], [], 0, 0

    def add(self, sigs: np.ndarray, cls: int) -> None:
        self.sigs.append(sigs)
        self.classes.append(np.full(len(sigs), cls, np.int64))
        self.size += len(sigs)

    def aside(self, kind: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows that need no meeting: 64 Ki at a time to one slice after the other."""
        for i in range(0, len(rows), 1 << 16):
            self.turn += 1
            part = rows[i : i + (1 << 16)]
            home = (self.turn + int(part[0]["cls"])) % self.slices
            yield pa.RecordBatch.from_pydict({"slice": [home], "kind": [kind], "data": [part.tobytes()]}, schema=_ARROW)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        sigs, classes = np.concatenate(self.sigs), np.concatenate(self.classes)
        self.sigs, self.classes, self.size = [], [], 0
        home, short = (sigs >> np.uint64(32)).astype(np.int64) % self.slices, (sigs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(home << 32 | short)
        home, short, classes = home[order], short[order], classes[order]
        first = np.concatenate([[True], (home[1:] != home[:-1]) | (short[1:] != short[:-1])])
        again = ~first | np.concatenate([~first[1:], [False]])
        twice = np.empty(int(again.sum()), _MEMBER)
        twice["sig"], twice["cls"] = home[again] << 32 | short[again], classes[again]
        yield from self.aside(1, twice)
        home, short, classes = home[first], short[first], classes[first]
        edges = np.searchsorted(home, np.arange(self.slices + 1))
        rows = np.empty(len(home), _RECORD)
        rows["sig"], rows["cls"] = short, classes
        used = [i for i in range(self.slices) if edges[i] < edges[i + 1]]
        yield pa.RecordBatch.from_pydict({"slice": used, "kind": [0] * len(used), "data": [rows[edges[i] : edges[i + 1]].tobytes() for i in used]}, schema=_ARROW)


def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one slice: members (sig, cls) of repeated signatures, and the rows that travelled aside."""
    parts = {k: [np.frombuffer(x, t) for x in rows["data"][rows["kind"] == k]] for k, t in ((0, _RECORD), (1, _MEMBER), (2, _DOC))}
    found = np.concatenate([np.zeros(0, _RECORD), *parts[0]])
    found = found[np.argsort(found["sig"].astype(np.int64))]
    same = found["sig"][1:] == found["sig"][:-1]
    again = (np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(found) else np.zeros(0, bool)
    twice, docs = np.concatenate([np.zeros(0, _MEMBER), *parts[1]]), np.concatenate([np.zeros(0, _DOC), *parts[2]])
    sig = np.concatenate([np.int64(key[0]) << 32 | found["sig"][again].astype(np.int64), twice["sig"]])
    out = {c: pd.array(np.concatenate([np.zeros(len(sig), np.int64), docs[c]]), "Int64") for c in ("doc_id", "n", "tid", "least")}
    for c in ("n", "tid", "least"):
        out[c][: len(sig)] = pd.NA
    out["doc_id"][np.concatenate([np.ones(len(sig), bool), ~docs["known"]])] = pd.NA
    whole = pd.array(np.concatenate([sig, np.zeros(len(docs), np.int64)]), "Int64")
    whole[len(sig) :] = pd.NA
    return pd.DataFrame({"sig": whole, "cls": np.concatenate([found["cls"][again], twice["cls"], docs["cls"]]), **out})


def met(packed: DataFrame) -> DataFrame:
    """The landed output of all slices: rows of members (sig not null) and of documents (n not null)."""
    return land(packed.groupBy("slice").applyInPandas(meet, "sig long, cls long, doc_id long, n long, tid long, least long"))


def members(gathered: DataFrame) -> DataFrame:
    """Distinct sig, cls of every signature that at least two classes hold."""
    rows = gathered.where("sig is not null").select("sig", "cls")
    shared = rows.groupBy("sig").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("sig")
    return land(rows.join(shared, "sig").distinct())


def pruned(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """Entries of the classes that share as many signatures as a linked one must."""
    enough = entries.groupBy("cls").agg(F.count(F.lit(1)).alias("shared")).join(facts, "cls").where("shared >= least").select("cls")
    return members(entries.join(enough, "cls", "left_semi"))


def pointers(entries: DataFrame) -> DataFrame:
    """For each class the pair (a, b) with the signature head a that it shares most signatures with, if several."""
    size = entries.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
    heads = entries.join(size, "cls").groupBy("sig").agg(F.min(F.struct(-F.col("size"), "cls"))["cls"].alias("a"))
    shared = entries.join(heads, "sig").where("cls <> a").groupBy("a", F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    return shared.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")


def nearby(members: DataFrame, facts: DataFrame, sets: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Landed pairs (a, b) of members (sig, cls, root, members) of one signature that lie in different components and may be linked by their sketches.

    With `nearest` each class gives only the pair with the fewest differences. Signatures are dealt to cells of bounded size, with the
    sketches of their members, and compared there, so no row is made for a pair that the sketches rule out. A signature of more than `GRID`
    members is cut into blocks and each two blocks meet in a cell.
    """
    held = members.groupBy("cls").agg(F.count(F.lit(1)).alias("e")).join(facts, "cls").agg(F.sum("e"), F.sum(F.col("e") * F.col("n"))).first()
    cells = max(8, (held[0] or 0) // CELL, (held[1] or 0) // SHARE)  # by members, so that a class comes to few cells
    blocks = F.ceil(F.col("members") / GRID)
    dealt = members.withColumn("side", F.pmod(F.xxhash64("cls", "sig"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    whole = F.pmod(F.xxhash64("sig"), F.lit(cells).cast("long"))
    part = F.xxhash64("sig", F.least("side", "other"), F.greatest("side", "other"))
    dealt = dealt.select(F.when(F.col("members") <= GRID, whole).otherwise(part).alias("cell"), "sig", "cls", "root", "side")
    known = dealt.select(F.col("cell").alias("at"), F.col("cls").alias("name")).distinct().join(sets.select(F.col("cls").alias("name"), "n", "sketch"), "name")

    def compare(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.drop_duplicates("name").sort_values("name")
        near = Sketches(known["n"].to_numpy(np.int64), known["sketch"].tolist())
        names, best, found = known["name"].to_numpy(np.int64), np.full(len(known), NONE), [np.zeros(0, np.int64)]
        rows = rows.sort_values(["sig", "cls"])
        place, n = np.searchsorted(names, rows["cls"].to_numpy(np.int64)), len(names)
        for i, j in joined(rows["sig"].to_numpy(np.int64), rows["side"].to_numpy(np.int64), rows["root"].to_numpy(np.int64)):
            i, j = np.divmod(np.unique(np.minimum(place[i], place[j]) * n + np.maximum(place[i], place[j])), n)
            i, j, apart = near.close(i, j, percent)
            if nearest:
                np.minimum.at(best, i, apart * n + j)
                np.minimum.at(best, j, apart * n + i)
            else:
                found = [np.unique(np.concatenate([*found, i * n + j]))]
        if nearest:
            i = np.flatnonzero(best < NONE)
            return pd.DataFrame({"a": names[i], "b": names[best[i] % n], "apart": best[i] // n})
        i, j = np.divmod(found[0], max(n, 1))
        return pd.DataFrame({"a": names[i], "b": names[j], "apart": 0})

    pairs = dealt.groupBy("cell").cogroup(known.groupBy("at")).applyInPandas(compare, "a long, b long, apart long")
    if nearest:
        pairs = pairs.groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("b"))
    return land(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def joined(sigs: np.ndarray, sides: np.ndarray, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all two rows of a signature with different roots, about `PAIRS` at a time; rows are in order of `sigs`.

    Where a signature has rows of two sides, those of one side meet only the other.
    """
    if not len(sigs):
        return
    first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    size = np.diff(np.append(first, len(sigs)))
    after = np.repeat(first + size, size) - np.arange(len(sigs)) - 1
    mixed_sides = np.repeat(np.minimum.reduceat(sides, first) != np.maximum.reduceat(sides, first), size)
    ends = np.cumsum(after)
    low = 0
    while low < len(sigs):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        n = after[low:high]
        i = np.repeat(np.arange(low, high), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        own = (roots[i] != roots[j]) & (~mixed_sides[i] | (sides[i] != sides[j]))
        if own.any():
            yield i[own], j[own]
        low = high


class Sketches:
    """The sketches of some sets, as a matrix for each length."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes]) -> None:
        self.sizes, self.length = sizes, np.array([len(x) // 8 for x in sketches], np.int64)
        self.place, self.rows = np.zeros(len(sketches), np.int64), {}
        for length in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == length)
            self.place[own] = np.arange(len(own))
            self.rows[length, length] = np.frombuffer(b"".join([sketches[x] for x in own]), "<u8").reshape(-1, length)

    def folded(self, length: int, to: int) -> np.ndarray:
        if (length, to) not in self.rows:
            self.rows[length, to] = np.bitwise_xor.reduce(self.rows[length, length].reshape(-1, length // to, to), axis=1)
        return self.rows[length, to]

    def close(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs (i, j) those whose sizes and sketches allow a link, and in how many tokens they differ at least (see `fewest_differences`)."""
        a, b = self.sizes[i], self.sizes[j]
        fit = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        i, j, most = i[fit], j[fit], (a + b)[fit] * (100 - percent)
        apart = np.zeros(len(i), np.int64)
        kinds = self.length[i] << 32 | self.length[j]
        for kind in np.unique(kinds).tolist():
            left, right = kind >> 32, kind & 0xFFFFFFFF
            short = min(left, right)
            x, y = self.folded(left, short), self.folded(right, short)
            own = np.flatnonzero(kinds == kind)
            for part in np.array_split(own, len(own) * short // PAIRS + 1):
                apart[part] = np.bitwise_count(x[self.place[i[part]]] ^ y[self.place[j[part]]]).sum(1)
        near = apart * (100 + percent) <= most
        return i[near], j[near], apart[near]


def possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, maybe shared) whose sizes allow a link, and that share enough signatures."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(facts.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("least").alias(f"least{side}")), side)
    sized = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return (sized.where("shared >= greatest(leasta, leastb)") if "shared" in pairs.columns else sized).select("a", "b")


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each of 2 to 4 buckets a token (a power of two, by low bits), a bit each: about 1/25 of the set."""
    buckets = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fewest_differences(a: bytes, b: bytes) -> int:
    """Two sets differ in at least as many tokens as their sketches do in parities; a longer sketch is folded."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    short = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, short), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def hopeful(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow a link: linked sets of S tokens in all differ in at most S * (100 - percent) / (100 + percent)."""

    def allowed(left: pd.Series, right: pd.Series, total: pd.Series) -> pd.Series:
        found = zip(left, right, total, strict=True)
        return pd.Series([fewest_differences(x, y) * (100 + percent) <= n * (100 - percent) for x, y, n in found], dtype=bool)

    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    kept = pairs.where(F.pandas_udf(allowed, "boolean")("sa", "sb", F.col("na") + F.col("nb")))
    return land(kept.select("a", "b").distinct())


def members_of(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """The sets that may be the pairs' a or b, so that a join moves no others; an exact join must follow."""
    return prefiltered(sets, maybe_in(pairs.select(F.col(side).alias("cls")), "cls"), "cls")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, sketched: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: by sketches, unless `sketched` pairs passed them, which lose no such pair, then by their full sets."""
    if not sketched:
        pairs = hopeful(pairs, sets, percent)

    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    right, heads = (members_of(pairs, sets, side).select(F.col("cls").alias(side), F.col("tokens").alias(f"t{side}")) for side in ("b", "a"))
    return land(pairs.join(right, "b").join(heads, "a").where(F.pandas_udf(linked, "boolean")("ta", "tb")).select("a", "b").distinct())


def with_roots(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the signatures that still hold several components, with their component."""
    placed = entries.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    open_sigs = placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high")
    return land(placed.join(open_sigs.select("sig", "members"), "sig"))


def unsettled(placed: DataFrame, near: DataFrame) -> DataFrame:
    """Members of the classes of `near`, the nearest pairs across components that sketches allow: a class without one has no link left to find."""
    left = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    return placed.select("sig", "cls").join(left, "cls", "left_semi")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, cls (class of the set, 0 if empty), component_id, tid (hash of the text), root (smallest class).

    component_id is the smallest doc_id reachable by links, for a text without words its own. Null texts are empty.
    Null ids take part but name no component unless all ids of a component are null. Rows alike come out alike.
    """
    rows = checked(docs, "doc_id", "text").withColumn("tid", F.xxhash64("text"))
    slices = max(8, 2 * rows.rdd.getNumPartitions())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather, seen = Gather(slices), set()
        for batch in batches:
            docs = np.zeros(batch.num_rows, _DOC)
            docs["doc_id"], docs["known"] = batch["doc_id"].fill_null(0), batch["doc_id"].is_valid()
            docs["tid"] = batch["tid"]
            sets = (tokens for part in in_chunks(text_bytes(batch["text"])) for tokens in shingle_sets(part, words))
            for i, tokens in enumerate(sets):
                docs["n"][i], docs["cls"][i] = len(tokens), (cls := class_of(tokens))
                if cls and cls not in seen:
                    if len(seen) < SEEN:
                        seen.add(cls)
                    sigs, docs["least"][i] = signatures(tokens, percent)
                    gather.add(sigs, cls)
                    if gather.size >= FLUSH:
                        yield from gather.flush()
            yield from gather.aside(2, docs)
        yield from gather.flush()

    gathered = met(rows.mapInArrow(index, _PACKED))
    slim = gathered.where("n is not null").select("doc_id", "n", "cls", "tid")
    facts = land(gathered.where("n is not null and cls <> 0").groupBy("cls").agg(F.max("n").alias("n"), F.max("least").alias("least"), F.min("tid").alias("tid")))
    entries = pruned(members(gathered), facts)
    pairs = land(possible(pointers(entries), facts, percent))
    # Sets of every class that shares a signature with another, from one text each.
    wanted = land(facts.join(entries.select("cls").distinct(), "cls", "left_semi").select("tid"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for tid, text in zip(batch["tid"].to_pylist(), text_bytes(batch["text"]), strict=True):
                if tid not in seen:  # copies of a text stand together
                    if len(seen) < SEEN:
                        seen.add(tid)
                    fresh.append(text)
            found = [tokens for part in in_chunks(fresh) for tokens in shingle_sets(part, words)]
            yield pa.RecordBatch.from_pydict({"cls": pa.array([class_of(x) for x in found], pa.int64()), "n": pa.array([len(x) for x in found], pa.int64()), "tokens": pa.array([x.tobytes() for x in found], pa.binary()), "sketch": pa.array([sketch(x) for x in found], pa.binary())})

    texts = prefiltered(rows.select("tid", "text"), maybe_in(wanted, "tid"), "tid").join(wanted, "tid", "left_semi")
    sets = land(texts.mapInArrow(rebuild, "cls long, n long, tokens binary, sketch binary"))  # a class may come twice, from parts of a split partition

    roots = components(verified(pairs, sets, percent))
    placed = with_roots(entries, roots)
    near = nearby(placed, facts, sets, percent, nearest=True)
    roots = merged(roots, verified(near, sets, percent, True))
    placed = with_roots(unsettled(placed, near), roots)
    # A pair that shares heavy signatures only is found below.
    light = nearby(placed.where(F.col("members") <= LIGHT), facts, sets, percent).join(pairs, ["a", "b"], "left_anti")
    roots = merged(roots, verified(land(light), sets, percent, True))
    heavy = with_roots(placed.where(F.col("members") > LIGHT).select("sig", "cls"), roots).select("cls").distinct()

    def deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(slices)
        for batch in batches:
            for cls, tokens in zip(batch["cls"].to_pylist(), batch["tokens"], strict=True):
                gather.add(signatures(np.frombuffer(tokens.as_py(), np.uint64), percent, deletions=True)[0], cls)
                if gather.size >= FLUSH:
                    yield from gather.flush()
        yield from gather.flush()

    if not heavy.isEmpty():
        again = members(met(sets.join(heavy, "cls", "left_semi").select("cls", "tokens").mapInArrow(deletions, _PACKED)))
        placed = with_roots(again, roots)
        near = nearby(placed, facts, sets, percent, nearest=True)
        roots = merged(roots, verified(near, sets, percent, True))
        placed = with_roots(unsettled(placed, near), roots)
        roots = merged(roots, verified(nearby(placed, facts, sets, percent), sets, percent, True))

    least = slim.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    grouped = least.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "root", "component_id")
    out = slim.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.when(F.col("cls") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "tid", "root")


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of `docs` that stay when one row of each component does: the one with the smallest id, then text hash.

    Rows without words are in no component and all stay. All columns are carried; their names may be any.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")
    with scratch(docs.sparkSession) as stay:
        found = near_duplicates(docs, percent, words).where("cls <> 0")
        keep = stay(found.groupBy("root").agg(F.min(order).alias("first")).select(_id(F.col("first.doc_id")).alias("id"), F.col("first.tid").alias("tid")))
    has_words = F.coalesce(F.col("`text`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(has_words).select(_id(F.col("`doc_id`")).alias("id"), F.xxhash64("`text`").alias("tid"), F.struct("*").alias("kept"))
    rows = prefiltered(rows, maybe_in(keep, "tid"), "tid")
    kept = rows.join(keep, ["id", "tid"], "left_semi").dropDuplicates(["id", "tid"])
    return kept.select("kept.*").unionByName(docs.where(~has_words))


def _id(key):  # noqa: ANN001, ANN202
    return F.coalesce(key.cast("string"), F.lit("null"))
