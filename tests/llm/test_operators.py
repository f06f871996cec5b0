"""Every operator against brute force, a round trip or held-out accuracy, on odd rows: nulls, empty and long texts, copies, clashing names."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from castwright.llm import decontaminate, hnsw, mixing, ngram_join, pii, quality, suffix_dedup, tokens, toxicity, wrapper
from castwright.llm.common import land, scratch
from castwright.llm.graph import components, merged
from castwright.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, score double, row string, cls string, best int, slice int"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


BASES = [prose(n) for n in (5, 12, 30, 60, 120, 200)]
TEXTS = [None, "", "   \n\t ", "one", "One TWO three", "é ü\nß", "x" * 5000, "ab " * 3000]
TEXTS += [b for b in BASES for _ in range(3)] + [changed(b, s) for b in BASES for s in (0.01, 0.02, 0.04, 0.1)]
TEXTS += [prose(40) + " " + BASES[3] + " " + prose(40) for _ in range(6)] + [prose(rng.randint(1, 80)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 20 else i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0, 1, 0.5, "r", "c", 1, 2) for i, t in enumerate(TEXTS)]
    rows += [rows[9], rows[9]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join(docs, none):
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set() for _, w in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    want = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        want.append((key, len(sets[i]), key if not sets[i] else min(ids, default=None)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ngram_join.near_duplicates(none).count() == 0


def test_ngram_heavy_signatures(spark, monkeypatch):
    """Signatures of many unlinked sets go through one-deletion neighbourhoods."""
    monkeypatch.setattr(ngram_join, "LIGHT", 2)
    monkeypatch.setattr(ngram_join, "SPARE", 1)
    shared = prose(60)
    texts = [shared + " " + prose(40) for _ in range(25)]
    texts += [changed(t, 0.01) for t in texts[:8]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(ngram_join.shingles(t.encode()).tolist()) for t in texts]
    links = {(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame).collect()}
    assert all(got[i] == got[j] for i, j in links)
    assert len(set(got.values())) == len(texts) - len(links)  # here every link joins two documents


def test_ngram_group_of_changed_copies(spark, monkeypatch):
    """A large group of copies around the threshold, changed by words of their own or by a few shared alternatives: brute force, without all pairs."""
    draw, base = random.Random(11), prose(120).split(" ")
    texts = []
    for i in range(500):
        words = list(base)
        for place in draw.sample(range(120), draw.randint(0, 9)):
            words[place] = f"own{i}x{place}"
        texts.append(" ".join(words))
    for _ in range(150):
        texts.append(" ".join(w + draw.choice(["", "a"]) if place % 12 == 5 else w for place, w in enumerate(base)))
    sets = [set(ngram_join.shingles(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    asked, verified = [], ngram_join.verified

    def counting(pairs, *more):
        asked.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(ngram_join, "verified", counting)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame).collect()}
    assert got == {i: top(i) for i in range(len(texts))}
    assert 1 < len(set(got.values())) < len(texts)
    assert sum(asked) < 40 * len(texts)  # all pairs are 325 times the texts


def test_sets_near_no_other_are_not_indexed_again(spark, monkeypatch):
    """Members of heavy signatures that no sketch brings near another component leave; those that it does are still linked."""
    monkeypatch.setattr(ngram_join, "LIGHT", 2)
    monkeypatch.setattr(ngram_join, "SPARE", 1)
    draw, indexed, met = random.Random(5), [], ngram_join.met
    some = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    shared = some(60)
    apart = [shared + " " + some(40) for _ in range(25)]

    def counting(packed):
        indexed.append(1)
        return met(packed)

    monkeypatch.setattr(ngram_join, "met", counting)
    frame = spark.createDataFrame(list(enumerate(apart)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame).collect()} == {i: i for i in range(25)}
    assert len(indexed) == 1


def test_components_merged_by_roots(spark):
    first = [(2, 1), (3, 2), (6, 5), (9, 8)]
    roots = components(spark.createDataFrame(first, "a long, b long"))
    for more in ([], [(3, 1)], [(3, 6), (7, 9), (11, 10)], [(12, 3), (12, 5), (4, 12), (10, 9)]):
        found = merged(roots, spark.createDataFrame(more, "a long, b long"))
        want = components(spark.createDataFrame(first + more, "a long, b long"))
        assert sorted(map(tuple, found.select("node", "root").collect())) == sorted(map(tuple, want.collect()))


def test_near_members_of_a_signature(spark, monkeypatch):
    """Members of large signatures meet in blocks; only pairs that the sketches allow become rows: those of brute force."""
    monkeypatch.setattr(ngram_join, "GRID", 7)
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    base, draw = prose(150).split(" "), random.Random(7)
    texts = [" ".join(f"own{i}x{place}" if place in (draws := draw.sample(range(150), 4 if i % 9 else 0)) else w for place, w in enumerate(base)) for i in range(60)]
    texts += [t + " " + prose(3) for t in texts[:5]] + [prose(40) for _ in range(5)]
    sets = [ngram_join.shingles(t.encode()) for t in texts]
    sketches = [ngram_join.sketch(x) for x in sets]
    facts = spark.createDataFrame([(i, len(x)) for i, x in enumerate(sets)], "cls long, n long")
    known = spark.createDataFrame([(i, len(x), bytearray(y)) for i, (x, y) in enumerate(zip(sets, sketches)) for _ in range(1 + i % 2)], "cls long, n long, sketch binary")
    held = {1: list(range(len(texts))), 2: [0, 61], 3: [3, 4, 62]}
    members = spark.createDataFrame([(sig, i, i // 2, len(own)) for sig, own in held.items() for i in own], "sig long, cls long, root long, members long")
    apart = {}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            a, b, d = len(sets[i]), len(sets[j]), ngram_join.fewest_differences(sketches[i], sketches[j])
            if i // 2 != j // 2 and d * 185 <= (a + b) * 15 and 100 * min(a, b) >= 85 * max(a, b):
                apart[i, j] = d
    got = [tuple(r) for r in ngram_join.nearby(members, facts, known, 85).collect()]
    assert sorted(got) == sorted(apart) and 0 < len(apart) < len(texts) ** 2 / 4
    nearest = [tuple(r) for r in ngram_join.nearby(members, facts, known, 85, nearest=True).collect()]
    assert len(nearest) <= len(texts) and set(nearest) <= set(apart)
    for i in {x for pair in apart for x in pair}:
        assert min(d for pair, d in apart.items() if i in pair) in [apart[pair] for pair in nearest if i in pair]


def test_sketches_never_exceed_the_differences():
    rng = np.random.default_rng(3)
    for size in (1, 2, 31, 32, 33, 500, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for change in (0, 1, size // 10, size):
            b = np.unique(np.concatenate([a[change:], rng.integers(0, 1 << 63, max(2 * change, not len(a[change:]))).astype(np.uint64)]))
            least = ngram_join.fewest_differences(ngram_join.sketch(a), ngram_join.sketch(b))
            assert least <= len(np.setxor1d(a, b))
            assert change < size // 2 or size < 31 or least > size // 4  # sets without a common token are told apart


def test_one_of_each(docs):
    kept = ngram_join.one_of_each(docs, percent=85, words=4)
    components = {(r.doc_id, r.root) for r in ngram_join.near_duplicates(docs).where("cls <> 0").collect()}
    assert kept.where("trim(text) <> ''").where(r"text rlike '[^\\x20\\x09-\\x0D]'").count() == len({c for _, c in components})
    assert kept.columns == docs.columns


def test_stages_drop_their_own_tables(spark, docs):
    """What a stage of the pipeline lands on its way goes with it; only the rows to leave out stay."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    with scratch(spark) as stay:
        inner = land(docs)
        kept = stay(inner.groupBy("source").count())
        assert len(set(folder.iterdir()) - before) == 2
    assert kept.count() == 4 and len(set(folder.iterdir()) - before) == 1
    items = spark.createDataFrame([(1, BASES[3])], "item_id long, text string")
    clean = decontaminate.without_leaks(docs, items)
    assert clean.count() < docs.count() and len(set(folder.iterdir()) - before) == 2


def test_sets_that_are_in_no_pair_are_not_moved(spark):
    sets = spark.range(2000).select(F.col("id").alias("cls"), F.lit(1).alias("n"))
    pairs = spark.createDataFrame([(3, 5), (7, 5), (9, 1999)], "a long, b long")
    for side, want in (("a", {3, 7, 9}), ("b", {5, 1999})):
        found = {r.cls for r in ngram_join.members_of(pairs, sets, side).collect()}
        assert found >= want and len(found) < 20


def test_suffix_dedup(docs, none, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    length, rows = 60, docs.collect()
    data = [(r.text or "").encode() for r in rows]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    want = []
    for r, d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        want.append((r.doc_id, len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    found = suffix_dedup.dedup(docs, length=length, gram=16).collect()
    assert sorted([tuple(r)[:5] for r in found], key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    assert suffix_dedup.dedup(none).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    path = str(tmp_path / "ids")
    tokens.write_ids(docs, path, tokenizer_path(), 2)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = sorted([tuple(r) for r in tokens.read_ids(spark, path).collect()], key=lambda r: r[1])
    assert got == want
    tokens.write_ids(none, str(tmp_path / "none"), tokenizer_path(), 2)
    assert tokens.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_id_blocks_are_landed_small(docs):
    """Ids take two bytes each before they are coded; the blocks are the largest table of the stage, so they are landed with zstd."""
    blocks = tokens.tokenized(docs, tokenizer_path(), 2)
    assert blocks.inputFiles() and all(".zstd." in f for f in blocks.inputFiles())
    assert blocks.selectExpr("sum(size(doc_ids)) AS n").first().n == docs.count()


def test_coded_blocks_round_trip():
    g = np.random.default_rng(3)
    for symbols in (np.array([5]), np.array([0, 7, 40_000, 65_535]), np.arange(3000) * 7, np.array([1, 1 << 24, (1 << 32) - 1])):
        bits = tokens.code_lengths(g.integers(1, 1 << 20, len(symbols)) ** 3 // (1 << 30) + 1)
        codes, (table, width) = tokens.canonical(symbols, bits), tokens.look_up(symbols, bits)
        for n in (1, 127, 128, 129, 5000):
            picked = g.integers(0, len(symbols), n)
            words, at = tokens.pack(codes[picked], bits[picked])
            assert at.tolist() == (np.cumsum(bits[picked].astype(int)) - bits[picked]).tolist()
            assert tokens.unpack(words, at[:: tokens.LANE], n, table, width).tolist() == symbols[picked].tolist()


def test_code_lengths_are_bounded_and_complete():
    counts = np.array([2**i for i in range(40)])
    bits = tokens.code_lengths(counts, 8)
    assert bits.max() <= 8 and (2.0 ** -bits.astype(float)).sum() == 1.0
    free = tokens.code_lengths(np.array([5, 9, 12, 13, 16, 45]), 18)
    assert (free * np.array([5, 9, 12, 13, 16, 45])).sum() == 224  # the unlimited Huffman cost of these counts


def test_tokenizer_pieces_agree_with_the_library():
    pieces = tokens.Pieces(tokenizer_path(), "<u2")
    for text in ["", " ", "a  b", "a\n\nb", "it's  5 x.\nfoo!!! don't", "\x1c a\x85b", "été ñ's ##", "tab\there", "a\n b", "end ", "x.y, a1b2 %%%", "中文 字 ok"]:
        assert np.frombuffer(pieces.of(text), "<u2").tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_tokenizer_pieces_agree_on_white_space():
    pieces = tokens.Pieces(tokenizer_path(), "<u2")
    g = random.Random(11)
    spaces = [" ", " ", " ", "\n", "\n", "\u00a0", "\t", "\r", "\x1c", "\u180e", "\u2003", "\u3000"]
    mixes = ["".join(g.choice(spaces) if g.random() < 0.4 else g.choice(["a", "b", "it's", "x.", "\u00e9", "7"]) for _ in range(g.randint(1, 12))) for _ in range(20000)]
    for text in ["a\n\u00a0\u00a0b", "a\u00a0b\u00a0c\n\n", "a\n", "\na", " a", "a\u00a0", *mixes]:
        assert np.frombuffer(pieces.of(text), "<u2").tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_pii(spark, docs):
    noise = ["".join(rng.choice("a1@.+- 25(0)9é") for _ in range(300)) for _ in range(300)]
    noise += ["1.2.3.4.5.6.7.8", "a@b.c@d.e.f", "0001.2.3.255 256.1.1.1", "+1 (23) 4567-89012 4111111111111111", None, "9" * 3000, 'token = "186661156f3f9905942d70850a01cbf23a203f82"']
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def right(kind, match):
        digits = re.sub("[^0-9]", "", match)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    frame = spark.createDataFrame([(i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    for r in pii.find_pii(frame).collect():
        spans = sorted((m.start(), list(patterns).index(k), m.end()) for k, p in patterns.items() for m in re.finditer(p, noise[r.doc_id] or "") if right(k, m.group()))
        text = ",".join(f"{list(patterns)[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        if "token" in (noise[r.doc_id] or ""):
            assert "secret:9:49" in r.spans
    assert pii.find_pii(docs).count() == docs.count()


def test_mixing(docs, none):
    sizes = [(r.doc_id, r.source, len((r.text or "").split())) for r in docs.collect()]
    totals: dict = {}
    for _, source, size in sizes:
        totals[source] = totals.get(source, 0) + size
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, 1.5 * sum(totals.values())
    while True:  # share, cap, share again
        free = [s for s in order if s not in target]
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > 2 * totals[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
            break
        level = left / sum(weight[f] for f in free)
        target |= {s: 2.0 * totals[s] for s in over}
        left -= sum(2.0 * totals[s] for s in over)
        assert level
    got = mixing.mixture(docs).collect()
    taken: dict = {}
    source_of = {i: s for i, s, _ in sizes}
    for r in got:
        assert r.source_size == totals[source_of[r.doc_id]] and abs(r.target - target[source_of[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[source_of[r.doc_id]] = taken.get(source_of[r.doc_id], 0) + r.taken
    largest = max(s for *_, s in sizes)
    assert len(got) == len(sizes) and all(abs(taken[s] - target[s]) <= largest for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs.repartition(2)).collect()))
    mixed = mixing.mix(docs.withColumnRenamed("row", "words"), shards=4)
    assert mixed.groupBy("doc_id").count().where("doc_id is not null").count() > 0 and set(mixed.columns) >= {"n", "score", "__shard"}
    assert mixing.mixture(none).count() == 0 and mixing.mix(none).count() == 0


def test_taken_words_are_those_of_the_dealt_rows(docs):
    kept = [c for c in docs.columns if c != "row"]
    dealt = mixing.mix(docs.select(*kept)).withColumn("at", F.spark_partition_id())
    assert all(r.low == r.high for r in dealt.groupBy("__shard").agg(F.min("at").alias("low"), F.max("at").alias("high")).collect())
    assert dealt.select("at").distinct().count() == dealt.select("__shard").distinct().count()  # one shard, one partition
    words: dict = {}
    for r in dealt.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    planned: dict = {}
    for r in mixing.mixture(docs).collect():
        planned[r.doc_id] = planned.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in planned.items() if v} == {k: v for k, v in words.items() if v}


def test_shards_follow_the_size(spark):
    sized = spark.createDataFrame([(3 * mixing.SHARD_WORDS,)] * 16, "__size long")
    assert mixing.shape_of(sized, 1.0) == (4, 64) and mixing.shape_of(sized.limit(1), 1.0) == (1, 16) and mixing.shape_of(sized.limit(0), 1.5) == (1, 16)


def test_splitting_tree_is_exact(spark):
    blocks = spark.createDataFrame([("a", 100), ("b", 1), ("c", 37), (None, 12)], "source string, n long")
    tree = mixing.split_tree(blocks, 8).collect()
    assert {s: sum(r.n for r in tree if r.source == s) for s in ("a", "b", "c", None)} == {"a": 100, "b": 1, "c": 37, None: 12}
    per_shard = [sum(r.n for r in tree if r.shard == k) for k in range(8)]
    assert sum(per_shard) == 150 and max(per_shard) - min(per_shard) <= 1


def test_nearest(spark):
    g = np.random.default_rng(0)
    x = g.standard_normal((600, 16)).astype(np.float32)
    x[100:160] = x[100]  # a frequent vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in hnsw.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 600, 20):
        s = x.astype(float) @ x[q].astype(float)
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert [r for r, *_ in got[q]] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in got[q])
        hit += len({i for _, i, _ in got[q]} & set(want))
    assert hit / (30 * 20) >= 0.9 and set(got) == set(range(0, 600, 20))
    assert hnsw.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_main_text(spark):
    def page(i, host, body, tail="</body></html>"):
        return i, host, f"<html><head><title>t{i}</title><script>if(a<b){{}}</script></head><body><div class='top-menu'><a>Home</a></div><div><div><h2>Head &amp; {i}</h2>{body}<div id=comments><p>reader</p></div></div></div><footer>f{i % 2}</footer>{tail}"

    rows = [page(i, f"http://h{i % 2}.org/{i}", f"<p>One  {i}<p>Two\n{prose(30)} {i}<ul><li>a{i}<li>b{i}</ul>") for i in range(12)]
    rows += [(50, "http://one.org/", "<p>only <b>page"), (51, None, None), (52, "http://one.org/", ""), (53, "http://copy.org/1", rows[0][2]), (54, "http://copy.org/2", rows[0][2]), (55, "odd", "<!-- open")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, node int")
    got = {r.page_id: r for r in wrapper.main_text(frame).collect()}
    for i in range(12):
        blocks = got[i].text.split("\n\n")
        assert blocks[0] == f"Head & {i}" and blocks[1] == f"One {i}" and blocks[3:] == [f"a{i}", f"b{i}"] and "reader" not in got[i].text
        assert got[i].n_chars == len(got[i].text)
    assert got[50].text == "only page" and got[51].text == got[52].text == got[55].text == "" and got[53].text == got[54].text == got[0].text
    assert wrapper.main_text(frame.limit(0)).count() == 0


def test_tree_matching():
    def brute(a, b, x, y):
        if wrapper._key(a, x) != wrapper._key(b, y):
            return 0
        left, right = ([k for k in p.kids[n] if isinstance(k, int)] for p, n in ((a, x), (b, y)))
        best = np.zeros((len(left) + 1, len(right) + 1), int)
        for i, u in enumerate(left):
            for j, v in enumerate(right):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + brute(a, b, u, v))
        return 1 + best[-1, -1]

    g = random.Random(4)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in g.choices(["div", "section", "b", "p", "i"], k=g.randint(0, 4))) if depth else "x"

    for _ in range(300):
        a, b = wrapper.Page(tree(3)), wrapper.Page(tree(3))
        m = wrapper.Matching(a, b)
        assert m.score(m.classes[0][0], m.classes[1][0]) == brute(a, b, 0, 0)
    paragraphs = lambda n: "".join(f"<p>text {i}</p>" for i in range(n))
    article = "<div><h2>a</h2><h3>b</h3><h4>c</h4></div><div>{}</div>"
    a, b = wrapper.Page(article.format(paragraphs(20))), wrapper.Page("<div>" + "<a>link</a>" * 25 + "</div>" + article.format(paragraphs(5)))
    found = wrapper.match(a, b)
    tops = lambda p: [k for k in p.kids[0] if isinstance(k, int)]
    assert [found[n] for n in tops(a)] == [[n] for n in tops(b)[1:]]
    deep = wrapper.Page("<div>" * 5000 + "end")
    assert len(wrapper.match(deep, wrapper.Page("<div>" * 4000 + "end"))) == 4001


@pytest.mark.parametrize("odd", ["<a '", "<!a", "<?", "<a \"'", "<a <b", "<a 'x>", "</a \"", "<a'"])
def test_broken_quotes_take_linear_time(odd):
    page = wrapper.Page("<p>kept &amp; whole</p>" + odd * 250_000)  # hours, were the rest of the page read again from every tag
    assert page.blocks(0)[0] == "kept & whole"
    later = wrapper.Page("<p>one</p><p title='>two</p><div>three</div>")
    assert later.blocks(0) == ["one", "two", "three"]  # the quote never ends, so it means nothing
    assert wrapper.Page("<p title='a>b'>one</p>\u2003<i title=\"'\">two\u00a0\n three</i>").blocks(0) == ["one", "two three"]


def test_main_text_stays_whole(spark):
    def page(body):
        return f"<html><body><div class=top-menu><a>Home</a></div><div class='sidebar'>links</div>{body}<footer>f</footer></body></html>"

    body = lambda i: f"<h2>Head {i}</h2><p>one {prose(20)} {i}</p><p>two {prose(20)} {i}</p>"
    wraps = {
        "named": "<div class='content has-sidebar'>{}</div>",
        "form": "<form>{}</form>",
        "parts": "<div><div class='elementor-widget-container'>{}</div><div class='elementor-widget-container'>{}</div></div>",
        "one": "<div class='content has-sidebar'>{}</div>",
    }
    rows, want = [], {}
    for host, wrap in wraps.items():
        for i in range(1 if host == "one" else 12):
            text = wrap.format(body(i), body(i))
            want[len(rows)] = re.findall(r"<(?:h2|p)>([^<]*)", text)
            rows.append((len(rows), f"http://{host}.org/{i}", page(text)))
    # One article in many copies, with a quotation that no other page has.
    quoted = body(0) + "<blockquote><p>said once</p></blockquote>"
    for i in range(30):
        text = quoted if i < 20 else body(i)
        want[len(rows)] = re.findall(r"<(?:h2|p)>([^<]*)", text)
        rows.append((len(rows), f"http://copies.org/{i}", page(f"<div>{text}</div>")))
    # Copies that differ in their furniture only.
    for i in range(8):
        want[len(rows)] = ["all the same text of one article"]
        rows.append((len(rows), f"http://ads.org/{i}", page(f"<div><p>all the same text of one article</p><div class=ad>a{i}</div></div>")))
    # Two layouts on one host, each with its own place of the text.
    for i in range(24):
        text = body(i) if i % 2 else f"<p>{prose(20)} {i}</p><p>b {i}</p>"
        want[len(rows)] = re.findall(r"<(?:h2|p)>([^<]*)", text)
        both = f"<div><section>{text}</section><section><p>all rights</p></section></div>" if i % 2 else f"<div><div><p>{'shop ' * 30}</p></div><div>{text}</div></div>"
        rows.append((len(rows), f"http://two.org/{i}", page(both)))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in wrapper.main_text(frame).collect()}
    for i, blocks in want.items():
        assert got[i] == blocks, (rows[i][1], got[i], blocks)


def test_decontamination(spark, none):
    items = [prose(40), prose(30), prose(70), prose(6), None, ""]
    texts = [prose(200) for _ in range(40)]
    texts[3] = prose(50) + " " + items[0].upper() + ". " + prose(60)
    texts[5] = items[1]
    texts[7] = prose(33) + "\n" + changed(items[2], 0.08) + " " + prose(10)
    texts[9] = prose(20) + " " + items[3] + " " + prose(20)
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, benchmark).collect()}
    assert got == {(3, 0), (5, 1), (7, 2), (9, 3)}
    assert {r.doc_id for r in decontaminate.without_leaks(frame, benchmark).collect()} == set(range(42)) - {3, 5, 7, 9}
    assert decontaminate.find_leaks(none, benchmark).count() == 0 and decontaminate.find_leaks(frame, benchmark.limit(0)).count() == 0


def test_words_of_a_candidate_are_looked_up(monkeypatch):
    """A candidate is told by membership; sorting both sides for every candidate took most of the search."""
    g = np.random.default_rng(4)
    cases = [(g.integers(0, 30, g.integers(10, 50)).astype(np.uint32), g.integers(0, g.integers(10, 60), 120).astype(np.uint32)) for _ in range(300)]
    cases += [(a, np.concatenate([b, a])) for a, b in cases[:50]]
    few = [bool(np.isin(a, b).mean() < decontaminate.LIKELY) for a, b in cases]
    monkeypatch.setattr(np, "isin", None)
    for (a, b), too_few in zip(cases, few, strict=True):
        share = decontaminate.common(a, b) / len(a)
        found = decontaminate.confirmed(a, b)
        assert found in (0.0, share) and not (too_few and found) and (too_few or share < decontaminate.SURE or found == share)
    assert 0 < sum(few) < len(few)


def test_segments_against_brute_force():
    g = np.random.default_rng(3)
    for _ in range(200):
        s = np.round(g.normal(-0.2, 1, g.integers(0, 25)), 2)
        runs = {(a, b): s[a:b].sum() for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        best = max([0.0, *runs.values()])
        assert abs(toxicity.best_segment(s) - best) < 1e-9
        found = toxicity.maximal_segments(s.tolist())
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        assert abs(max([0.0, *[t for *_, t in found]]) - best) < 1e-9


def test_toxic_passages_add_up():
    g = np.random.default_rng(8)
    for _ in range(300):
        s = np.round(g.normal(-0.2, 1, g.integers(0, 60)), 2)
        assert np.allclose(np.sort(toxicity.segment_sums(s)), np.sort([t for *_, t in toxicity.maximal_segments(s.tolist())]), atol=1e-5)
    model = toxicity.Model(np.array([0.0, 90.0]), np.array([900.0, 0.0]))
    model.shift, model.slope, model.scale, model.curve = 2.0, 0.5, 1.0, (-6.0, 1.0)
    at = lambda *levels: model.evidence(max(s := [x + 2.0 + 0.5 * np.log1p(1000) for x in levels]), 1000, s)
    assert abs(at(4.0) - 4.0) < 1e-9 and abs(at(-1.0, -2.0) + 1.0) < 1e-9 and abs(at(4.0, -1.0) - 4.0) < 1e-5
    assert at(4.0, 4.0, 4.0) > 6 > at(4.0)  # each stays under the level, all together are marked
    assert model.probability(np.array([at(4.0, 4.0, 4.0), at(4.0)])).round().tolist() == [1, 0]
    runs = [at(*[3.0] * r) for r in range(1, 8)]
    assert all(a < b for a, b in zip(runs, runs[1:], strict=False))
    scorer = {"scum": 2.5, **{w: -0.5 for w in WORDS}}
    plain = WORDS[:5]
    best = [toxicity.best_segment(toxicity.text_scores([*plain, *["scum"] * k, *plain], scorer)) for k in (1, 2, 3, 50)]
    assert best[0] < best[1] < best[2] < best[3] < 3 * best[0]


def test_toxicity_and_quality_hold_out(spark, none):
    bad = ["vile", "scum", "idiot"]
    texts = []
    for i in range(400):
        words = prose(60).split()
        for _ in range(3 if i % 4 == 0 else 0):
            words[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(words) if i % 5 else " ".join(w + "###" for w in words))
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model, scored = toxicity.train(frame, labels, "toxic")
    got = {r.doc_id: r.score for r in toxicity.probabilities(scored, model).collect()}
    assert len(got) == 402 and sum((got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)) >= 95 and got[400] == got[401] < 0.5
    assert {r.doc_id for r in toxicity.without_toxic(frame, model).collect()} == {i for i, s in got.items() if s < 0.5}
    significant = {r.doc_id for r in scored.collect() if model.level(np.array([r.best]), np.array([r.n]))[0] >= 5}
    assert {r.doc_id for r in toxicity.passages(frame, model).collect()} == significant
    model = quality.train(frame, labels.withColumn("grade", F.col("quality") * 2 - F.col("quality") * F.col("toxic")))
    assert (np.diff(model.cuts) > 0).all()
    grades = {r.doc_id: r for r in quality.grade(frame, model).collect()}
    assert len(grades) == 402 and sum(grades[i].selected == (i % 5 != 0) for i in range(300, 400)) >= 95
    empty_model, empty = toxicity.train(none, labels.limit(0), "toxic")
    assert toxicity.probabilities(empty, empty_model).count() == 0
    assert quality.grade(none, quality.train(none, labels.limit(0).withColumn("grade", F.lit(0)))).count() == 0
