"""Packings: every piece once, no sequence too long, near the least number there can be, ids as the library gives them."""

import random
import zlib

import numpy as np
import pytest

from castwright.llm import packing
from castwright.llm.queries import op13_packing, tokenizer_path


def sizes(n, seed):
    rnd = np.random.default_rng(seed)
    return np.sort(np.concatenate([rnd.integers(1, 1024, n), np.full(n // 8, 890), np.full(n // 10, 134)]))[::-1].copy()


def first_fit_falling(lengths):
    rooms = []
    for s in sorted(lengths.tolist(), reverse=True):
        fitting = [r for r in rooms if r >= s]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - s)
        else:
            rooms.append(1024 - s)
    return len(rooms)


def check(bins, lengths):
    assert (bins >= 0).all() and np.bincount(bins, weights=lengths).max() <= 1024
    assert (np.bincount(bins) > 0).all()


def test_steps():
    for seed, n in enumerate((1, 2, 3, 10, 200, 800)):
        lengths = sizes(n, seed)
        for island in (0, 1):
            population = packing.founders(lengths, island, np.random.default_rng(seed), 1024)
            for bins in population:
                check(bins, lengths)
            rng = np.random.default_rng(seed)
            for _ in range(20 * (n > 2)):
                check(packing.child(population[0], population[1], lengths, rng, 1024), lengths)
            found = packing.evolved(lengths, population, 7, 1024)
            ranks = [packing.fitness(b, lengths) for b in found]
            assert ranks == sorted(ranks) and ranks[0] <= min(packing.fitness(b, lengths) for b in population)
            check(found[0], lengths)


def test_better_than_best_fit():
    lengths = sizes(1500, 5)
    found = packing.evolved(lengths, packing.founders(lengths, 1, np.random.default_rng(1), 1024), 1, 1024)
    least, plain = packing.least_bins(lengths, 1024), first_fit_falling(lengths)
    assert least <= packing.fitness(found[0], lengths)[0] <= plain


def test_exact_fill_finds_pairs_and_triples():
    for lengths, bins in (([1000, 24], 1), ([512, 512, 512, 512], 2), ([900, 100, 24, 1000, 24], 2), ([1023, 1], 1), ([1], 1), ([342, 341, 341] * 5, 5)):
        lengths = np.sort(np.array(lengths))[::-1].copy()
        found = packing.exact_fill(lengths.tolist(), 1024)
        check(found, lengths)
        assert found.max() + 1 == bins


@pytest.mark.parametrize("kind,group", [("long", 1 << 14), ("string", 60)])
def test_query(spark, tmp_path, monkeypatch, kind, group):
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    words = [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 999)}é" for _ in range(500)]
    texts = [None, "", " ", "\n\n  x \t", "a" * 3000, "é" * 2000] + [" ".join(rnd.choices(words, k=int(rnd.paretovariate(0.7)) * 20 % 2000)) for _ in range(500)]
    texts += [texts[20]] * 150  # one length, many rows
    rows = [(None if i == 30 else i, t, 1, "x", 2) for i, t in enumerate(texts)] + [(40, texts[40], 1, "x", 2)] * 2
    if kind == "string":
        rows = [(None if r[0] is None else str(r[0]), *r[1:]) for r in rows]
    spark.createDataFrame(rows, f"doc_id {kind}, text string, row int, sequence string, length int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(packing, "GROUP", group)
    got = op13_packing(spark, str(tmp_path)).collect()
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), []
    for key, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[start : first + 1024 * piece]
            want.append((key, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 1024
    lengths = np.array([r.length for r in got])
    assert packing.least_bins(lengths, 1024) <= len(sequences) <= first_fit_falling(lengths) + (5 if group == 60 else 0)  # tiny groups: each may end with a bin that is partly empty


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op13_packing(spark, str(tmp_path))
    assert found.count() == 0 and dict(found.dtypes) == {"doc_id": "int", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
