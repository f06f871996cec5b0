"""Runs against brute force over every period, and the query's digest columns on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from castwright.llm import periodic
from castwright.llm.queries import op11_periodic_runs


def brute_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def odd_text(rnd):
    """Stretches of few words, repeated, nested and cut, so that periods lie within periods."""
    few, out = rnd.choice([1, 2, 3, 50]), []
    for _ in range(rnd.randint(0, 6)):
        part = [str(rnd.randint(0, few)) for _ in range(rnd.randint(1, rnd.choice([3, 12, 40])))]
        if rnd.random() < 0.6:
            part = part * rnd.randint(1, 9)
            if rnd.random() < 0.5:
                part = (part + [str(rnd.randint(0, few))]) * rnd.randint(1, 5)
        out += part + part[: rnd.randint(0, len(part))]
    return out[:900]


def test_runs_against_brute_force():
    rnd, total = random.Random(11), 0
    for _ in range(250):
        texts = [[w.encode() for w in odd_text(rnd)] for _ in range(rnd.randint(1, 4))]
        for (found, kept), text in zip(periodic.analysed(texts), texts, strict=True):
            runs = brute_runs(text)
            total += len(runs)
            assert sorted(map(tuple, found.tolist())) == runs
            dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
            assert kept == b" ".join(w for i, w in enumerate(text) if i not in dropped)
    assert total > 1000


def test_wavelet_tree():
    rnd = np.random.default_rng(1)
    for size in (1, 2, 3, 8, 100, 129):
        values = rnd.permutation(size)
        tree = periodic.WaveletTree(values, size)
        low, high = np.sort(rnd.integers(0, size + 1, (2, 200)), axis=0)
        bound = rnd.integers(0, size + 1, 200)
        assert tree.below(low, high, bound).tolist() == [(values[a:b] < c).sum() for a, b, c in zip(low, high, bound, strict=True)]
        some = high > low
        low, high = low[some], high[some]
        k = rnd.integers(0, high - low)
        assert tree.smallest(low, high, k).tolist() == [np.sort(values[a:b])[c] for a, b, c in zip(low, high, k, strict=True)]


def test_long_periodic_texts_take_little_time():
    for text in ([b"a"] * 300_000, [b"a", b"b"] * 150_000, ([b"a"] * 999 + [b"b"]) * 300):
        ((found, kept),) = periodic.analysed([text])
        assert (0, len(text), len(kept.split())) in set(map(tuple, found.tolist())) or len(found) > 1


def expected(doc_id, text):
    words = [w for w in re.split(r"[\x20\t\n\x0b\x0c\r]+", text or "") if w]
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    start, length, period = best or (None, None, None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), start, length, period, best and 1000 * length // period, *sha)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("key", ["long", "string"])
def test_query_on_odd_rows(spark, tmp_path, key):
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "one", "a " * 30, "é  x  " * 40, "b\x0bc\x0cd\re " * 25, "x" * 100_000]
    texts += ["  ".join(odd_text(rnd)) for _ in range(150)]
    rows = [(None if i == 9 else i, t, "own", 1.5, "x") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "c d " * 60, None, None, None)]
    if key == "string":
        rows = [(r[0] if r[0] is None else f"d{r[0]}", *r[1:]) for r in rows]
    schema = f"doc_id {key}, text string, runs string, best double, collapsed string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)
    assert sum(r[1] for r in got) > 50


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_periodic_runs(spark, str(tmp_path))
    assert found.count() == 0
    assert [t for _, t in found.dtypes] == ["bigint"] * 6 + ["string"] * 2
