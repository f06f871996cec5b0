"""Ranked lexical search against a plain scan, on odd rows; shared partial sums against direct ones."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from castwright.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, top=50):
    """Rows (item row, rank, doc_id, score)."""
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    held = Counter(t for c in counts for t in c)
    out = []
    for k, (_, text) in enumerate(items):
        scores = []
        for (doc_id, _), count, n in zip(docs, counts, sizes, strict=True):
            if n:
                m = 100 - 50 + 50 * n * n_docs // n_terms
                asked = [(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))), count[t]) for t in {*terms(text)} if count[t]]
                score = sum(w * (1000000000 * tf // (1000 * tf + 20 * m)) for w, tf in asked)
                if score:
                    scores.append((-score, doc_id is None, doc_id or 0 if not isinstance(doc_id, str) else doc_id, doc_id))
        scores.sort(key=lambda s: s[:3])
        out += [(k, i + 1, s[3], -s[0]) for i, s in enumerate(scores[:top])]
    return out


def test_terms():
    for text in ["", "A-b_c`d{e}f~\x7fg", "Zażółć ÀÉ x² y 12ab", "".join(map(chr, range(0x180))), " 日本 語"]:
        assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text)


def test_shared_sets_are_added_once():
    rnd = random.Random(2)
    base = [[f"t{rnd.randint(0, 300)}" for _ in range(20)] for _ in range(8)]
    items = [[*dict.fromkeys(x.encode() for x in rnd.choice(base)[: rnd.randint(1, 20)] + [f"t{rnd.randint(0, 400)}" for _ in range(3)])] for _ in range(300)]
    items += [items[0], items[0][::-1], items[1][:1]]
    plan = lexical.mined(items)
    shared = sum(len(left) for _, left, _ in plan.levels)
    assert shared + len(plan.parts) < 0.5 * sum(map(len, items))
    table = np.zeros((plan.rows, 7), np.int64)
    values = np.random.default_rng(1).integers(0, 1 << 35, (len(plan.terms), 7))
    table[: len(plan.terms)] = values
    for first, sums in plan.sums(table):
        for i, got in enumerate(sums):
            assert (got == values[[plan.terms[t] for t in items[first + i]]].sum(axis=0)).all()


def test_many_items_in_slices(monkeypatch):
    items = [[f"t{i + j}".encode() for j in range(i % 9 + 1)] for i in range(200)]
    plan = lexical.mined(items)
    monkeypatch.setattr(lexical, "CELLS", 64)
    table = np.arange(plan.rows * 3).reshape(plan.rows, 3)
    table[len(plan.terms) :] = 0
    got = [row.tolist() for _, sums in plan.sums(table) for row in sums]
    assert got == [table[[plan.terms[t] for t in own]].sum(axis=0).tolist() for own in items]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_search(spark, monkeypatch, kind):
    rnd = random.Random(4)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(3000)] + ["É", "été", "The", "THE", "x" * 40]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 40, 300])))) for i in range(400)]
    docs += [(1000 + i, docs[7][1] + " w1 w2 w3") for i in range(130)]  # one text, many rows: ties beyond the list's end
    docs += [(2000, None), (2001, ""), (2002, " ., \n"), (None, docs[7][1] + " w1 w2 w3"), docs[3], docs[3], (2003, "w1 w2 " * 20000)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 10, 60])))) for i in range(60)]
    items += [(70, None), (71, "--"), (72, "unknownword"), (None, "w1 W2 w9"), items[5], items[5], (73, docs[7][1])]
    if kind == "string":
        docs = [(None if k is None else f"k{k:05}", t) for k, t in docs]
    monkeypatch.setattr(lexical, "TERMS", 150)
    frame = spark.createDataFrame([(k, t, 1, "z") for k, t in docs], f"doc_id {kind}, text string, score int, item_id string").repartition(5)
    asked = spark.createDataFrame([(k, t, "b") for k, t in items], "item_id long, text string, block string").repartition(3)
    got = [tuple(r) for r in lexical.rank(frame, asked).select("item_id", "rank", "doc_id", "score").collect()]
    want = [(items[k][0], *rest) for k, *rest in brute(docs, items)]
    assert len(want) > 1500
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id string, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id > 5"), items)):
        found = lexical.rank(d, i)
        assert found.count() == 0 and [t for _, t in found.dtypes] == ["string", "int", "int", "bigint"]
    assert [tuple(r) for r in lexical.rank(docs, items).collect()][0][:3] == ("1", 1, 1)
