"""Quality: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = logistic(cut_k - w.x): one weight vector for all grades, ordered cuts. x holds hashed words (document
frequency weighted by length) and a few measures of form. Cuts are a first value and positive steps, so their order
holds by construction. The fit runs on the driver over a bounded sample of labelled rows (`SAMPLE`, by a hash of the id), as
sparse rows of 4 bytes a feature; every row of the table is then scored.

Results: expected grade, and the tail probability P(grade >= wanted), which selects. Null and empty texts have no
words and score by their form; rows alike score alike; without at least two grades in the sample the only
grade (or 0) is expected everywhere.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.llm.common import checked, land

SIZE, SAMPLE, CACHE, FORMS, EPOCHS = 1 << 17, 20_000, 300_000, 15, 12
_UPPER = re.compile(r"\b[^\W\d_a-z]{3,}\b")
_MARKS = re.compile(r"[^\w\s.,;:'\"!?-]")


class Hasher(dict):
    """Feature of each word: its letters, or its shape if it has marks or digits."""

    def __missing__(self, word: str) -> int:
        core = word.strip(".,;:!?'\"()")
        shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "0", core))
        value = FORMS + zlib.crc32((shape if shape != "a" else core).encode()) % (SIZE - FORMS)
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


def vector(text: str, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Features and their values: hashed words of unit length together, then the measures of form."""
    lowered = text.lower().split()
    again = sum(a == b for a, b in zip(lowered, lowered[1:], strict=False))
    found, counts = np.unique(np.array([*map(hasher.__getitem__, lowered)], np.int64), return_counts=True)
    weights = np.log1p(counts)
    weights = weights / max(float(np.sqrt((weights**2).sum())), 1e-9)
    n, lines = max(len(lowered), 1), text.split("\n")
    size = max(len(text), 1)
    forms = [
        1.0, np.log1p(len(lowered)) / 10, len(set(lowered)) / n, min(len(_MARKS.findall(text)) / size * 10, 2.0), sum(map(len, lowered)) / n / 10, min(len(lines) / n * 5, 2.0),
        len(set(lines)) / len(lines), min(text.count("|") / n, 2.0), min((text.count(".") + text.count(",")) / n * 3, 2.0), min(sum(map(str.isdigit, lowered)) / n * 5, 2.0), float(counts.max() / n) if len(counts) else 0.0, float(not lowered),
        len(_UPPER.findall(text)) / n, again / n * 2, min((text.count("!") + text.count("?")) / n * 2, 2.0),
    ]
    return np.concatenate([np.arange(FORMS), found]), np.concatenate([np.array(forms) * 2, weights])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ordinal:
    """The fitted weights (float32, `SIZE` of them) and cuts."""

    def __init__(self, grades: int) -> None:
        self.weights, self.cuts = np.zeros(SIZE, np.float32), np.linspace(-1, 1, max(grades - 1, 1))[: grades - 1]

    def tails(self, level: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in the columns."""
        return _logistic(level[:, None] - self.cuts[None, :])

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = EPOCHS, rate: float = 0.15, ridge: float = 2e-5) -> None:
        """Gradient steps with per-weight rates over batches in a seeded order."""
        rng, squares, cut_squares = np.random.default_rng(0), np.full(SIZE, 1e-6), np.full(len(self.cuts), 1e-6)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                sizes = [len(rows[i][0]) for i in part]
                at, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
                owner = np.repeat(np.arange(len(part)), sizes)
                level = np.bincount(owner, self.weights[at] * x, len(part))
                y = grades[part]
                # With edges -inf, cuts, +inf: P(y) = F(edge[y+1] - level) - F(edge[y] - level).
                edges = np.concatenate([[-1e9], self.cuts, [1e9]])
                high, low = _logistic(edges[y + 1] - level), _logistic(edges[y] - level)
                slope_high, slope_low, mass = high * (1 - high), low * (1 - low), np.maximum(high - low, 1e-9)
                pull = (slope_low - slope_high) / mass  # d log P / d level
                grad = np.bincount(at, pull[owner] * x, SIZE) / len(part) - ridge * self.weights
                squares += grad**2
                self.weights += (rate * grad / np.sqrt(squares)).astype(np.float32)
                step = np.zeros(len(self.cuts) + 2)
                np.add.at(step, y + 1, slope_high / mass)
                np.add.at(step, y, -slope_low / mass)
                grad_cuts = step[1:-1] / len(part)
                cut_squares += grad_cuts**2
                self.cuts = np.maximum.accumulate(self.cuts + rate * grad_cuts / np.sqrt(cut_squares) + np.arange(len(self.cuts)) * 1e-9)


def train(docs: DataFrame, ratings: DataFrame, bound: int = SAMPLE) -> Ordinal:
    """Fit on at most `bound` rows of `ratings` (doc_id, grade from 0 on) joined to their texts."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            packed = [vector(t.as_py() or "", hasher) for t in batch["text"]]
            yield pa.RecordBatch.from_pydict({"at": pa.array([a.astype("<u4").tobytes() for a, _ in packed], pa.binary()), "x": pa.array([x.astype("<f4").tobytes() for _, x in packed], pa.binary()), "grade": batch["grade"], "doc_id": batch["doc_id"]})

    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = land(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    known = checked(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    found = known.select("doc_id", "text", "grade").mapInArrow(vectors, "at binary, x binary, grade int, doc_id long").toPandas().sort_values("doc_id")
    grades = found["grade"].to_numpy(np.int64)
    model = Ordinal(int(grades.max()) + 1 if len(grades) else 1)
    if len(np.unique(grades)) > 1:
        model.fit([(np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(x, "<f4")) for a, x in zip(found["at"], found["x"], strict=True)], grades)
    return model


def grade(docs: DataFrame, model: Ordinal, wanted: int = 1, least: float = 0.5) -> DataFrame:
    """Per row: doc_id, expected_grade, tail (P(grade >= wanted)), selected (tail >= least)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = shared.value, Hasher()
        for batch in batches:
            level = []
            for text in batch["text"]:
                at, x = vector(text.as_py() or "", hasher)
                level.append(float(own.weights[at] @ x))
            tails = own.tails(np.array(level))
            tail = tails[:, wanted - 1] if tails.shape[1] >= wanted else np.zeros(len(level))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= least)], names=["doc_id", "expected_grade", "tail", "selected"])

    rows = checked(docs, "doc_id", "text")
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail double, selected boolean")
