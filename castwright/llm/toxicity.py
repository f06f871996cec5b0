"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics.

1. Log-odds. A word's probability of standing in a toxic document has a chain of Dirichlet (here Beta) priors: all words,
   then the word's first 3, 4, 5, 6 and 8 letters, then the word. Each link is the posterior mean with the link before
   as prior, of weight `PRIOR`. Counts are per document and word, hashed to `BUCKETS` counters, so the model has a fixed size.
2. Segments. Each word scores its log-odds against all words, less `DRIFT`, so that plain text drifts down; the k-th place of
   a word in a text adds 1/k of its evidence, so repetition counts, but ever less. One linear scan finds every maximal segment
   (disjoint, none can be extended).
3. Extreme values. One training row in `FOLDS` is kept from the counts. Over its non-toxic documents of n words the best score S follows a Gumbel law with location
   a + b log(n); (S - location) / scale is comparable across lengths.
4. Sums. Karlin-Altschul: with segments at levels z1 >= z2 >= ..., the chance that r of them reach a sum T of levels is about
   e^-T T^(r-1) / (r! (r-1)!). All segments above the usual best one (z > 0) are taken; the r with the least chance
   counts, at the price of a factor 2^r for having tried several, and minus the log of that chance is the text's evidence. For r = 1
   it is z itself (but for a constant). A logistic curve, fitted on counts by steps of the evidence, turns it into the
   probability of the toxic label.

The labelled rows are a bounded sample (`LABELLED`, by a hash of the id), small enough to broadcast. Scores cover every
row and whole text. Null and empty texts score as a text without words; rows alike score alike; an empty table
gives no rows; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright.llm.common import checked, land

BUCKETS, LABELLED, FOLDS, PRIOR, DRIFT, CACHE = 1 << 20, 200_000, 4, 25.0, 0.35, 300_000
LINKS = (3, 4, 5, 6, 8)
STRIP = ".,;:!?\"'()[]{}<>%#&$*|-_/\\"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def chain(word: str) -> list[int]:
    """Counters of a word's prefixes, then its own."""
    core = word.strip(STRIP)
    return [zlib.crc32(f"{n}:{core[:n]}".encode()) % BUCKETS for n in LINKS if n < len(core)] + [zlib.crc32(f"0:{core}".encode()) % BUCKETS]


def sample_labels(labels: DataFrame, label: str, bound: int = LABELLED) -> DataFrame:
    """At most `bound` labelled rows (doc_id, label), chosen by a hash of the id; one label an id (the largest)."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def word_counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counters of (document, word) pairs in documents labelled 1 and 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> None:
            for y in (0, 1):
                for word, n in seen[y].items():
                    for b in chain(word):
                        total[y, b] += n
                seen[y].clear()

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"].to_pylist(), strict=True):
                seen[1 if label else 0].update({*words_of(text.as_py() or "")})
                if len(seen[0]) + len(seen[1]) > CACHE:
                    flush()
        flush()
        used = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "n1": total[1, used], "n0": total[0, used]})

    known = checked(docs, "doc_id", "text").join(F.broadcast(labels), "doc_id").select("text", "label")
    sums = known.mapInArrow(count, "bucket int, n1 long, n0 long").groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    found = sums.select("bucket", F.col("n1").cast("float"), F.col("n0").cast("float")).toArrow()  # BUCKETS rows at most
    out = np.zeros((2, BUCKETS), np.float32)
    for y, name in ((1, "n1"), (0, "n0")):
        out[y, found["bucket"].to_numpy()] = found[name].to_numpy()
    return out[1], out[0]


class Scorer(dict):
    """Score of each word, kept up to `CACHE` words."""

    def __init__(self, n1: np.ndarray, n0: np.ndarray, rate: float) -> None:
        self.n1, self.n0, self.rate, self.base = n1, n0, rate, math.log(rate / (1 - rate))

    def __missing__(self, word: str) -> float:
        p = self.rate
        for b in chain(word):
            one, zero = float(self.n1[b]), float(self.n0[b])
            p = (one + PRIOR * p) / (one + zero + PRIOR)
        value = math.log(p / (1 - p)) - self.base - DRIFT
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


def text_scores(words: list[str], scorer: Scorer) -> np.ndarray:
    """Score of each word of a text; the k-th place of a word with positive evidence keeps 1/k of that evidence."""
    scores = np.array([*map(scorer.__getitem__, words)])
    seen: dict[str, int] = {}
    for i in np.flatnonzero(scores > 0).tolist():
        k = seen[words[i]] = seen.get(words[i], 0) + 1
        if k > 1:
            scores[i] = (scores[i] + DRIFT) / k - DRIFT
    return scores


def best_segment(scores: np.ndarray) -> float:
    """The largest sum of a run; 0 for the empty run."""
    if not len(scores):
        return 0.0
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return float((sums - np.minimum.accumulate(sums)).max())


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring runs (start, end, sum) in one pass, in amortised linear time.

    A stack holds candidate runs with the total before and after each. A new positive score looks back for the
    last candidate with a smaller total before it; if that one also ends lower, the two and all between merge.
    """
    stack: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, low = i, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                stack.append((start, i + 1, low, total))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high in stack]


def segment_sums(scores: np.ndarray) -> np.ndarray:
    """Sums of all maximal segments, without their places; each candidate knows the last one before it with a smaller total."""
    up = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    done: list[float] = []
    lows: list[float] = []
    highs: list[float] = []
    links: list[int] = []
    for low, high in zip(sums[up].tolist(), sums[up + 1].tolist(), strict=True):
        while True:
            j = len(lows) - 1
            while j >= 0 and lows[j] >= low:
                j = links[j]
            if j < 0:  # no later run can reach those before this one
                done.extend(h - w for h, w in zip(highs, lows, strict=True))
                lows, highs, links = [low], [high], [-1]
                break
            if highs[j] >= high:
                lows.append(low)
                highs.append(high)
                links.append(j)
                break
            low = lows[j]
            del lows[j:], highs[j:], links[j:]
    done.extend(h - w for h, w in zip(highs, lows, strict=True))
    return np.array(done, np.float32)


class Model:
    """The counters and the fitted curves; a few megabytes, whatever the corpus."""

    def __init__(self, n1: np.ndarray, n0: np.ndarray) -> None:
        self.n1, self.n0 = n1, n0
        ones, zeros = float(n1.sum()), float(n0.sum())
        self.usable = ones > 0 and zeros > 0
        self.rate = ones / (ones + zeros) if self.usable else 0.5
        self.shift = self.slope = self.scale = 0.0
        self.curve = (0.0, 0.0)

    def scorer(self) -> Scorer:
        return Scorer(self.n1, self.n0, self.rate)

    def level(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Gumbel units above the usual best score of a text of n words."""
        return (best - self.shift - self.slope * np.log1p(n)) / self.scale

    def evidence(self, best: float, n: int, sums: np.ndarray) -> float:
        """Minus the log of the chance of the text's segments (without a constant): of the best one, or of the r best together."""
        top = float(self.level(np.float64(best), np.float64(n)))
        levels = self.level(np.asarray(sums, np.float64), np.float64(n))
        levels = np.sort(levels[levels > 0])[::-1]
        if len(levels) < 2:
            return top
        r = np.arange(1, len(levels) + 1)
        total = np.maximum(np.cumsum(levels), r - 1)  # below r - 1 the formula no longer falls with the sum
        logs = np.cumsum(np.log(r))  # of r!
        chance = total - (r - 1) * np.log(np.maximum(total, 1e-9)) + logs + (logs - np.log(r)) - (r - 1) * math.log(2)
        return max(top, float(chance[1:].max()))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if not self.usable or not self.scale:
            return np.zeros(len(evidence))
        z = np.clip(evidence, -5, 60)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * z, -30, 30)))

    def curves(self) -> Model:
        """The fitted curves alone, without the counters."""
        out = Model(np.zeros(1), np.zeros(1))
        out.__dict__.update({k: v for k, v in self.__dict__.items() if k not in ("n1", "n0")})
        return out


def best_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n (words), best (the largest segment score), sums (the scores of all maximal segments) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            n, best, sums = [], [], []
            for text in batch["text"]:
                words = words_of(text.as_py() or "")
                scores = text_scores(words, scorer)
                n.append(len(words))
                best.append(best_segment(scores))
                sums.append(segment_sums(scores))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(sums, pa.list_(pa.float32()))], names=["doc_id", "n", "best", "sums"])

    rows = checked(docs, "doc_id", "text")
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, best double, sums array<float>")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[Model, DataFrame]:
    """The model, and the landed best scores of all rows (they do not depend on the curves)."""
    known = land(sample_labels(labels, label))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)) == 0
    model = Model(*word_counts(docs, known.where(~fold)))
    scored = land(best_scores(docs, model))
    own = scored.join(known.where(fold), "doc_id")  # rows whose words the counters have not seen
    # Gumbel by moments, its location linear in log(n): least squares over the non-toxic rows from five sums.
    x, y = F.log1p("n"), F.col("best")
    s = own.filter("label = 0").agg(F.count(F.lit(1)).alias("c"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy")).first()
    if not model.usable or not s["c"]:
        return model, scored
    model.slope = s["xy"] / s["xx"] if s["xx"] else 0.0
    model.scale = max(math.sqrt(max(s["yy"] - model.slope * (s["xy"] or 0.0), 0.0)) * math.sqrt(6) / math.pi, 0.05)
    model.shift = s["y"] - 0.5772156649 * model.scale - model.slope * s["x"]
    z = evidence_of(model)
    steps = own.select(F.round(F.greatest(F.lit(-5.0), F.least(F.lit(60.0), z)) * 4).alias("z"), "label").groupBy("z").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).toPandas()  # 261 rows at most
    model.curve = logistic(steps["z"].to_numpy(float) / 4, steps["ones"].to_numpy(float), steps["n"].to_numpy(float))
    return model, scored


def logistic(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through counts, by Newton steps with a slight ridge."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (ones - n * p) - 0.05 * beta
        beta += np.clip(np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + 0.05 * np.eye(2), grad), -2, 2)
    return float(beta[0]), float(beta[1])


def evidence_of(model: Model) -> Column:
    """The evidence of the rows of `best_scores`."""
    curves = model.curves()

    def evidence(n: pd.Series, best: pd.Series, sums: pd.Series) -> pd.Series:
        return pd.Series([curves.evidence(*row) for row in zip(best, n, sums, strict=True)], dtype="float64")

    return F.pandas_udf(evidence, "double")("n", "best", "sums")


def probabilities(scored: DataFrame, model: Model) -> DataFrame:
    """Adds score: the probability of the toxic label."""
    curves = model.curves()

    def curve(n: pd.Series, best: pd.Series, sums: pd.Series) -> pd.Series:
        if not curves.scale:
            return pd.Series(np.zeros(len(n)))
        return pd.Series(curves.probability(np.array([curves.evidence(*row) for row in zip(best, n, sums, strict=True)])))

    return scored.withColumn("score", F.pandas_udf(curve, "double")("n", "best", "sums"))


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = own.scorer()
        for batch in batches:
            found = []
            for text in batch["text"]:
                words = words_of(text.as_py() or "")
                scores = text_scores(words, scorer)
                found.append(own.evidence(best_segment(scores), len(words), segment_sums(scores)) if own.scale else 0.0)
            yield batch.filter(pa.array(own.probability(np.array(found)) < least))

    return docs.mapInArrow(keep, docs.schema)


def passages(docs: DataFrame, model: Model, least: float = 5.0) -> DataFrame:
    """doc_id and every significant toxic passage: start and end (words), sum, level (Gumbel units, `least` or more), text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = own.scorer()
        for batch in batches:
            out = []
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = (text.as_py() or "").split()
                scores = text_scores([w.lower() for w in words], scorer)
                size = np.array([len(words)])
                if not own.scale or own.level(np.array([best_segment(scores)]), size)[0] < least:
                    continue
                for a, b, total in maximal_segments(scores.tolist()):
                    level = float(own.level(np.array([total]), size)[0])
                    if level >= least:
                        out.append((key, a, b, total, level, " ".join(words[a:b])))
            names = ["doc_id", "start", "end", "sum", "level", "passage"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema=pa.schema([("doc_id", batch["doc_id"].type), ("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64()), ("level", pa.float64()), ("passage", pa.string())]))

    rows = checked(docs, "doc_id", "text")
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, end long, sum double, level double, passage string")
