"""Personal data: generators propose spans, boosted trees judge them, thresholds select what to redact.

1. Base patterns find email addresses, IPv4 addresses, card numbers and phone numbers by fixed rules.
2. High-recall generators propose further, overlapping spans: written-out addresses, local phone numbers, social
   security numbers, IBANs, keys and tokens, long digit runs that fail a checksum.
3. Gradient-boosted trees score each candidate by its format (length, digits, entropy, checksums) and its context (cue
   words before it, characters around it). They are trained on the driver from format grammars with a fixed seed: true formats
   with and without cues, against look-alikes (versions, dates, sums, hashes in paths, long words).
4. One threshold a kind, calibrated on held-out grammar samples to the least score from 0.5 on with `PRECISION`, selects spans. A
   selected span is added unless it overlaps a base span or a better candidate.

Texts are scanned whole, in time linear in their length; a null counts as empty and has no spans; rows alike get
rows alike. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from castwright.llm.common import checked

# Fixed order of kinds: ties of a start follow it.
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "iban", "ssn", "local_phone", "written_email", "long_number")
KINDS = BASE + ADDED
PRECISION, ROUNDS, DEPTH, RATE, TRAIN = 0.97, 40, 3, 0.2, 6000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always begins at the start of its digit run, as the run before it is consumed whole; saying so keeps the scan linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")

_GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    "written_email": re.compile(r"[A-Za-z0-9_%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+"),
    "long_number": re.compile(r"(?<![0-9.,-])[0-9]{9,19}(?![0-9.,-])"),
}
_CUES = {
    "key": re.compile(r"(?:token|key|secret|passw|pwd|auth|bearer|credential)", re.I),
    "call": re.compile(r"(?:phone|tel|call|mobile|cell|fax|contact)", re.I),
    "id": re.compile(r"(?:ssn|social|security|passport|tax)", re.I),
    "bank": re.compile(r"(?:iban|bank|account|card|credit|transfer)", re.I),
    "mail": re.compile(r"(?:mail|write to|reach|contact)", re.I),
    "not": re.compile(r"(?:version|order|invoice|isbn|part|page|path|http|commit|sha|md5|build|item)", re.I),
}


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the base patterns: leftmost, not overlapping within a kind; failing matches are dropped."""
    spans = []
    at, done = text.find("@"), 0
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        found = _DOMAIN.match(text, at + 1) if first < at else None
        if found:
            spans.append((first, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group() if c < "\x80") <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 1]
    n, counts = len(span), Counter(span)
    digits = "".join(c for c in span if "0" <= c <= "9")
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
    return [
        float(ADDED.index(kind)), n, len(digits) / n, sum(c.isupper() for c in span) / n, sum(c.islower() for c in span) / n, entropy, len(counts), changes / n,
        float(sum(not c.isalnum() for c in span)), float(bool(digits) and luhn(digits)), float(kind == "iban" and _iban(span)),
        *[float(bool(c.search(before))) for c in _CUES.values()],
        float(before[-1:] in ('"', "'", "=", ":", "(")), float(before[-1:] in ("/", ".", "_", "-", ",")), float(after in ("/", ".", "_", "-")),
    ]


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidate spans of all generators."""
    found = []
    for kind, pattern in _GENERATORS.items():
        if kind == "written_email" and "at)" not in text and "at]" not in text:
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return found


def _examples(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates from format grammars: true formats and look-alikes, each in a context."""
    pick = lambda *x: x[rng.integers(len(x))]
    chars = lambda a, k: "".join(a[i] for i in rng.integers(0, len(a), k))
    num, hexa, mixed = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    low = "etaoinshrdlu"

    def iban() -> str:
        body, land = chars(num, int(rng.integers(12, 22))), pick("DE", "FR", "ES", "GB")
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        return f"{land}{check:02d}{body}"

    true = [
        ("secret", lambda: chars(hexa, pick(32, 40, 64)), ('token = "', "api_key: ", "secret=", "auth ", 'password = "')),
        ("secret", lambda: pick("sk-", "ghp_", "AKIA", "") + chars(mixed, int(rng.integers(24, 48))), ("key=", "token: ", 'bearer "', "credential ", "is ")),
        ("iban", iban, ("iban ", "transfer to ", "account ", "and ")),
        ("ssn", lambda: f"{chars(num, 3)}-{chars(num, 2)}-{chars(num, 4)}", ("ssn ", "social security ", "tax id ", "the ")),
        ("local_phone", lambda: pick("({}) {}-{}", "{}-{}-{}", "{}.{}.{}").format(chars(num, 3), chars(num, 3), chars(num, 4)), ("call ", "phone: ", "tel ", "or ")),
        ("written_email", lambda: f"{chars(low, 6)}{pick(' [at] ', '(at)')}{chars(low, 7)}{pick(' [dot] ', '.')}com", ("mail ", "write to ", "by ")),
        ("long_number", lambda: chars(num, int(rng.integers(9, 17))), ("account ", "passport ", "card ", "tax ")),
    ]
    false = [
        ("secret", lambda: chars(low, int(rng.integers(20, 40))), ("the ", "of ", "path ")),
        ("secret", lambda: "/".join(chars(low, 7) for _ in range(4)), ("http:/", "path ", "in ")),
        ("secret", lambda: "-" * int(rng.integers(20, 60)), ("", " ")),
        ("secret", lambda: chars(hexa, 40), ("commit ", "sha ", "md5 ")),
        ("iban", lambda: f"{pick('AB', 'XY')}{chars(num, 2)}{chars(num, 14)}", ("part ", "item ", "order ")),
        ("ssn", lambda: f"{chars(num, 3)}-{chars(num, 2)}-{chars(num, 4)}", ("part ", "isbn ", "order ")),
        ("local_phone", lambda: f"{chars(num, 3)}.{chars(num, 3)}.{chars(num, 4)}", ("version ", "build ", "invoice ")),
        ("written_email", lambda: f"{chars(low, 5)} (at) {chars(low, 5)}.{chars(low, 3)}", ("version ", "page ")),
        ("long_number", lambda: chars(num, int(rng.integers(9, 19))), ("order ", "invoice ", "the ", "of ", "item ", "and ")),
    ]
    rows, labels = [], []
    for i in range(n):
        kind, make, cues = (true if i % 2 else false)[rng.integers(len(true if i % 2 else false))]
        lead = f"{chars(low, 6)} {pick(*cues)}"
        span = make()
        rows.append(features(kind, lead + span + pick("", " ", ".", '"'), len(lead), len(lead) + len(span)))
        labels.append(i % 2)
    return np.array(rows), np.array(labels, float)


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> tuple:
    """A regression tree by exact greedy splits at up to 16 quantiles of each feature: (feature, cut, low, high) or (value,)."""
    best = (1e-6, 0, 0.0)
    total = grad.sum() ** 2 / (hess.sum() + 1)
    for f in range(x.shape[1] if depth and len(x) > 20 else 0):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 16))):
            low = x[:, f] <= cut
            if 10 <= low.sum() <= len(x) - 10:
                gain = grad[low].sum() ** 2 / (hess[low].sum() + 1) + grad[~low].sum() ** 2 / (hess[~low].sum() + 1) - total
                best = max(best, (gain, f, float(cut)))
    if best[0] <= 1e-6:
        return (float(grad.sum() / (hess.sum() + 1)),)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[low], grad[low], hess[low], depth - 1), _tree(x[~low], grad[~low], hess[~low], depth - 1)


def _value(tree: tuple, row: list[float]) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def score(model: list[tuple], row: list[float]) -> float:
    return 1 / (1 + math.exp(-RATE * sum(_value(t, row) for t in model)))


@cache
def trained(seed: int = 7) -> tuple[list[tuple], dict[str, float]]:
    """The trees, and a threshold for each kind."""
    rng = np.random.default_rng(seed)
    x, y = _examples(rng, TRAIN)
    margin, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        part = rng.random(len(x)) < 0.5
        trees.append(_tree(x[part], (y - p)[part], (p * (1 - p))[part], DEPTH))
        margin += RATE * np.array([_value(trees[-1], row) for row in x.tolist()])
    held, truth = _examples(rng, TRAIN // 2)
    scores = np.array([score(trees, row) for row in held.tolist()])
    cuts = {}
    for i, kind in enumerate(ADDED):
        own = held[:, 0] == i
        order = np.argsort(-scores[own])
        good = np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1) >= PRECISION
        cuts[kind] = max(0.5, float(scores[own][order][np.flatnonzero(good)[-1]])) if good.any() else 2.0
    return trees, cuts


def all_spans(text: str, model: list[tuple], cuts: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all selected spans: (start, place in KINDS, end), sorted."""
    base = base_spans(text)
    judged = []
    for kind, start, end in proposals(text):
        p = score(model, features(kind, text, start, end))
        if p >= cuts[kind]:
            judged.append((-p, start, end, kind))
    if not judged:
        return base, base
    edges = sorted((s, e) for s, _, e in base)
    kept: list[tuple[int, int]] = []
    added = []
    import bisect

    def free(spans: list[tuple[int, int]], start: int, end: int) -> bool:
        i = bisect.bisect_left(spans, (end, -1))
        return i == 0 or spans[i - 1][1] <= start

    # Base spans of different kinds may overlap; merged, the last one before a point decides.
    merged: list[tuple[int, int]] = []
    for s, e in edges:
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    for _, start, end, kind in sorted(judged):
        if free(merged, start, end) and free(kept, start, end):
            bisect.insort(kept, (start, end))
            added.append((start, KINDS.index(kind), end))
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_email, n_ip, n_card, n_phone, base_sha256 and spans (see the module)."""
    model, cuts = trained()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, len(BASE)), np.int64)
            digests, lists = [], []
            for i, value in enumerate(batch[1]):
                base, spans = all_spans(value.as_py() or "", model, cuts)
                for _, k, _ in base:
                    counts[i, k] += 1
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                lists.append(joined(spans))
            columns = [batch[0], *[pa.array(counts[:, k]) for k in range(len(BASE))], pa.array(digests), pa.array(lists)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    rows = checked(docs, key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(scan, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
