"""Quality classifier from weak labels.

Eight overlapping heuristic labellers vote good, bad or abstain on every whole
text. Votes are counted by pattern (at most 3^8 rows reach the driver, for any
corpus) and expectation-maximisation on the counts estimates each labeller's vote
rates among good and bad texts, hence a posterior for every pattern. Posteriors
of ``TRAIN_ROWS`` different texts, those of the smallest text hashes, train a linear
scorer on hashed word shapes; it then scores every text. Copies count once in that.

Defined results: a text without words, or null, has no features and is rejected;
labellers of variety, of fresh triples and of sentence ends abstain on texts of under
20, 10 and 100 words; a very long text is described whole, in a slice of its own;
repeated rows are judged alike; an empty table gives no rows; all columns pass
through, except that columns named as outputs are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm import kernels, scratch

TRAIN_ROWS = 4096
DIMENSIONS = 4096
ROUNDS = 60
THRESHOLD = 0.5

BAD, GOOD, ABSTAIN = 0, 1, 2
_LABELLERS = 8
#: Bytes of UTF-8 by kind: lower, upper, digit, white; the rest stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = ord("a")
_KIND[128:] = ord("a")
_KIND[65:91] = ord("A")
_KIND[48:58] = ord("0")
_KIND[[9, 11, 12, 13, 10]] = 32
_RUNS = np.isin(np.arange(256), [97, 65, 48, 32])
_SYMBOLS = frozenset(b"#*$%&@^~<>{}[]\\=+_")
_STRIP = b".,;:!?\"'()-"


def shapes(text: pa.Array) -> list[bytes]:
    """Texts with each word as its shape: runs of lower, upper, digit as a, A, 0."""
    raw, offsets = kernels.buffers(text)
    kind = _KIND[raw]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~_RUNS[kind[1:]]
    edge = offsets[:-1][offsets[1:] > offsets[:-1]]
    keep[edge] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    packed = kind[keep].tobytes()
    return [packed[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _variety(words: list[str], window: int = 100) -> float:
    """Mean share of distinct words in consecutive windows."""
    if not words:
        return 0.0
    parts = [words[i : i + window] for i in range(0, len(words), window)]
    if len(parts) > 1 and len(parts[-1]) < window // 2:
        parts.pop()
    return sum(len(set(p)) / len(p) for p in parts) / len(parts)


def _vote(value: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad``, or the other way round if bad is the smaller."""
    up = value if bad > good else -value
    low, high = (good, bad) if bad > good else (-good, -bad)
    return GOOD if up <= low else BAD if up >= high else ABSTAIN


def describe(shape: bytes, text: str | None) -> tuple[int, list[int], list[float]]:
    """(vote pattern, feature indices, feature values); pattern: base-3 digits of the votes."""
    words = shape.split()
    n = len(words)
    if not n:
        return sum(ABSTAIN * 3**k for k in range(_LABELLERS)), [], []
    counts = Counter(words)
    said = (text or "").split()
    variety = _variety(said)
    fresh = len(set(zip(said, said[1:], said[2:], strict=False))) / max(1, len(said) - 2)
    share = lambda test: sum(c for w, c in counts.items() if test(w)) / n
    votes = [
        _vote(share(lambda w: not _SYMBOLS.isdisjoint(w)), 0.05, 0.2),
        _vote(share(lambda w: b"A" in w and b"a" not in w and len(w) > 1), 0.1, 0.3),
        _vote(share(lambda w: b"!" in w), 0.05, 0.2),
        _vote(share(lambda w: w == b"|"), 0.005, 0.05),
        _vote(variety, 0.6, 0.4) if n >= 20 else ABSTAIN,
        _vote(fresh, 0.85, 0.6) if n >= 10 else ABSTAIN,
        _vote(share(lambda w: w[-1:] in (b".", b"?")), 0.015, 0.005) if n >= 100 else ABSTAIN,
        _vote(share(lambda w: w.strip(_STRIP) in (b"a", b"Aa", b"A", b"0", b"a-a", b"a'a") and len(w) <= 4), 0.9, 0.6),
    ]
    hashed: dict[int, float] = {}
    for w, c in counts.items():
        i = zlib.crc32(w) % DIMENSIONS
        hashed[i] = hashed.get(i, 0.0) + c / n
    for name in (f"variety {int(variety * 10)}", f"fresh {int(fresh * 10)}", f"length {n.bit_length()}"):
        i = zlib.crc32(name.encode()) % DIMENSIONS
        hashed[i] = hashed.get(i, 0.0) + 0.5
    norm = sum(v * v for v in hashed.values()) ** 0.5
    return sum(v * 3**k for k, v in enumerate(votes)), list(hashed), [v / norm for v in hashed.values()]


def estimate(patterns: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """Posterior of good for every vote pattern, by expectation-maximisation.

    Each labeller's rate of bad votes, when it votes, is free among good and among
    bad texts; abstaining says nothing. It starts from bad wherever one labeller
    says so.
    """
    votes = patterns[:, None] // 3 ** np.arange(_LABELLERS) % 3
    cast, bad = votes != ABSTAIN, votes == BAD
    good = np.where(bad.any(1), 0.05, 0.95)
    for _ in range(ROUNDS):
        log = np.zeros((2, len(counts)))
        for k, mass in enumerate((counts * (1 - good), counts * good)):
            rate = (mass @ bad + 0.5) / (mass @ cast + 1)
            log[k] = np.log((mass.sum() + 1) / (counts.sum() + 2)) + bad @ np.log(rate) + (cast & ~bad) @ np.log(1 - rate)
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return dict(zip(patterns.tolist(), good.tolist(), strict=True))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, classes weighed alike, by Adam on all rows."""
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for r, (i, v) in enumerate(rows):
        x[r, i] = v
    y = target.astype(np.float32)
    mass = max(float(y.sum()), 1e-6), max(float((1 - y).sum()), 1e-6)
    weight = (y / mass[0] + (1 - y) / mass[1]).astype(np.float32) / 2
    w, b = np.zeros(DIMENSIONS, np.float32), 0.0
    m, s = np.zeros(DIMENSIONS + 1, np.float32), np.zeros(DIMENSIONS + 1, np.float32)
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
        grad = np.append(x.T @ error + 1e-6 * w, error.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-10)
        w, b = w - step[:-1].astype(np.float32), b - float(step[-1])
    return w, b


def _described(part: pa.RecordBatch, text: str) -> list[tuple[int, list[int], list[float]]]:
    return [describe(s, t) for s, t in zip(shapes(part.column(text)), part.column(text).to_pylist(), strict=True)]


def _sample(votes: DataFrame, rows: int) -> list[Row]:
    """hash, pattern, i, v of the different texts with words of the ``rows`` smallest hashes, in their order."""
    spoken = votes.where("size(i) > 0")
    share = 1.25 * rows / max(1, spoken.agg(F.approx_count_distinct("hash")).first()[0])
    while True:
        some = spoken if share >= 1 else spoken.where(F.col("hash") < int(share * 2**64) - 2**63)
        found = some.dropDuplicates(["hash", "pattern"]).collect()
        if share >= 1 or len(found) >= rows:
            return sorted(found, key=lambda r: (r.hash, r.pattern))[:rows]
        share *= 2


@kernels.any_names
def classify(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add posterior (of good, from the votes), score (the scorer's probability of good) and kept."""
    own = ["posterior", "score", "kept"]
    base = df.drop(*own)

    @kernels.trimmed
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, text):
                found = _described(part, text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, *_ in found], pa.int32()), part.column("hash"), pa.array([i for _, i, _ in found], pa.list_(pa.int16())), pa.array([v for *_, v in found], pa.list_(pa.float32()))], ["pattern", "hash", "i", "v"]
                )

    votes = base.select(F.col(text), F.xxhash64(text).alias("hash")).mapInArrow(vote, "pattern int, hash long, i array<smallint>, v array<float>")
    votes = scratch.write_out(votes, "votes")
    table = votes.groupBy("pattern").count().toPandas()
    posterior = estimate(table["pattern"].to_numpy(np.int64), table["count"].to_numpy(np.float64)) if len(table) else {}
    sample = _sample(votes, TRAIN_ROWS)
    weights, bias = fit([(np.array(r.i, np.int64), np.array(r.v, np.float32)) for r in sample], np.array([posterior[r.pattern] for r in sample]))
    weights = weights.astype(np.float64)

    @kernels.trimmed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, text):
                found = _described(part, text)
                p = np.array([1 / (1 + np.exp(-np.clip(weights[i] @ np.array(v) + bias, -30, 30))) if i else 0.0 for _, i, v in found])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([posterior.get(k, 0.5) for k, *_ in found], pa.float64()), pa.array(p, pa.float64()), pa.array(p >= threshold)], [*part.schema.names, *own])

    return base.mapInArrow(score, T.StructType([*base.schema, T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]))
