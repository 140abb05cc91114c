import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from trajspark.llm import backoff_lm


def plain(texts, order):
    docs = [brute.words(t) for t in texts]
    grams = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in docs]
    total = sum(grams, Counter())
    n = sum(map(len, docs))
    out = []
    for w, own in zip(docs, grams, strict=True):
        rest = lambda g: total[g] - own[g]  # noqa: E731,B023
        score = 0.0
        for i in range(len(w)):
            factor = 1.0
            for k in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - k + 1 : i + 1])
                if k == 1:
                    score += math.log(factor * (rest(gram) or 0.5) / max(n - len(w), 0.5))
                elif rest(gram):
                    score += math.log(factor * rest(gram) / rest(gram[:-1]))
                    break
                factor *= backoff_lm.ALPHA
        out.append((len(w), score))
    return out


@pytest.mark.parametrize(("order", "chunk"), [(1, 1 << 20), (2, 300), (3, 300), (4, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, order, chunk):
    monkeypatch.setattr(backoff_lm, "CHUNK_BYTES", chunk)
    rng = random.Random(order)
    texts = [" ".join(rng.choice(["a", "B", "c", "dé", "E"]) for _ in range(rng.randrange(30))) for _ in range(40)] + ["", None, "only", "a a\ta\na", "x " * 500]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(3, texts[3], "copy"), (None, "a b", None)]
    got = backoff_lm.score(spark.createDataFrame(rows, "doc_id long, text string, n_words string"), order=order)
    assert got.columns == ["doc_id", "text", "n_words", "log_score", "mean_log_score"]
    want = plain([t for _, t, _ in rows], order)
    found = sorted(((r.doc_id, r.text, r.n_words, r.log_score) for r in got.collect()), key=str)
    for (i, t, n, s), (j, u, m, p) in zip(found, sorted(((r[0], r[1], *x) for r, x in zip(rows, want, strict=True)), key=str), strict=True):
        assert (i, t, n) == (j, u, m) and s == pytest.approx(p, abs=1e-9)


def test_empty_table(spark):
    assert backoff_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pack():
    x = np.array([0, 1, 2**63, 12345], np.uint64)
    assert backoff_lm.unpack(backoff_lm.pack(x), np.uint64).tolist() == x.tolist()


def test_keys_have_64_bits():
    words = np.random.default_rng(0).integers(0, 2**63, 4000, dtype=np.uint64)
    keys = np.concatenate([h for _, h in backoff_lm.ngrams(words, np.array([4000]), 3)])
    assert keys.max() >= 2**63 and backoff_lm.unpack(backoff_lm.pack(keys), np.uint64).tolist() == keys.tolist()
    ranges = backoff_lm._range_of(np.sort(keys), 7)
    assert (np.diff(ranges.astype(int)) >= 0).all() and set(ranges.tolist()) == set(range(7))
