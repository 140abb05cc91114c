import random

import numpy as np
from pyspark.sql import functions as F

from trajspark.llm import registry, weak_quality


def test_shapes():
    import pyarrow as pa

    got = weak_quality.shapes(pa.array(["Über ABC12*** a-b\n\n X", "", None, "zz", "aa!!"]))
    assert got == [b"aAa"[0:1] + b" A0*** a-a A", b"", b"", b"a", b"a!!"] or got[0].split() == [b"a", b"A0***", b"a-a", b"A"]
    assert got[1:] == [b"", b"", b"a", b"a!!"]


def test_estimate_recovers_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.7
    miss = np.array([0.05, 0.1, 0.2, 0.1, 0.3, 0.05, 0.2, 0.1])
    votes = np.where(rng.random((20000, 8)) < miss, ~truth[:, None], truth[:, None]).astype(int)
    votes[rng.random((20000, 8)) < 0.2] = weak_quality.ABSTAIN
    code = (votes * 3 ** np.arange(8)).sum(1)
    patterns, counts = np.unique(code, return_counts=True)
    good = weak_quality.estimate(patterns, counts.astype(float))
    assert np.mean([(good[c] > 0.5) == t for c, t in zip(code.tolist(), truth.tolist(), strict=True)]) > 0.95


def test_odd_rows(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    clean = [" ".join(word() for _ in range(80)) + "." for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(clean)] + [(100, None, None), (101, "", "y"), (102, "$$$ *** ### " * 50, "z"), (102, "$$$ *** ### " * 50, "z"), (None, clean[0], "w")]
    got = weak_quality.classify(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    assert got.columns == ["doc_id", "text", "posterior", "score", "kept"]
    kept = [(r.doc_id, r.kept) for r in got.collect()]
    assert len(kept) == len(rows) and all(k == (i is None or i < 100) for i, k in kept)
    assert weak_quality.classify(got.limit(0)).count() == 0


def test_copies_of_one_text_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(weak_quality, "TRAIN_ROWS", 60)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    clean = [" ".join(word() for _ in range(80)) + "." for _ in range(200)]
    junk = [" ".join(rng.choice(["$$$", "***", "###", "<|>"]) + word()[:1] for _ in range(90)) for _ in range(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    first = df.where("doc_id < 200").orderBy(F.xxhash64("text")).first().text
    rows = df.unionByName(spark.range(1000, 1300).select(F.col("id").alias("doc_id"), F.lit(first).alias("text")))
    kept = {r.doc_id: r.kept for r in weak_quality.classify(rows).collect()}
    assert len(kept) == 600 and all(k == (i < 200 or i >= 1000) for i, k in kept.items())
    votes = df.unionByName(rows).select(F.xxhash64("text").alias("hash"), F.lit(0).alias("pattern"), F.array(F.lit(1)).alias("i"), F.array(F.lit(1.0)).alias("v"))
    want = sorted({r.hash for r in votes.collect()})
    for n in (1, 60, 299, 300, 400):
        assert [r.hash for r in weak_quality._sample(votes, n)] == want[:n]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in registry.QUERIES["op4_weak_quality"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good, bad = ([got[i] for i, q in labels.items() if q == k] for k in (1, 0))
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.15
