import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trajspark.llm import quality_rules, registry


def plain(text):
    w = brute.SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if brute.SPACED.search(x)]
    at: dict = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


ODD = [None, "", " \n\t ", "a", "a b", "a b c", "a a a a", "x\r\ny\x0bz\x0c", "é😀# *", "a\n\na\n a\na", "s <|> s <|> s <|> s", "\x1c   x"]


def test_statistics_equal_brute_force(spark, sf):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("abcdefgh"[: rng.randrange(2, 8)]) for _ in range(rng.randrange(200))) for _ in range(40)] + ["w%d " % i * 40 + "q\n" * i for i in range(5)]
    texts += [" ".join(str(i % 700) for i in range(3000))] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.statistics(df).collect():
        assert tuple(r)[1:] == plain(texts[r.doc_id]), texts[r.doc_id]


def test_outliers_of_each_group_go(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        w = [rng.choice("bcdfgkl") + "".join(rng.choice("aeioubcd") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(80, 400))]
        kind = i % 13 == 0
        rows.append((i, " ".join(x + "***" * kind for x in w), ["en", "de", None][i % 3], "hot" if i % 2 else f"s{i % 40}", kind))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bad boolean")
    got = {r.doc_id: r.kept for r in quality_rules.rate(df.withColumn("kept", F.lit(1))).collect()}
    assert all(not got[i] for i, *_, bad in rows if bad) and sum(got[i] for i, *_, bad in rows if not bad) >= 545


def test_least_determinant_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(5, 5)) * 0.6
    x = np.concatenate([rng.normal(size=(400, 5)) @ mix, rng.normal(size=(60, 5)) * 0.3 + 9, rng.normal(size=(30, 5)) * 4])
    rows = spark.createDataFrame([("p", *map(float, r)) for r in x], "pool string, " + ", ".join(f"x_{i} double" for i in range(5)))
    fit = quality_rules.least_determinant(rows, True).collect()
    assert len(fit) == 1
    floor = np.diag(np.array(quality_rules.FLOORS) ** 2)

    def refit(part):
        return part.mean(0), quality_rules.CONSISTENCY * np.cov(part.T, bias=True) + floor

    def square(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    best = None
    for _ in range(200):
        m, c = refit(x[rng.choice(len(x), 12, replace=False)])
        for _ in range(30):
            m, c = refit(x[np.argsort(square(m, c))[: int(np.ceil(quality_rules.SUPPORT * len(x)))]])
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c
    assert fit[0].logdet == pytest.approx(best[0], abs=0.15)
    got = quality_rules._distances(rows, spark.createDataFrame(fit), True).toPandas().sort_values("x_0")["distance"].to_numpy()
    want = np.sqrt(square(*best[1:]))[np.argsort(x[:, 0])]
    assert ((got > quality_rules.CUTOFF) == (want > quality_rules.CUTOFF)).mean() > 0.99 and np.allclose(got, want, rtol=0.15)


def test_empty_and_null(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_rules.rate(df).count() == 0
    one = spark.createDataFrame([(None, None, None, None), (1, "w" * 9 + " ", "x", None), (1, " ".join(f"w{i}" for i in range(60)), None, None)], df.schema)
    assert sorted((r.n_words, r.base_failed, r.kept) for r in quality_rules.rate(one).collect()) == [(0, True, False), (1, True, False), (60, False, True)]


def test_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    names = ["_t", "pool", "_kept", "_fine", "a.b", "x_0", "bin", "start"]
    df = spark.createDataFrame([(1, text, "en", "s", *range(8)), (2, text, "en", "s", *range(8))], ["doc_id", "text", "lang", "source", *names])
    got = quality_rules.rate(df.withColumn("n_words", F.lit(-1)), keep=["doc_id", *names, "n_words"])
    assert got.columns == ["doc_id", *names, "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    assert [tuple(r)[1:9] + (r.n_words,) for r in got.collect()] == [(*range(8), 60)] * 2
    assert quality_rules.statistics(df, keep=names).select(*(f"`{n}`" for n in names)).first() == tuple(range(8))


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "ab cd# " * 200_000, "en", "s")], "doc_id long, text string, lang string, source string")
    r = quality_rules.rate(df).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words, r.base_failed) == (400_000, 1_000_000, 200_000, 400_000, True)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = registry.QUERIES["op7_robust_outliers"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, lines, repeats = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.base_failed and r.kept)
    good = [r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in got if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
