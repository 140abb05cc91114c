"""Stored distributions: exact ones, bucketed ones within their bound, splits, caps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import distribution, ecdf


def sample(seed=1, n=600):
    rng = np.random.default_rng(seed)
    return np.concatenate([np.round(rng.normal(0, 30, n), 1), rng.lognormal(1, 2, n), np.zeros(20), [-1e-13, 5.0, 5.0, 5.0]])


def frame(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k long, v double").withColumn("w", -F.col("v"))


def rank_cdf(x):
    """(average rank - 1) / (n - 1 + 1e-8) by counting."""
    x = np.asarray(x)
    return np.array([((x < v).sum() + ((x == v).sum() + 1) / 2 - 1) / (len(x) - 1 + 1e-8) for v in x])


def values(df, column):
    return np.array([r[0] for r in df.orderBy("k").select(column).collect()])


def test_exact_counts_are_the_rank_cdf(spark):
    x = sample()
    df = frame(spark, x)
    got = ecdf.looked_up(df, ecdf.counted(df, ["v", "w"]), {"v": "v", "w": "w"})
    assert np.allclose(values(got, "c_v"), rank_cdf(x), atol=1e-12) and np.allclose(values(got, "c_w"), rank_cdf(-x), atol=1e-12)


def test_between_and_beyond(spark):
    store = ecdf.counted(frame(spark, [1.0, 2.0, 4.0]), ["v"])
    probe = spark.createDataFrame([(0, 0.5), (1, 3.0), (2, 9.0), (3, None), (4, float("nan"))], "k long, v double")
    got = ecdf.looked_up(probe.withColumn("z", F.col("v")), store, {"v": "v", "z": "unknown"}).orderBy("k").collect()
    assert [r.c_v for r in got][:1] + [r.c_v for r in got][2:] == [0.0, 1.0, None, None] and abs(got[1].c_v - 0.75) < 1e-6
    assert all(r.c_z is None for r in got)


@pytest.mark.parametrize("accuracy", [0.5, 0.05, 0.001])
def test_buckets_keep_their_bound(spark, accuracy):
    x = sample(2)
    df = frame(spark, x)
    store = ecdf.counted(df, ["v"], accuracy=accuracy)
    held = store.collect()
    assert sum(r.n for r in held) == len(x) and all(r.high - r.low <= accuracy * max(abs(r.low), abs(r.high)) + 1e-12 for r in held)
    own = {r.bucket: r.n / len(x) for r in held}
    buckets = values(df.withColumn("b", ecdf.bucket_of(F.col("v"), accuracy)), "b")
    got = values(ecdf.looked_up(df, store, {"v": "v"}), "c_v")
    assert (np.abs(got - rank_cdf(x)) <= np.array([own[b] for b in buckets]) + 1e-9).all()


def test_long_curves_are_thinned(spark, monkeypatch):
    monkeypatch.setattr(ecdf, "POINTS", 50)
    x = sample(3)
    df = frame(spark, x)
    assert len(ecdf.curves(ecdf.counted(df, ["v"]))["v"][0]) <= 53
    assert np.abs(values(ecdf.looked_up(df, ecdf.counted(df, ["v"]), {"v": "v"}), "c_v") - rank_cdf(x)).max() <= 2 / 50


@pytest.mark.parametrize("sent", [50, 1 << 18])
def test_lookups_of_long_curves_are_exact(spark, monkeypatch, sent):
    monkeypatch.setattr(ecdf, "POINTS", 50)
    monkeypatch.setattr(ecdf, "SENT", sent)
    x = sample(3)
    df = frame(spark, x)
    got = ecdf.looked_up(df, ecdf.counted(df, ["v", "w"]), {"v": "v", "w": "w"})
    assert got.count() == len(x)
    assert (values(got, "c_v") == rank_cdf(x)).all() and (values(got, "c_w") == rank_cdf(-x)).all()


def test_joined_lookups_equal_sent_ones(spark, monkeypatch):
    x = sample(7)
    store = ecdf.capped(ecdf.counted(frame(spark, x), ["v", "w"], accuracy=0.3), 90.0, ["w"])
    probe = [*np.linspace(-200, 200, 801).tolist(), *x[:50].tolist(), 1e9, -1e9, float("inf"), float("-inf"), None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(probe)], "k long, v double").withColumns({"w": -F.col("v"), "z": F.col("v")})
    read = lambda: [tuple(r) for r in ecdf.looked_up(df, store, {"v": "v", "w": "w", "z": "unknown"}).orderBy("k").select("k", "c_v", "c_w", "c_z").collect()]
    sent = read()
    monkeypatch.setattr(ecdf, "SENT", 5)
    joined = read()
    assert len(sent) == len(joined) == len(probe)
    for a, b in zip(sent, joined, strict=True):
        assert a[0] == b[0] and all((p is None) == (q is None) and (p is None or abs(p - q) < 1e-12) for p, q in zip(a[1:], b[1:], strict=True))


def test_splits_merge_to_the_whole(spark, tmp_path):
    path, x = str(tmp_path / "store"), sample(4)
    df = frame(spark, x)
    for k in range(3):
        ecdf.write_split(ecdf.counted(df.where(F.col("k") % 3 == k), ["v"], accuracy=0.01), path, f"p{k}")
    rows = lambda d: sorted(tuple(r) for r in d.select("feature", "bucket", "n", "low", "high").collect())
    assert rows(ecdf.read_splits(spark, path)) == rows(ecdf.counted(df, ["v"], accuracy=0.01))
    ecdf.write_split(ecdf.counted(df.limit(5), ["v"], accuracy=0.01), path, "p1")
    assert ecdf.read_splits(spark, path, ["p1"]).agg(F.sum("n")).first()[0] == 5
    with pytest.raises(ValueError, match="p9"):
        ecdf.read_splits(spark, path, ["p9"])
    with pytest.raises(ValueError, match="no splits"):
        ecdf.read_splits(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("percent", [100.0, 97.5, 60.0])
def test_caps(spark, percent):
    x = sample(5)
    df = frame(spark, x)
    store = ecdf.capped(ecdf.counted(df, ["v", "w"]), percent, ["w"])
    kept = {"v": x[x <= np.percentile(x, percent)], "w": -x[(-x <= np.percentile(-x, percent)) & (-x >= np.percentile(-x, 100 - percent))]}
    for name, own in kept.items():
        held = store.where(F.col("feature") == name).collect()
        assert sorted((r.low, r.n) for r in held) == sorted((v, int((own == v).sum())) for v in set(own.tolist()))
    rough = ecdf.capped(ecdf.counted(df, ["v"], accuracy=0.001), percent).agg(F.sum("n"), F.max("high")).first()
    assert abs(rough[0] - len(kept["v"])) <= 3 and abs(rough[1] - kept["v"].max()) <= 0.01 * abs(kept["v"].max()) + 0.2


def test_quantiles_by_group(spark):
    x = sample(6)
    df = frame(spark, x).withColumn("g", F.when(F.col("k") % 3 > 0, F.col("k") % 3))
    got = {r.g: r for r in distribution.summary(df, "v", ["g"]).collect()}
    for g in (None, 1, 2):
        own = x[[k for k in range(len(x)) if k % 3 == (g or 0)]]
        assert np.allclose([got[g].min, got[g].q1, got[g].median, got[g].q3, got[g].max], np.percentile(own, [0, 25, 50, 75, 100])) and got[g].n == len(own)
    assert np.allclose(distribution.summary(df, "v").first().median, np.median(x))
    assert distribution.summary(df.where("k < 0"), "v").first().n == 0 and distribution.percentiles(df.where("k < 0"), "v", [0.5]).count() == 0


def test_empty(spark):
    df = frame(spark, [1.0]).where("k < 0")
    assert ecdf.curves(ecdf.counted(df, ["v"])) == {} and ecdf.looked_up(df, ecdf.counted(df, ["v"]), {"v": "v"}).count() == 0
