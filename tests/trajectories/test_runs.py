"""Runs by folds: stopped and continued, refused where they don't fit, evaluated anew from stored scores."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import scoring
from trajspark.sources import runs

SIZES = range(1, 4)


def scored(spark, asked=None):
    def run(k):
        if asked is not None:
            asked.append(k)
        df = spark.range(240).select((F.col("id") % 3).alias("target"), F.floor(F.col("id") / 24).alias("session"), F.col("id").alias("idx"), F.lit("more").alias("other"))
        return df.withColumns({"label": (F.col("session") % 2).cast("long"), "score": F.round(F.abs(F.sin(F.col("idx") * (k + 1))) + 0.3 * (F.col("session") % 2), 3)})

    return run


def go(spark, path, asked=None, **more):
    return runs.run_folds(spark, path, scored(spark, asked), **({"source": "made", "folds": 3, "sizes": SIZES} | more))


def rows(df):
    return sorted(map(tuple, df.select("fold", "target", "n", "eer", "auc", "threshold").collect()))


def test_a_stopped_run_goes_on(spark, tmp_path):
    whole, path, asked = str(tmp_path / "whole"), str(tmp_path / "run"), []
    assert go(spark, whole) == [0, 1, 2]
    assert go(spark, path, asked, at_most=2) == [0, 1]
    assert go(spark, path, asked) == [2] and asked == [0, 1, 2]
    assert go(spark, path, asked) == [] and asked == [0, 1, 2]
    assert rows(runs.per_target(spark, path)) == rows(runs.per_target(spark, whole))


def test_a_fold_that_was_cut_off_is_done_again(spark, tmp_path):
    path, asked = tmp_path / "run", []
    go(spark, str(path))
    want = rows(runs.per_target(spark, str(path)))
    (path / "curves" / "fold=2" / "_SUCCESS").unlink()
    assert runs.finished(spark, str(path)) == [0, 1]
    assert {r[0] for r in rows(runs.per_target(spark, str(path)))} == {0, 1}
    assert go(spark, str(path), asked) == [2] and asked == [2]
    assert rows(runs.per_target(spark, str(path))) == want


def test_a_run_that_does_not_fit_is_refused(spark, tmp_path):
    path = tmp_path / "run"
    go(spark, str(path))
    for other in ({"source": "else"}, {"folds": 4}, {"session": ("target",)}):
        with pytest.raises(ValueError, match="begun with"):
            go(spark, str(path), **other)
    shutil.rmtree(path / "curves" / "fold=1")
    with pytest.raises(ValueError, match="before them"):
        go(spark, str(path))


def test_an_empty_run_has_no_result(spark, tmp_path):
    go(spark, str(tmp_path / "run"), at_most=0)
    with pytest.raises(ValueError, match="no finished fold"):
        runs.per_target(spark, str(tmp_path / "run"))


def test_evaluated_anew(spark, tmp_path):
    few, more = str(tmp_path / "few"), str(tmp_path / "more")
    go(spark, few, sizes=[1])
    go(spark, more)
    assert rows(runs.reevaluated(spark, few, SIZES)) == rows(runs.per_target(spark, more))
    means = {(r.fold, r.n): r.avg_eer for r in runs.summary(runs.per_target(spark, more)).collect()}
    own = [r for r in rows(runs.per_target(spark, more)) if r[0] == 1 and r[2] == 2]
    assert means[1, 2] == pytest.approx(sum(r[3] for r in own) / 3) and len(means) == 9


def test_places(spark, tmp_path):
    for name in ("a/x", "b/x", "c/20240101_000000", "c/20240301_120000", "c/last", "c/event9/rows", "c/event125/rows", "d/rows"):
        (tmp_path / name).mkdir(parents=True)
    a, b, c, d = (str(tmp_path / n) for n in "abcd")
    assert runs.resolve(spark, "/absent", a) == "/absent" and runs.resolve(spark, "hdfs://n/x", a) == "hdfs://n/x"
    assert runs.resolve(spark, "x", c, b, a) == f"{b}/x"
    with pytest.raises(FileNotFoundError):
        runs.resolve(spark, "y", a, b)
    assert runs.latest(spark, c) == f"{c}/20240301_120000"
    with pytest.raises(FileNotFoundError):
        runs.latest(spark, a)
    assert runs.store_in(spark, d) == d and runs.store_in(spark, c) == f"{c}/event125"
    assert runs.store_in(spark, c, ["event30", "event9"]) == f"{c}/event9"
    with pytest.raises(FileNotFoundError):
        runs.store_in(spark, a)


def test_fusion_of_groups_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK", 5)
    rng = np.random.default_rng(5)
    rows = [(t, s, i, round(float(rng.random()), 2), int(rng.random() < 0.4)) for t, s, m in (("a", 1, 700), ("a", 2, 3), ("b", None, 90), (None, 4, 61)) for i in rng.permutation(m).tolist()]
    df = spark.createDataFrame(rows, "target string, session long, idx long, score double, label long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, path = scoring.numbered(df, ["target", "session"], ["idx"])
        assert all(r.idx == r["_k"] for r in placed.collect()) and placed.count() == len(rows)
        ids = spark.read.parquet(path).withColumn("r", F.shiftright("_id", 33)).groupBy("r").count().collect()
        assert len(ids) > 2 and max(r["count"] for r in ids) < 700
        got = {(r.target, r.n): (r.eer, r.auc, r.threshold) for r in scoring.fusion_curve(df, ["target"], ["session"], ["idx"], [1, 2, 3, 7, 12]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for n in (1, 2, 3, 7, 12):
        plain = scoring.equal_error(scoring.fuse(df, ["target", "session"], n, ["idx"]), ["target"]).collect()
        assert len(plain) == sum(k[1] == n for k in got)
        for r in plain:
            assert np.allclose(got[(r.target, n)], (r.eer, r.auc, r.threshold), atol=1e-9)


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scoring, "RANGE", 100)
    rows = [(t, i, (i * 7 % 11) / 10, i % 3 % 2) for t, m in ((None, 3), ("a", 700), ("b", 97)) for i in range(m)]
    df = spark.createDataFrame(rows, "target string, idx long, score double, label long").repartition(5)
    placed, path = scoring.numbered(df, ["target"], ["idx"])
    assert all(r.idx == r["_k"] for r in placed.collect()) and placed.count() == 800
    ids = spark.read.parquet(path).groupBy(F.shiftright("_id", 33)).count().collect()
    assert len(ids) > 5 and max(r["count"] for r in ids) < 250
