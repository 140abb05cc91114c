"""Worked values of the operators, on hand-made rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import scalars
from trajspark.operators import bounds, clean, distribution, encodings, kinematics, losses, raster, recurrence, scoring, sequence, spectral


def path(spark, points, session="s"):
    return spark.createDataFrame([(session, i, float(t), float(x), float(y)) for i, (x, y, t) in enumerate(points)], "s string, seq long, time double, x double, y double")


def column(df, name, order="seq"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_speed_and_acceleration(spark):
    df = path(spark, [(0, 0, 0), (3, 4, 1), (3, 4, 1), (9, 12, 3)])
    assert column(kinematics.speed(df, ["s"]), "v") == [0, 5, 0, 5]
    assert column(kinematics.speed(df, ["s"], "copy"), "v") == [5, 5, 0, 5]
    assert column(kinematics.speed(df, ["s"], "drop"), "v") == [None, 5, 0, 5]
    assert column(kinematics.acceleration(df, ["s"]), "a") == pytest.approx([0, 5, -500000, 2.5])
    assert column(kinematics.component_acceleration(df, ["s"]), "ax") == pytest.approx([0, 0, -300000, 1.5])


def test_curvature_and_turns(spark):
    df = path(spark, [(0, 0, 0), (1, 0, 1), (1, 1, 2)])
    assert column(kinematics.curvature(df, ["s"]), "kappa") == pytest.approx([1.414213522] * 3, abs=1e-8)
    omega = column(kinematics.angular_velocity(df, ["s"]), "omega")
    assert omega == pytest.approx([0, math.pi / 2, math.pi / 2])
    assert column(kinematics.node_interval(path(spark, [(0, 0, 0), (0, 0, 2), (0, 0, 5)]), ["s"]), "dt_next") == [2, 3, 3]


def test_gap_split_is_strict(spark):
    df = path(spark, [(0, 0, t) for t in (0, 0.5, 1.5, 2.6)])
    assert column(sequence.gap_split(df, ["s"], 1.0), "sequence_id") == [0, 0, 0, 1]


def test_greedy_merge_counts_bridges(spark):
    arcs = [0, 4, 7, 11, 12, 13, 20, 21]
    df = path(spark, [(a, 0, i) for i, a in enumerate(arcs)]).withColumn("sequence_id", F.floor(F.col("seq") / 2))
    got = sequence.greedy_merge(df, ["s"], F.max(F.lit(10.0)))
    assert column(got, "group_id") == [0, 0, 0, 0, 1, 1, 1, 1]


def test_windows(spark):
    ten, nine, three = (path(spark, [(i, 0, i) for i in range(n)]) for n in (10, 9, 3))
    size = lambda df: sorted(r["count"] for r in df.groupBy("window_id").count().collect())
    assert size(sequence.tumbling(ten, ["s"], 4)) == [4, 4]
    assert size(sequence.tumbling(ten, ["s"], 4, ragged=True)) == [2, 4, 4]
    assert size(sequence.tumbling(nine, ["s"], 4, ragged=True)) == [4, 4]
    assert size(sequence.sliding(ten, ["s"], 4, 1)) == [4] * 7
    assert size(sequence.tumbling(three, ["s"], 4)) == [] and size(sequence.sliding(three, ["s"], 4, 1)) == []
    assert size(sequence.tumbling(three, ["s"], 4, ragged=True)) == [3]


@pytest.mark.parametrize(("n", "cuts"), [(13, [2, 3, 2, 3, 3]), (10, [2] * 5), (3, [0, 1, 0, 1, 1])])
def test_folds(spark, n, cuts):
    folds = column(sequence.folds(path(spark, [(0, 0, i) for i in range(n)]), ["s"]), "fold")
    assert [folds.count(k) for k in range(5)] == cuts


def test_ecdf_and_lookup(spark):
    e = distribution.global_ecdf(spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 3.0)], "v double"), "v")
    assert column(e, "cdf", "value") == pytest.approx([0, 0.4999999983, 0.9999999967], abs=1e-9)
    x = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (9.0,)], "x double")
    assert column(distribution.ecdf_lookup(x, "x", e), "cdf", "x") == pytest.approx([0, 0, 0.2499999992, 0.4999999983, 1], abs=1e-9)


def test_caps_and_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 10), 100]], "v double")
    assert column(distribution.iqr_cap(df, "v"), "v", "v") == list(range(1, 10))
    flat = spark.createDataFrame([(5.0,)] * 4, "v double")
    assert distribution.iqr_cap(flat, "v").count() == 4 and distribution.histogram(flat, "v", 3).collect()[0].n == 4
    assert column(distribution.percentile_cap(df, "v", 90), "v", "v") == list(range(1, 10))
    assert [r.n for r in distribution.histogram(df.where("v < 10"), "v", 4).orderBy("bin").collect()] == [2, 2, 2, 3]


def test_recurrence(spark):
    df = path(spark, [(0, 0, 0), (3, 4, 1), (6, 8, 2)]).withColumns({"window_id": F.lit(0), "pos": F.col("seq")})
    p = recurrence.stretched(recurrence.clipped(df, ["s"]), ["s"])
    rows = {(r.i, r.j): (r.d, r.pixel) for r in p.collect()}
    assert [rows[0, k] for k in range(3)] == [(0, 0), (pytest.approx(0.625), 159), (1, 255)]
    still = path(spark, [(1, 1, 0), (1, 1, 1)]).withColumns({"window_id": F.lit(0), "pos": F.col("seq")})
    assert {r.d for r in recurrence.clipped(still, ["s"]).collect()} == {0.0}
    first = recurrence.previous_difference(recurrence.clipped(df, ["s"]), ["s"])
    assert {r["diff"] for r in first.collect()} == {None}


def test_fusion(spark):
    rows = [("A", 0, 0.1, 1), ("A", 1, 0.3, 1), ("A", 2, 0.5, 1), ("B", 0, 0.9, 0), ("B", 1, 0.7, 0), ("C", 0, 0.2, 0), ("C", 1, 0.4, 1)]
    df = spark.createDataFrame(rows, "session string, i long, score double, label long")
    got = {r.session: (r.score, r.label) for r in scoring.fuse(df, ["session"], 2, ["i"]).collect()}
    assert got == {"A": (pytest.approx(0.2), 1), "B": (pytest.approx(0.8), 0), "C": (pytest.approx(0.3), 0)}


@pytest.mark.parametrize(
    ("labels", "scores", "auc", "eer"),
    [([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75, 0.5), ([0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.5], 1.0, 0.0), ([0, 0, 1, 1], [0.5] * 4, 0.5, 0.5), ([0, 0, 0, 0, 1, 1, 1], [0.1, 0.3, 0.5, 0.7, 0.4, 0.6, 0.9], 0.75, 1 / 3), ([1, 1, 1], [0.1, 0.2, 0.3], 1.0, 0.0)],
)
def test_equal_error(spark, labels, scores, auc, eer):
    df = spark.createDataFrame([("u", float(s), y) for s, y in zip(scores, labels, strict=True)], "u string, score double, label long")
    r = scoring.equal_error(df, ["u"]).first()
    assert (r.auc, r.eer) == (pytest.approx(auc), pytest.approx(eer))
    assert scoring.equal_error(df.drop("u")).first().eer == pytest.approx(eer)
    assert r.threshold == 0.5 if len(set(labels)) == 1 else r.threshold in scores


@pytest.mark.parametrize(("starts", "covered"), [([0, 100], 200), ([0, 50, 300], 250)])
def test_interval_cover(spark, starts, covered):
    df = spark.createDataFrame([("k", s, s + 99) for s in starts], "k string, l long, r long")
    assert scoring.interval_cover(df, ["k"], "l", "r").first().covered == covered


@pytest.mark.parametrize(("x", "y", "size"), [(1919, 1079, (1919, 1079)), (1983, 1151, (2559, 1439)), (1023, 767, (1023, 767)), (5000, 100, (3839, 2159))])
def test_standard_resolution(spark, x, y, size):
    r = bounds.standard_resolution(spark.createDataFrame([(float(x), float(y))], "max_x double, max_y double")).first()
    assert (r.norm_width, r.norm_height) == size


def test_natural_order_names_and_bounds(spark):
    df = spark.createDataFrame([("user15",), ("User7",), ("user12",), ("user9",)], "u string")
    assert [r.u for r in df.orderBy(scalars.natural_key(F.col("u"))).collect()] == ["User7", "user9", "user12", "user15"]
    names = spark.createDataFrame([("session_3-240.png",), ("abc.png",), ("a-b.png",)], "n string")
    session, start = scalars.sample_name(F.col("n"))
    assert [tuple(r) for r in names.select(session, start).collect()] == [("session_3", 240), ("abc", 0), ("a", 0)]
    t = path(spark, [(5, 6, 0)], "absent")
    r = bounds.with_bounds(t, bounds.user_bounds(path(spark, [(1, 2, 0)]), ["s"]), ["s"]).first()
    assert (r.max_x, r.max_y, r.min_x, r.min_y) == (1919, 1079, 0, 0)


@pytest.mark.parametrize(
    ("dataset", "header", "rows"),
    [
        ("balabit", ["client timestamp", "x", "y", "state"], [("1.0", "5", "6", "Move"), ("1.5", "5", "6", "Drag"), ("1.0", "5", "6", "Move"), ("2", "65535", "1", "Move"), ("3", "oops", "1", "Move"), (None, "7", "7", "Move")]),
        ("chaoshen", ["Timestamp", "X", "Y", "EventName"], [("1", "5", "6", "Move"), ("1", "5", "6", "Up"), ("1", "5", "6", "Move"), ("2", "65535", "1", "Move"), ("3", "oops", "1", "Move"), (None, "7", "7", "Move")]),
        ("dfl", [" Client Timestamp", "X ", "y", "State"], [("1", "5", "6", "MOVE"), ("1", "5", "6", "up"), ("1", "5", "6", "MOVE"), ("2", "65535", "1", "move"), ("3", "oops", "1", "move"), (None, "7", "7", "move")]),
        ("twos", ["timestamp", "x", "y", "event"], [("1", "5", "6", "Mouse Moved"), ("1", "5", "6", "Click"), ("1", "5", "6", "Mouse Moved"), ("2", "65535", "1", "Mouse Moved"), ("3", "oops", "1", "Mouse Moved"), (None, "7", "7", "Mouse Moved")]),
    ],
)
def test_clean(spark, dataset, header, rows):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], ", ".join(["s string", "seq long", *(f"`{h}` string" for h in header)]))
    got = clean.clean(df, dataset, ["s"]).collect()
    assert [(r.seq, r.time, r.x, r.y) for r in got] == [(0, 1.0, 5.0, 6.0)]
    assert clean.clean(df, dataset, ["s"], dedup=False).count() == 2
    assert clean.clean(df, dataset, ["s"], max_coord=None).count() == 2
    with pytest.raises(ValueError, match="unknown dataset"):
        clean.clean(df, "other", ["s"])


def test_losses(spark):
    df = spark.createDataFrame([("u", 0.9, 1), ("u", 0.2, 0), ("u", 0.4, 0), ("u", 0.6, 1)], "u string, score double, label long")
    y, p = np.array([1, 0, 0, 1]), np.array([0.9, 0.2, 0.4, 0.6])
    want = np.mean(-(y / 0.5 * np.log(p + 1e-6) + (1 - y) / 0.5 * np.log(1 - p + 1e-6)))
    assert losses.weighted_bce(df).first().loss == pytest.approx(want)
    g, ce = np.abs(p - y), -(y * np.log(p) + (1 - y) * np.log(1 - p))
    logits = df.withColumn("logit", F.log(F.col("score") / (1 - F.col("score"))))
    assert losses.harmonised_bce(logits, ["u"], 0.1501).first().loss == pytest.approx(np.mean(4 / ((np.abs(g[:, None] - g[None]) <= 0.1501).sum(1) / 0.1501 + 1e-12) * ce))
    certain = spark.createDataFrame([("u", 800.0, 0), ("u", -800.0, 1), ("u", 0.0, 1)], "u string, logit double, label long")
    assert losses.harmonised_bce(certain, ["u"], 0.1).first().plain == pytest.approx((1600 + np.log(2)) / 3)
    many = spark.range(50).withColumn("label", (F.col("id") % 10 == 0).cast("long"))
    assert {r.label: r["count"] for r in losses.balance(many).groupBy("label").count().collect()} == {0: 45, 1: 45}
    assert 20 < losses.split(many, ["id"]).where("is_train").count() < 50


def test_images_and_spectra(spark):
    line = raster.polyline(np.array([[0.0, 0.0], [7.0, 7.0]]), 8)[:, :, 0]
    assert np.array_equal(line, np.eye(8))
    assert np.allclose(raster.resize(np.arange(16.0).reshape(4, 4), 2, "area"), [[2.5, 4.5], [10.5, 12.5]])
    assert raster.resize(np.eye(3), 3, "linear").tolist() == np.eye(3).tolist() == raster.resize(np.eye(3), 3).tolist()
    assert raster.heat(np.array([[2.0, 2.0], [9.0, 9.0]]), 12).max() == 1
    wave = np.sin(2 * np.pi * np.arange(200) / 5)
    assert spectral.spectrogram(wave)[:, 5].argmax() == 2 and spectral.spectrogram(wave, scaling="density").shape == (6, 39)
    flat = spectral.fourier(np.ones((4, 4)))
    assert np.allclose(flat, 0) and spectral.scaled(np.array([[0.0], [2.0]]), 0, 2).tolist() == [[1.0], [0.0]]
    df = path(spark, [(i, i % 3, i) for i in range(20)]).withColumns({"window_id": F.lit(0), "pos": F.col("seq")})
    w = raster.gather(df, ["s", "window_id"], ["x", "y"])
    r = raster.render(w, lambda p: raster.polyline(raster.centred(p, 16), 16), ["x", "y"]).first()
    assert (r.h, r.w, r.channels, len(r.pixels)) == (16, 16, 1, 256)
    b = spectral.global_bounds(spectral.matrices(w, spectral.log_spectrogram, "x")).first()
    assert b.global_min < b.global_max and b.n == 6 * 3


def test_png():
    pixels = bytes(range(24))
    file = raster.png(pixels, 2, 4, 3)
    assert file[:8] == b"\x89PNG\r\n\x1a\n" and file[16:26] == bytes([0, 0, 0, 4, 0, 0, 0, 2, 8, 2])
    start = file.index(b"IDAT")
    size = int.from_bytes(file[start - 4 : start], "big")
    rows = zlib.decompress(file[start + 4 : start + 4 + size])
    assert rows[1:13] + rows[14:] == pixels and rows[0] == rows[13] == 0


def _matrices(df, value="d"):
    out = {}
    for r in df.collect():
        out.setdefault(r.window_id, {})[r.i, r.j] = r[value]
    size = {w: max(i for i, _ in m) + 1 for w, m in out.items()}
    return {w: np.array([[m[i, j] for j in range(size[w])] for i in range(size[w])]) for w, m in out.items()}


def test_kernels_by_hand(spark):
    rng = np.random.default_rng(5)
    points = rng.integers(0, 40, (2, 8, 2)).astype(float)
    df = spark.createDataFrame([("u", w, i, float(i), *map(float, points[w, i])) for w in (0, 1) for i in range(8)], "u string, window_id long, pos long, time double, x double, y double")
    dist = np.sqrt(((points[:, :, None] - points[:, None]) ** 2).sum(-1))
    off = ~np.eye(8, dtype=bool)
    low, high = dist[:, off].min(), dist[:, off].max()
    got = _matrices(recurrence.bounded_gate(df, ["u"], 0.4))
    for w in (0, 1):
        d = (dist[w] - low) / (high - low + 1e-8)
        near = (d.sum(1) - np.diag(d)) / 7 <= 0.4
        assert np.allclose(got[w], np.where(near[:, None] & near, np.minimum(d, 0.4), 0.4))
    got = _matrices(recurrence.half_triangles(df, ["u"], 8), "value")
    for w in (0, 1):
        d = dist[w] / (dist[w].max() + 1e-8)
        d = np.where(d > d.mean(), 0.3, d)
        assert np.allclose(got[w], np.triu(d[:4, :4], 1) + np.tril(d[4:, 4:], -1))
    spread = (points - points.min(1, keepdims=True)) / np.maximum((points.max(1) - points.min(1)).max(1), 1e-8)[:, None, None]
    near = np.minimum(np.sqrt(((spread[:, :, None] - spread[:, None]) ** 2).sum(-1)), 1)
    cells = {(r.window_id, r.a, r.b, r.i, r.j): r.value for r in recurrence.grid_of_pairs(df, ["u"], 8, 4).collect()}
    for (w, a, b, i, j), value in cells.items():
        byte = lambda k, m=near[w]: int((m[2 * k + i, 2 * k + j] - m.min()) / (m.max() - m.min()) * 255)  # noqa: B023, E731
        assert value == (byte(b) if i < j else byte(a) if i > j or a == b else 0)
    e = df.withColumns({"f": F.col("x") / 40, "h": F.col("y") / 40})
    got = encodings.halves(e, ["u"], 8, lambda x, by: recurrence.pairs(x, by).withColumn("d", F.col("d") / 100), "f", "h")
    r, g = _matrices(got, "r"), _matrices(got, "g")
    for w in (0, 1):
        assert np.allclose(r[w], np.minimum(np.triu(dist[w][4:, 4:] / 100) + np.tril(dist[w][:4, :4] / 100), 1))
        f = points[w, :, 0] / 40
        assert np.allclose(g[w], np.where(np.arange(4)[:, None] < np.arange(4), f[4:], f[:4]))


@pytest.mark.parametrize("strict", [True, False])
def test_gates_inside_rows_equal_gates_over_pairs(spark, strict):
    rows = [("u", w, k, float((7 * k * k + 3 * w) % 11), float((5 * k + w) % 7) if (w, k) != (2, 1) else None) for w, n in ((0, 5), (1, 5), (2, 4), (3, 1)) for k in range(n)]
    df = spark.createDataFrame([(*r, 10 * r[2]) for r in rows], "k string, window_id long, pos long, x double, y double, more long")
    plain = recurrence.mean_gate(recurrence.pairs(df, ["k"]).withColumn("d", F.col("d") / 2), ["k"], 2.5, strict=strict)
    own = recurrence.gated_pairs(df, ["k"], 2.5, lambda d: d / 2, strict=strict)
    read = lambda d: sorted((r.window_id, r.i, r.j, r.i_more, r.j_more, bool(r.recurrent), -1.0 if r.d is None else round(r.d, 9)) for r in d.collect())
    assert set(own.columns) == set(plain.columns) and read(own) == read(plain)
    plan = recurrence.bounded_gate(df, ["k"], 0.3, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan


def test_tasks_of_intervals_stay_small(spark, monkeypatch):
    monkeypatch.setattr(scoring, "COVERED", 50)
    df = spark.range(3000).selectExpr("id % 100 AS k", "id * 7 % 500 AS l", "id * 7 % 500 + id % 9 AS r")
    got = scoring.interval_cover(df, ["k"], "l", "r")
    assert got.rdd.getNumPartitions() == 60
    held: dict = {}
    for r in df.collect():
        held.setdefault(r.k, set()).update(range(r.l, r.r + 1))
    assert {r.k: r.covered for r in got.collect()} == {k: len(v) for k, v in held.items()}


def test_paths_drawn_together_equal_paths_drawn_apart():
    rng = np.random.default_rng(3)
    lengths = np.array([8, 1, 3, 8, 2])
    xy, values = rng.random((22, 2)) * 40 - 4, rng.integers(1, 255, (17, 3)).astype(np.uint8)
    images = raster.polylines(xy, lengths, 32, values, 2)
    assert images.shape == (5, 32, 32, 3) and not images[1].any()
    edge, ends = np.cumsum(lengths) - lengths, np.cumsum(np.maximum(lengths - 1, 0))
    for p in range(5):
        plain = np.zeros((32, 32, 3), np.uint8)
        for i in range(lengths[p] - 1):
            (x0, y0), (x1, y1) = xy[edge[p] + i], xy[edge[p] + i + 1]
            for t in np.linspace(0, 1, int(2 * max(abs(x1 - x0), abs(y1 - y0))) + 2):
                for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)):
                    qx, qy = int(np.rint(x0 + (x1 - x0) * t)) + a, int(np.rint(y0 + (y1 - y0) * t)) + b
                    if 0 <= qx < 32 and 0 <= qy < 32:
                        plain[qy, qx] = values[ends[p] - lengths[p] + 1 + i]
        assert np.array_equal(images[p], plain)
        alone = raster.centred(xy[edge[p] : edge[p] + lengths[p]], 32)
        assert np.array_equal(raster.centred_all(xy, lengths, 32)[edge[p] : edge[p] + lengths[p]], alone)
