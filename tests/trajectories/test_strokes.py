"""Strokes as pixel rows: hand-worked paths and a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from trajspark.operators import strokes


def drawn(spark, points, side=10, **options):
    df = spark.createDataFrame([("u", i, float(x), float(y), c) for i, (x, y, c) in enumerate(points)], "user string, seq long, px double, py double, c long")
    return {(r.qx, r.qy): r.c for r in strokes.pixels(df, ["user"], side, ["c"], **options).collect()}


def plain(points, side, r=0):
    out = {}
    for (x0, y0, _), (x1, y1, c) in zip(points, points[1:], strict=False):
        x0, y0, x1, y1 = map(round, (x0, y0, x1, y1))
        n = max(abs(x1 - x0), abs(y1 - y0))
        for k in range(n + 1):
            x, y = round(x0 + (x1 - x0) * k / max(n, 1)), round(y0 + (y1 - y0) * k / max(n, 1))
            for a in range(-r, r + 1):
                for b in range(-r, r + 1):
                    if a * a + b * b <= r * r and 0 <= x + a < side and 0 <= y + b < side:
                        out[x + a, y + b] = c
    return out


def test_straight_and_diagonal(spark):
    got = drawn(spark, [(0, 0, 9), (3, 0, 1), (3, 3, 2), (1, 1, 3)])
    assert got == {(0, 0): 1, (1, 0): 1, (2, 0): 1, (3, 0): 2, (3, 1): 2, (3, 2): 2, (3, 3): 3, (2, 2): 3, (1, 1): 3}


def test_points_outside_and_single_events(spark):
    assert drawn(spark, [(-2, 4, 0), (2, 4, 5)]) == {(0, 4): 5, (1, 4): 5, (2, 4): 5}
    assert drawn(spark, [(4, 4, 1)]) == {} and drawn(spark, []) == {}
    assert drawn(spark, [(4, 4, 1), (4, 4, 2)]) == {(4, 4): 2}


@pytest.mark.parametrize("thickness", [1, 2, 5])
def test_equals_a_plain_loop(spark, thickness):
    rng = random.Random(thickness)
    points = [(rng.uniform(-3, 33), rng.uniform(-3, 33), k) for k in range(40)]
    assert drawn(spark, points, 30, thickness=thickness) == plain(points, 30, thickness // 2)


def test_ends_cut(spark):
    assert drawn(spark, [(0.9, 1.9, 0), (2.9, 1.2, 7)], cut=True) == {(0, 1): 7, (1, 1): 7, (2, 1): 7}


def test_padded_place(spark):
    df = spark.createDataFrame([("u", 2.0, 5.0), ("u", 12.0, 5.0), ("v", 3.0, 3.0)], "user string, x double, y double")
    got = {(r.user, r.x): (round(r.px, 9), round(r.py, 9)) for r in strokes.padded_place(df, ["user"], 22).collect()}
    # a box of 10 by 0: widened to 11 by 0.1, so two pixels a unit; the height is in the middle
    assert got["u", 2.0] == (1.0, 11.0) and got["u", 12.0] == (21.0, 11.0)
    assert got["v", 3.0] == (11.0, 11.0)


def test_palette_and_bytes(spark):
    shares = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (-1.0,), (2.0,), (1 / 9,)], "c double")
    got = [tuple(r) for r in shares.select(*strokes.palette(F.col("c"))).collect()]
    middle = tuple(int((a + b) / 2) for a, b in zip(strokes.PLASMA[4], strokes.PLASMA[5], strict=True))
    assert got == [strokes.PLASMA[0], strokes.PLASMA[-1], middle, strokes.PLASMA[0], strokes.PLASMA[-1], strokes.PLASMA[1]]
    assert [tuple(r) for r in shares.select(strokes.nearest_byte(F.col("c")), strokes.cut_byte(F.col("c"))).collect()] == [(0, 0), (255, 255), (128, 127), (0, 0), (255, 255), (28, 28)]


def test_bounds_of_spectra_over_a_split(spark):
    import numpy as np

    from trajspark.operators import spectral

    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], [(int(x), int(y)) for x, y in rng.integers(0, 12, (5 + i % 7, 2))]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, split string, pixels array<struct<qx:int,qy:int>>").repartition(5)

    def magnitudes(batch):
        return map(spectral.fourier, spectral.pixel_images(12)(batch))

    got = {r.split: (r.global_min, r.global_max, r.n) for r in spectral.image_bounds(df, magnitudes, ["split"]).collect()}
    want = {}
    for _, split, points in rows:
        image = np.zeros((12, 12))
        for x, y in points:
            image[y, x] = 1
        want.setdefault(split, []).append(np.log1p(np.abs(np.fft.fft2(image - image.mean()))))
    for split, own in want.items():
        assert np.allclose(got[split], (np.min(own), np.max(own), len(own)))
    whole = spectral.image_bounds(df, magnitudes).first()
    assert whole.n == 60 and np.allclose(whole.global_max, max(np.max(o) for o in want.values()))
    assert spectral.image_bounds(df.where("k < 0"), magnitudes, ["split"]).count() == 0


def test_short_series_overlap_by_half_their_length():
    import numpy as np

    from trajspark.operators import spectral

    # 8 points: one segment of 8; 9 points: one of 9 (steps of 5, as half of 9 is 4); 20 points: segments of 10, steps of 5
    assert [spectral.spectrogram(np.arange(float(n))).shape for n in (8, 9, 20)] == [(5, 1), (5, 1), (6, 3)]
    assert spectral.spectrogram(np.arange(12.0), segment=8, overlap=7).shape == (5, 3)
