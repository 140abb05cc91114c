"""Spectral encodings of windows: spectrograms and Fourier magnitudes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tapered_cosine(n: int, share: float = 0.25) -> np.ndarray:
    """Tukey window, periodic."""
    if n < 2:
        return np.ones(n)
    x = np.arange(n) / n
    edge = np.minimum(x, 1 - x) * 2 / share
    return np.where(edge < 1, 0.5 * (1 - np.cos(np.pi * np.minimum(edge, 1))), 1.0)


def spectrogram(series: np.ndarray, rate: float = 1.0, segment: int = 10, overlap: int = 5, scaling: str = "spectrum") -> np.ndarray:
    """(frequencies, segments) of |FFT| of mean-free tapered segments: magnitudes over the taper's sum ('spectrum') or the root of its power ('density')."""
    n = min(segment, len(series))
    step = n - min(overlap, len(series) // 2)
    taper = tapered_cosine(n)
    starts = range(0, len(series) - n + 1, step)
    parts = np.stack([series[s : s + n] for s in starts])
    spectrum = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * taper, axis=1))
    return (spectrum / (taper.sum() if scaling == "spectrum" else np.sqrt(rate * (taper**2).sum()))).T


def log_spectrogram(series: np.ndarray, **options) -> np.ndarray:
    """log(1 + spectrogram) of sign(x) log(1 + |x|)."""
    return np.log1p(spectrogram(np.sign(series) * np.log1p(np.abs(series)), **options))


def fourier(image: np.ndarray) -> np.ndarray:
    """Log magnitude of the centred 2-D Fourier transform of a mean-free image."""
    return np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(image - image.mean()))))


def scaled(matrix: np.ndarray, low: float, high: float) -> np.ndarray:
    """Clipped to the bounds, stretched to [0, 1], frequencies upward."""
    return np.flipud(np.clip((matrix - low) / max(high - low, 1e-8), 0, 1))


def stacked(windows: DataFrame, transform: Callable[[np.ndarray], np.ndarray], columns: Sequence[str], least: int = 8) -> DataFrame:
    """Add rows, cols and for each column cells_<column> (row by row): the transform of each window's series; windows of under ``least`` points are dropped."""
    kept = [c for c in windows.columns if c != "points"]
    schema = T.StructType([*(windows.schema[c] for c in kept), T.StructField("rows", T.IntegerType()), T.StructField("cols", T.IntegerType()), *(T.StructField(f"cells_{c}", T.ArrayType(T.DoubleType())) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("points")
            ends = np.cumsum(points.value_lengths().to_numpy(zero_copy_only=False))[:-1]
            made = [[transform(x) for x in np.split(points.flatten().field(c).to_numpy(zero_copy_only=False).astype(float), ends)] for c in columns]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([m.shape[k] for m in made[0]], pa.int32()) for k in (0, 1)), *(pa.array([m.ravel() for m in own], pa.list_(pa.float64())) for own in made)], schema.names)

    return windows.where(F.size("points") >= least).mapInArrow(run, schema)


def matrices(windows: DataFrame, transform: Callable[[np.ndarray], np.ndarray], column: str, least: int = 8) -> DataFrame:
    """As ``stacked`` for one column, with cells."""
    return stacked(windows, transform, [column], least).withColumnRenamed(f"cells_{column}", "cells")


def pixel_images(side: int) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    """Gives a batch's images, 1 at the pixels (an array of qx, qy) of each row, 0 elsewhere."""

    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held = batch.column("pixels")
        x, y = (held.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("qx", "qy"))
        ends = np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        for qx, qy in zip(np.split(x, ends), np.split(y, ends), strict=True):
            image = np.zeros((side, side))
            image[qy, qx] = 1.0
            yield image

    return of


def image_bounds(rows: DataFrame, images: Callable[[pa.RecordBatch], Iterator[np.ndarray]], by: Sequence[str] = ()) -> DataFrame:
    """(by, global_min, global_max, n): extremes over all cells of all images of a split, and the images' number.

    Each batch gives one row a split, so cells never become rows.
    """
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, tuple[int, float, float, int]] = {}  # by key: its first row, extremes, images
            keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True) if by else [()] * batch.num_rows
            for row, (key, image) in enumerate(zip(keys, images(batch), strict=True)):
                first, low, high, n = seen.get(key, (row, np.inf, -np.inf, 0))
                seen[key] = first, min(low, float(image.min())), max(high, float(image.max())), n + 1
            first, *ends = (pa.array([v[i] for v in seen.values()], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.int64())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in by), *ends], schema.names)

    return rows.mapInArrow(run, schema).groupBy(*by).agg(F.min("low").alias("global_min"), F.max("high").alias("global_max"), F.sum("n").alias("n"))


def scaled_images(rows: DataFrame, images: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> DataFrame:
    """Add h, w and cells (row by row): the images between their row's global_min and global_max, clipped, frequencies upward."""
    schema = T.StructType([*rows.schema, T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("cells", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = zip(batch.column("global_min").to_pylist(), batch.column("global_max").to_pylist(), strict=True)
            made = [scaled(image, low, high) for image, (low, high) in zip(images(batch), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m.shape[k] for m in made], pa.int32()) for k in (0, 1)), pa.array([m.ravel() for m in made], pa.list_(pa.float64()))], schema.names)

    return rows.mapInArrow(run, schema)


def global_bounds(made: DataFrame, by: Sequence[str] = (), percents: tuple[float, float] | None = None) -> DataFrame:
    """(by, global_min, global_max, n) over all cells: extremes, or a pair of percentiles; equal ones are set 1 apart."""
    cells = made.select(*by, F.explode("cells").alias("v"))
    low, high = (F.min("v"), F.max("v")) if percents is None else (F.percentile("v", F.lit(percents[0] / 100)), F.percentile("v", F.lit(percents[1] / 100)))
    out = cells.groupBy(*by).agg(low.alias("global_min"), high.alias("global_max"), F.count("*").alias("n"))
    return out.withColumn("global_max", F.when(F.col("global_max") > F.col("global_min"), F.col("global_max")).otherwise(F.col("global_min") + 1))
