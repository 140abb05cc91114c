"""Rasters of trajectories, and images from matrices, in numpy over Arrow batches.

Each function of a window is row-local: a row holds one window's points as an
array, so nothing is shuffled and memory follows the batch.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pixel(c: Column, extent: Column | float, span: int) -> Column:
    """Index of the pixel of a coordinate on an axis of ``span`` pixels, halves to even."""
    return F.least(F.greatest(F.rint(c / extent * (span - 1)), F.lit(0)), F.lit(span - 1)).cast("long")


def occupancy(df: DataFrame, by: Sequence[str], width: Column | float, height: Column | float, side: int) -> DataFrame:
    """(by, px, py, n): events per pixel."""
    return df.groupBy(*by, pixel(F.col("x"), width, side).alias("px"), pixel(F.col("y"), height, side).alias("py")).agg(F.count("*").alias("n"))


def gather(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a window: by and ``points``, the columns' values in order of pos."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("points"))


def centred(xy: np.ndarray, side: int, pad: float = 0.05) -> np.ndarray:
    """Points scaled alike on both axes into a square with a margin, the box in its middle."""
    low, high = xy.min(0), xy.max(0)
    scale = side * (1 - 2 * pad) / max(float((high - low).max()), 1e-8)
    return (xy - (low + high) / 2) * scale + side / 2


def on_screen(xy: np.ndarray, side: int, width: float, height: float) -> np.ndarray:
    """Points of a screen scaled into a square, its aspect kept, bars on the short axis."""
    scale = side / max(width, height)
    return xy * scale + (side - np.array([width, height]) * scale) / 2


def screen_place(df: DataFrame, width: Column | float, height: Column | float, side: int, *, how: str = "fit") -> DataFrame:
    """Add px and py: places on a square of ``side`` pixels.

    'fit': the screen's longer axis fills the square, bars on the shorter; 'width': its
    width does, no margin. Screens may be a user's (extents from its bounds, x and y
    shifted by their least values before) or one for all.
    """
    w, h = (c if isinstance(c, Column) else F.lit(float(c)) for c in (width, height))
    scale = side / (F.greatest(w, h) if how == "fit" else w)
    bar = lambda extent: (side - extent * scale) / 2 if how == "fit" else F.lit(0.0)
    return df.withColumns({"px": F.col("x") * scale + bar(w), "py": F.col("y") * scale + bar(h)})


def boxed_place(df: DataFrame, by: Sequence[str], side: int, pad: float = 0.05) -> DataFrame:
    """Add px and py: the window's box in the middle of the square, scaled alike on both axes, with a margin."""
    w = Window.partitionBy(*by)
    low, high = ({c: f(c).over(w) for c in "xy"} for f in (F.min, F.max))
    scale = side * (1 - 2 * pad) / F.greatest(high["x"] - low["x"], high["y"] - low["y"], F.lit(1e-8))
    return df.withColumns({f"p{c}": (F.col(c) - (low[c] + high[c]) / 2) * scale + side / 2 for c in "xy"})


def recentred_place(df: DataFrame, by: Sequence[str], width: Column | float, height: Column | float, side: int) -> DataFrame:
    """Add px and py: the window's box moved to the middle of its screen, the screen's scale kept."""
    w = Window.partitionBy(*by)
    extents = {"x": width, "y": height}
    moved = df.withColumns({f"_{c}": F.col(c) for c in "xy"}).withColumns({c: F.col(c) - (F.min(c).over(w) + F.max(c).over(w)) / 2 + extents[c] / 2 for c in "xy"})
    return screen_place(moved, width, height, side).drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})


def polyline(xy: np.ndarray, side: int, values: np.ndarray | None = None, thickness: float = 1.0) -> np.ndarray:
    """Image (side, side, channels) of the path; segments carry ``values``; later ones cover earlier ones.

    Segments are sampled every half pixel; points of a thick line fill discs.
    """
    values = np.ones((max(0, len(xy) - 1), 1)) if values is None else values
    return polylines(xy, np.array([len(xy)]), side, values.astype(np.float32), thickness)[0]


def polylines(xy: np.ndarray, lengths: np.ndarray, side: int, values: np.ndarray, thickness: float = 1.0) -> np.ndarray:
    """``polyline`` of many paths at once: images (paths, side, side, channels) of the type of ``values``.

    xy: the points of all paths, ``lengths`` of each; values: a row for each segment, path after path.
    """
    image = np.zeros((len(lengths), side, side, values.shape[1]), values.dtype)
    path = np.repeat(np.arange(len(lengths)), lengths)
    first = np.flatnonzero(path[1:] == path[:-1])
    if not len(first):
        return image
    start, step = xy[first], xy[first + 1] - xy[first]
    n = (2 * np.abs(step).max(1)).astype(np.int64) + 2
    segment = np.repeat(np.arange(len(first)), n)
    k = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    t = np.where(k == n[segment] - 1, 1.0, k * (1 / (n - 1))[segment])[:, None]
    px, py = np.rint(start[segment] + step[segment] * t).astype(np.int64).T
    r = int(thickness // 2)
    disc = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r] or [(0, 0)]
    # the last segment in a pixel stays; of equal pixels numpy's maximum counts every one
    top = np.zeros(len(lengths) * side * side, np.int32)
    base = path[first][segment] * (side * side)
    for a, b in disc:
        qx, qy = px + a, py + b
        ok = (qx >= 0) & (qx < side) & (qy >= 0) & (qy < side)
        np.maximum.at(top, (base + qy * side + qx)[ok], segment[ok].astype(np.int32) + 1)
    drawn = np.flatnonzero(top)
    image.reshape(-1, values.shape[1])[drawn] = values[top[drawn] - 1]
    return image


def centred_all(xy: np.ndarray, lengths: np.ndarray, side: int, pad: float = 0.05) -> np.ndarray:
    """``centred`` of many paths at once; none is empty."""
    edge = np.cumsum(lengths) - lengths
    low, high = np.minimum.reduceat(xy, edge), np.maximum.reduceat(xy, edge)
    scale = side * (1 - 2 * pad) / np.maximum((high - low).max(1), 1e-8)
    return (xy - np.repeat((low + high) / 2, lengths, 0)) * np.repeat(scale, lengths)[:, None] + side / 2


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur with edge values repeated."""
    r = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(image, [(r, r) if a == axis else (0, 0) for a in range(image.ndim)], mode="edge")
        image = sum(w * np.take(padded, range(i, i + image.shape[axis]), axis) for i, w in enumerate(k))
    return image


def heat(xy: np.ndarray, side: int, sigma: float = 2.0) -> np.ndarray:
    """Blurred path on a log scale with peak 1."""
    image = np.log1p(blur(polyline(xy, side)[:, :, 0].astype(np.float64), sigma))
    return image / max(image.max(), 1e-8)


def resize(matrix: np.ndarray, side: int, how: str = "nearest") -> np.ndarray:
    """Square image of a matrix: nearest cell, linear between cells, or mean of the area."""
    h, w = matrix.shape[:2]
    if how == "nearest":
        return matrix[np.arange(side) * h // side][:, np.arange(side) * w // side]
    if how == "area":
        weights = [np.maximum(0, np.minimum(np.arange(1, n + 1)[None], (np.arange(side) + 1)[:, None] * n / side) - np.maximum(np.arange(n)[None], np.arange(side)[:, None] * n / side)) * side / n for n in (h, w)]
        return np.tensordot(weights[1], np.tensordot(weights[0], matrix, (1, 0)), (1, 1)).swapaxes(0, 1)
    at = [np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1) for n in (h, w)]
    rows = np.stack([np.interp(at[0], np.arange(h), matrix[:, c]) for c in range(w)], 1)
    return np.stack([np.interp(at[1], np.arange(w), rows[r]) for r in range(side)], 0)


def to_bytes(image: np.ndarray) -> bytes:
    """A [0, 1] image as bytes, row by row, fractions cut."""
    return np.clip(image * 255, 0, 255).astype(np.uint8).tobytes()


def png(pixels: bytes, h: int, w: int, channels: int) -> bytes:
    """A PNG file of grey (one channel) or RGB bytes (three)."""
    rows = np.frombuffer(pixels, np.uint8).reshape(h, w * channels)
    body = zlib.compress(np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[channels], 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def with_png(images: DataFrame) -> DataFrame:
    """Rendered images with a column png in place of pixels."""
    kept = [c for c in images.columns if c != "pixels"]
    schema = T.StructType([*(images.schema[c] for c in kept), T.StructField("png", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [png(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("pixels", "h", "w", "channels")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(files, pa.binary())], schema.names)

    return images.mapInArrow(run, schema)


def render_png(windows: DataFrame, draw: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: Sequence[str], at_once: int = 256) -> DataFrame:
    """Add h, w, channels and png: draw(matrix of the columns, points of each window) gives the byte images of ``at_once`` windows.

    What is drawn goes into its file in the same pass, so no raw image leaves the task.
    """
    kept = [c for c in windows.columns if c != "points"]
    schema = T.StructType([*(windows.schema[c] for c in kept), T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("png", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, at_once) for b in batches for i in range(0, b.num_rows, at_once)):
            points = batch.column("points")
            flat = points.flatten()
            matrix = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
            images = draw(matrix, points.value_lengths().to_numpy(zero_copy_only=False))
            shape = images.shape[1:]
            files = [png(i.tobytes(), *shape) for i in images]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(np.full(len(files), x), pa.int32()) for x in shape), pa.array(files, pa.binary())], schema.names)

    return windows.mapInArrow(run, schema)


def render(windows: DataFrame, draw: Callable[[np.ndarray], np.ndarray], columns: Sequence[str]) -> DataFrame:
    """Add h, w, channels and pixels: draw(matrix of the columns) for the row's points."""
    kept = [c for c in windows.columns if c != "points"]
    schema = T.StructType([*(windows.schema[c] for c in kept), T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("pixels", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("points")
            flat = points.flatten()
            matrix = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
            images = [draw(m) for m in np.split(matrix, np.cumsum(points.value_lengths().to_numpy(zero_copy_only=False))[:-1])]
            images = [i if i.ndim == 3 else i[:, :, None] for i in images]
            shape = [pa.array([i.shape[k] for i in images], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *shape, pa.array([to_bytes(i) for i in images], pa.binary())], schema.names)

    return windows.mapInArrow(run, schema)
