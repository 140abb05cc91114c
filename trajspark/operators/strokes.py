"""Rasters as rows: strokes turned into pixels, so a sequence of any length is never one array.

Events carry px and py, their places on a square (see ``raster.screen_place`` and others),
and the colour of the stroke that ends at them. A stroke visits a pixel for every step
along its longer axis; of strokes that meet in a pixel the latest one stays, which is an
aggregation that combines before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators.sequence import ordered

# Ten colours of the palette "plasma", evenly spaced, as red, green, blue.
PLASMA = (
    (13, 8, 135),
    (70, 3, 159),
    (114, 1, 168),
    (156, 23, 158),
    (189, 55, 134),
    (216, 87, 107),
    (237, 121, 83),
    (251, 159, 58),
    (253, 202, 38),
    (240, 249, 33),
)


def padded_place(df: DataFrame, by: Sequence[str], side: int, pad: float = 0.05) -> DataFrame:
    """Add px and py: the sequence's box, at least 1 by 1 and widened by ``pad`` of itself on all sides, in the middle of the square."""
    w = Window.partitionBy(*by)
    low = {c: F.min(c).over(w) for c in "xy"}
    span = {c: F.greatest(F.max(c).over(w) - low[c], F.lit(1.0)) for c in "xy"}
    whole = {c: F.max(c).over(w) - low[c] + 2 * pad * span[c] for c in "xy"}
    scale = F.least(*(side / whole[c] for c in "xy"))
    return df.withColumns({f"p{c}": (F.col(c) - low[c] + pad * span[c]) * scale + (side - whole[c] * scale) / 2 for c in "xy"})


def pixels(df: DataFrame, by: Sequence[str], side: int, colour: Sequence[str], *, thickness: int = 1, cut: bool = False) -> DataFrame:
    """(by, qx, qy, colour): the pixels that the sequences' strokes leave, each with the last stroke's colour.

    Ends of strokes are whole pixels, the nearest ones (halves to even) or with ``cut``
    those that places lie in. A sequence of one event has no stroke. Thick strokes
    fill discs of ``thickness // 2`` around their pixels.
    """
    whole = (lambda c: F.col(c).cast("long")) if cut else (lambda c: F.rint(c).cast("long"))
    w = ordered(by)
    ends = df.select(*by, "seq", *colour, whole("px").alias("bx"), whole("py").alias("by_"))
    own = ends.withColumns({"ax": F.lag("bx").over(w), "ay": F.lag("by_").over(w)}).where("ax IS NOT NULL")
    own = own.withColumn("_n", F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by_") - F.col("ay"))))
    steps = own.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    along = lambda a, b: F.rint(F.col(a) + (F.col(b) - F.col(a)) * F.col("_k") / F.greatest("_n", F.lit(1))).cast("long")
    out = steps.select(*by, "seq", *colour, along("ax", "bx").alias("qx"), along("ay", "by_").alias("qy"))
    r = thickness // 2
    if r:
        disc = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]
        out = out.withColumn("_o", F.explode(F.array(*disc))).withColumns({"qx": F.col("qx") + F.col("_o.a"), "qy": F.col("qy") + F.col("_o.b")}).drop("_o")
    inside = out.where(F.col("qx").between(0, side - 1) & F.col("qy").between(0, side - 1))
    return inside.groupBy(*by, "qx", "qy").agg(F.max_by(F.struct(*colour), "seq").alias("c")).select(*by, "qx", "qy", "c.*")


def nearest_byte(c: Column) -> Column:
    """A share of [0, 1] as the nearest whole number up to 255, halves to even."""
    return F.least(F.greatest(F.rint(c * 255), F.lit(0)), F.lit(255)).cast("long")


def cut_byte(c: Column) -> Column:
    """A share of [0, 1] as a whole number up to 255, cut down."""
    return F.least(F.greatest((c * 255).cast("long"), F.lit(0)), F.lit(255))


def palette(c: Column, colours: Sequence[tuple[int, int, int]] = PLASMA) -> tuple[Column, Column, Column]:
    """Bytes of the colours at shares of [0, 1], linear between the evenly spaced ``colours``, cut down."""
    last = len(colours) - 1
    at = F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * last
    i = F.least(F.floor(at), F.lit(last - 1)).cast("int")

    def channel(k: int) -> Column:
        table = F.array(*(F.lit(float(x[k])) for x in colours))
        return (F.get(table, i) + (F.get(table, i + 1) - F.get(table, i)) * (at - i)).cast("long")

    return channel(0), channel(1), channel(2)


def colours(kind: str) -> dict[str, Column]:
    """r, g, b of the stroke that ends at an event, from the ECDF values c_v, c_vx, c_vy and c_dt that a kind needs.

    'plain': black; 'speed': (0, v, v); 'velocity': (0, vx, vy); 'plasma': a palette by
    v; 'grey' and 'interval': 0.8 of v and of the time since the event before, as grey;
    'two': (vx, vy, 0); 'three': (vx, vy, time).
    """
    zero = F.lit(0).cast("long")
    grey = lambda c: (cut_byte(0.8 * F.col(c)),) * 3
    kinds = {
        "plain": lambda: (zero, zero, zero),
        "speed": lambda: (zero, nearest_byte(F.col("c_v")), nearest_byte(F.col("c_v"))),
        "velocity": lambda: (zero, nearest_byte(F.col("c_vx")), nearest_byte(F.col("c_vy"))),
        "plasma": lambda: palette(F.col("c_v")),
        "grey": lambda: grey("c_v"),
        "interval": lambda: grey("c_dt"),
        "two": lambda: (cut_byte(F.col("c_vx")), cut_byte(F.col("c_vy")), zero),
        "three": lambda: (cut_byte(F.col("c_vx")), cut_byte(F.col("c_vy")), cut_byte(F.col("c_dt"))),
    }
    return dict(zip("rgb", kinds[kind](), strict=True))
