"""Verification metrics: score fusion, ROC, AUC, equal error rate, precision and recall.

Scores are rows (keys, score, label). Curves are built from counts per distinct
score, which combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark import shared

TINY = 1e-6
#: Rows that are sorted and numbered in a task, about.
RANGE = 1 << 19
#: Rows in order that are fused at a time, at most; blocks over the edge of two such parts meet in a shuffle.
CHUNK = 1 << 16
#: Intervals that a task sorts, about.
COVERED = 1 << 19


def fuse(df: DataFrame, by: Sequence[str], n: int, order: Sequence[str], *, narrow: bool = True) -> DataFrame:
    """(by, block, score, label): means of n consecutive scores inside each group; incomplete blocks are dropped.

    The label is the mean's nearest whole number, halves to even; ``narrow`` rounds
    fused scores to 32 bits.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("block", F.floor((F.row_number().over(w) - 1) / n).cast("long"))
    out = rows.groupBy(*by, "block").agg(F.avg("score").alias("score"), F.rint(F.avg("label")).cast("long").alias("label"), F.count("*").alias("_n")).where(F.col("_n") == n).drop("_n")
    return out.withColumn("score", F.col("score").cast("float").cast("double")) if narrow else out


def roc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, k, threshold, fpr, tpr): a point per distinct score, from the highest on, and (0, 0) with an infinite threshold at k = 0."""
    counts = df.groupBy(*by, "score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum(1 - F.col("label").cast("long")).alias("q"))
    w, whole = Window.partitionBy(*by).orderBy(F.desc("score")), Window.partitionBy(*by)
    points = counts.select(
        *by,
        F.row_number().over(w).cast("long").alias("k"),
        F.col("score").cast("double").alias("threshold"),
        F.try_divide(F.sum("q").over(w), F.sum("q").over(whole)).alias("fpr"),
        F.try_divide(F.sum("p").over(w), F.sum("p").over(whole)).alias("tpr"),
    )
    start = counts.select(*by).distinct() if by else counts.limit(1).select()
    return points.union(start.select(*by, F.lit(0).cast("long"), F.lit(float("inf")), F.lit(0.0), F.lit(0.0)))


def auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, auc): share of (positive, negative) pairs in order, ties half; 1 if a class is missing."""
    counts = df.groupBy(*by, "score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum(1 - F.col("label").cast("long")).alias("q"))
    w = Window.partitionBy(*by).orderBy("score")
    below = F.sum("q").over(w) - F.col("q")
    won = counts.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    total = F.sum("p") * F.sum("q")
    return won.groupBy(*by).agg(F.when(total > 0, F.sum("won") / total).otherwise(1.0).alias("auc"))


def equal_error(df: DataFrame, by: Sequence[str] = (), *, fold: bool = True, single: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(by, eer, auc, threshold) of every group.

    eer: the false positive rate where the ROC line meets 1 - fpr = tpr. threshold:
    of the ROC corner nearest to that line. ``fold`` mirrors rates beyond chance.
    Groups of one class get ``single`` and the threshold 0.5.
    """
    keys = list(by) or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(1))
    return _equal_error(_counts(df, keys), keys, fold, single).select(*by, "eer", "auc", "threshold")


def _counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, score, p, q, m): positives, negatives and rows of each distinct score."""
    label = F.col("label").cast("long")
    return df.groupBy(*keys, "score").agg(F.sum(label).alias("p"), F.sum(1 - label).alias("q"), F.count("*").alias("m"))


def _equal_error(counts: DataFrame, keys: Sequence[str], fold: bool = True, single: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """``equal_error`` from counts, in one pass over them."""
    w, whole = Window.partitionBy(*keys).orderBy(F.desc("score")), Window.partitionBy(*keys)
    curve = counts.select(
        *keys,
        "p",
        "q",
        F.row_number().over(w).cast("long").alias("k"),
        F.col("score").cast("double").alias("threshold"),
        F.sum("q").over(w).alias("_fp"),
        F.sum("p").over(w).alias("_tp"),
        *(F.sum(c).over(whole).alias(f"_{c}") for c in "pqm"),
    ).withColumns({"fpr": F.try_divide("_fp", "_q"), "tpr": F.try_divide("_tp", "_p")})
    first = F.col("k") == 1  # the point before it is (0, 0)
    before = lambda c: F.when(first, 0.0).otherwise(F.lag(c).over(w.orderBy("k")))
    ahead = curve.withColumns({"f2": F.lead("fpr").over(w.orderBy("k")), "t2": F.lead("tpr").over(w.orderBy("k")), "f0": before("fpr"), "t0": before("tpr")})

    def crossing(k: Column, f: Column, t: Column, f2: Column, t2: Column) -> Column:
        g, g2 = 1 - f - t, 1 - f2 - t2
        return F.when((g >= 0) & (g2 <= 0) & ((g > 0) | (g2 < 0)), F.struct(k.alias("k"), F.when(f2 == f, f).otherwise(f + (f2 - f) * g / (g - g2)).alias("e")))

    points = {c: F.col(c) for c in ("f0", "t0", "fpr", "tpr", "f2", "t2")}
    start = F.when(first, crossing(F.lit(0).cast("long"), points["f0"], points["t0"], points["fpr"], points["tpr"]))
    own = crossing(F.col("k"), points["fpr"], points["tpr"], points["f2"], points["t2"])
    bend = (F.col("f2") - F.col("fpr")) * (F.col("tpr") - F.col("t0")) != (F.col("t2") - F.col("tpr")) * (F.col("fpr") - F.col("f0"))
    corner = F.when(F.coalesce(bend, F.lit(True)), F.struct(F.round(F.abs(1 - F.col("fpr") - F.col("tpr")), 12).alias("gap"), "k", "threshold"))
    won = F.col("p") * (F.col("_q") - F.col("_fp") + F.col("q") / 2)
    found = ahead.groupBy(*keys).agg(F.min(F.coalesce(start, own))["e"].alias("e"), F.min(corner)["threshold"].alias("t"), F.sum(won).alias("_won"), *(F.max(f"_{c}").alias(f"_{c}") for c in "pqm"))
    both = (F.col("_p") > 0) & (F.col("_p") < F.col("_m"))
    out = found.withColumn("auc", F.when(F.col("_p") * F.col("_q") > 0, F.col("_won") / (F.col("_p") * F.col("_q"))).otherwise(1.0))
    e, a = F.coalesce("e", F.lit(0.5)), F.col("auc")
    if fold:
        e, a = F.least(e, 1 - e), F.greatest(a, 1 - a)
    return out.select(*keys, F.when(both, e).otherwise(single[0]).alias("eer"), F.when(both, a).otherwise(single[1]).alias("auc"), F.when(both, F.coalesce("t", F.lit(0.5))).otherwise(0.5).alias("threshold"))


def at_threshold(df: DataFrame, threshold: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, tp, fp, fn, tn, precision, recall, f1, accuracy): scores from the threshold on are positive."""
    yes, pos = F.col("score") >= threshold, F.col("label") == 1
    out = df.groupBy(*by).agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(~yes & ~pos).alias("tn"))
    out = out.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp") + TINY), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + TINY)})
    return out.withColumns({"f1": 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + TINY), "accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, str]:
    """The rows with _k, their place from 0 on in their group by ``order``, and the folder they are read from.

    Rows are dealt by ranges of (by, order) of about ``RANGE`` rows and numbered inside a
    range as they are written; the group that begins a range continues from the ranges
    before. So rows are shuffled once and no group meets in one task.
    """
    spark = df.sparkSession
    path = shared.new_path(spark, "numbered")
    n = max(spark.sparkContext.defaultParallelism, -(-df.count() // RANGE))
    dealt = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_id", F.monotonically_increasing_id())
    rows = shared.written(_placed(dealt, by), path).withColumn("_range", F.shiftright("_id", 33))
    # of each range its first and last group, and the rows that the last has in it
    edges = rows.groupBy("_range").agg(F.min_by(F.struct(*by), "_id").alias("a"), F.max_by(F.struct(F.struct(*by).alias("g"), (F.col("_j") + 1).alias("n")), "_id").alias("b"))
    ends = edges.select("_range", F.explode(F.array(F.struct(F.col("a").alias("g"), F.lit(0).cast("long").alias("n")), "b")).alias("e")).groupBy("e.g", "_range").agg(F.sum("e.n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("_range")) - F.col("n")
    offsets = ends.withColumn("_before", before).where("_before > 0").select(*(F.col("g")[c].alias(f"_g_{c}") for c in by), F.col("_range").alias("_r"), "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    out = rows.join(F.broadcast(offsets), [*same, F.col("_range") == F.col("_r")], "left")
    return out.withColumn("_k", F.col("_j") + F.coalesce("_before", F.lit(0))).select(*df.columns, "_k", "_id"), path


def _placed(dealt: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows with _j, their place from 0 on in the run of rows of their group that their partition has."""
    kept = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows - 1, bool)
            for c in by:  # null equals null
                x, y = batch.column(c)[1:], batch.column(c)[:-1]
                new |= pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False) | (x.is_null().to_numpy(zero_copy_only=False) != y.is_null().to_numpy(zero_copy_only=False))
            first = [batch.column(c)[0].as_py() for c in by]
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            sizes = np.diff(np.append(starts, batch.num_rows))
            place = np.arange(batch.num_rows) - np.repeat(starts, sizes)
            if first == last:
                place[: sizes[0]] += done
            last, done = [batch.column(c)[batch.num_rows - 1].as_py() for c in by], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(place, pa.int64())], [*kept, "_j"])

    return dealt.mapInArrow(run, T.StructType([*(dealt.schema[c] for c in kept), T.StructField("_j", T.LongType())]))


def _blocks(rows: DataFrame, by: Sequence[str], rest: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """(by, rest, n, block, score, label, s, sn, l, ln, m): the blocks of each size.

    rows have _k, their place in their group (by, rest), and _id, and come in runs of the
    order of both. A block inside a batch has its fused score and label, block -1 and rest
    null; one that goes over an edge of the batch has sums and counts of its part. Blocks
    that a group ends before they are full are left out.
    """
    types = (("n", T.LongType()), ("block", T.LongType()), ("score", T.DoubleType()), ("label", T.LongType()), ("s", T.DoubleType()), ("sn", T.LongType()), ("l", T.DoubleType()), ("ln", T.LongType()), ("m", T.LongType()))
    schema = T.StructType([*(rows.schema[c] for c in by), *(T.StructField(c, rows.schema[c].dataType) for c in rest), *(T.StructField(c, t) for c, t in types)])

    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, chunk) for b in batches for i in range(0, b.num_rows, chunk)):
            k, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_k", "_id"))
            both = [batch.column(c) for c in ("score", "label")]
            has = [c.is_valid().to_numpy(zero_copy_only=False) for c in both]
            values = [np.where(h, c.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0) for c, h in zip(both, has, strict=True)]
            jump = np.concatenate([np.diff(at) != 1, [True]])  # behind a row: rows between that are elsewhere
            new = np.concatenate([[True], jump[:-1] | (np.diff(k) != 1)])
            for n in sizes:
                block = k // n
                starts = np.flatnonzero(new | np.concatenate([[True], block[1:] != block[:-1]]))
                m = np.diff(np.append(starts, len(k)))
                held = (m == n) | (k[starts] % n != 0) | jump[starts + m - 1]
                if not held.any():
                    continue
                s, sn, l, ln = (np.add.reduceat(c, starts)[held] for v, h in zip(values, has, strict=True) for c in (v, h.astype(np.int64)))
                starts, m = starts[held], m[held]
                whole = m == n
                with np.errstate(invalid="ignore", divide="ignore"):
                    score, label = (s / sn).astype(np.float32).astype(np.float64), np.rint(l / ln)
                own = [batch.column(c).take(pa.array(starts)) for c in by]
                own += [batch.column(c).take(pa.array(starts, mask=whole)) for c in rest]
                fused = [pa.array(score, mask=~whole | (sn == 0)), pa.array(np.where(ln > 0, label, 0).astype(np.int64), mask=~whole | (ln == 0))]
                part = [pa.array(c, mask=whole) for c in (s, sn, l, ln)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(m), n)), pa.array(np.where(whole, -1, block[starts])), *fused, *part, pa.array(m)], schema.names)

    return rows.mapInArrow(run, schema)


def fusion_curve(df: DataFrame, by: Sequence[str], session: Sequence[str], order: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """(by, n, eer, auc, threshold) for every fusion size.

    Rows are numbered once and fused at all sizes as they are read back in order; only
    blocks over the edge of a batch meet in a further shuffle. Counts of the distinct
    fused scores are written, all else is deleted. Size 1 alone needs no order.
    """
    spark = df.sparkSession
    group = list(dict.fromkeys([*by, *session]))
    rest = [c for c in group if c not in by]
    sizes = [int(n) for n in sizes]
    values = df.select(*dict.fromkeys([*group, *order]), F.col("score").cast("double").alias("score"), F.col("label").cast("double").alias("label"))
    if sizes == [1]:
        kept = shared.written(_counts(values.select(*by, F.lit(1).cast("long").alias("n"), F.col("score").cast("float").cast("double").alias("score"), F.rint("label").cast("long").alias("label")), [*by, "n"]), shared.new_path(spark, "fused"))
        return _equal_error(kept, [*by, "n"])
    rows, path = numbered(values, group, order)
    total = lambda c: F.sum(c).alias(c)
    one, label = F.col("block") < 0, F.col("label")
    counted = [F.sum(label).alias("p"), F.sum(1 - label).alias("q"), F.count("*").alias("rows")]
    parts = _blocks(rows, by, rest, sizes).groupBy(*by, *rest, "n", "block", "score").agg(*counted, *map(total, ("s", "sn", "l", "ln", "m")))
    # what met: blocks of one place are joined, counts of equal fused scores stay as they are
    full = parts.where(one | (F.col("m") == F.col("n")))
    joined = F.when(F.col("ln") > 0, F.rint(F.col("l") / F.col("ln")).cast("long"))
    score = F.when(one, F.col("score")).when(F.col("sn") > 0, (F.col("s") / F.col("sn")).cast("float").cast("double"))
    final = full.select(*by, "n", score.alias("score"), F.when(one, F.col("p")).otherwise(joined).alias("p"), F.when(one, F.col("q")).otherwise(1 - joined).alias("q"), F.when(one, F.col("rows")).otherwise(1).alias("m"))
    kept = shared.written(final.groupBy(*by, "n", "score").agg(*map(total, "pqm")), shared.new_path(spark, "fused"))
    shared.delete(spark, path)
    return _equal_error(kept, [*by, "n"])


def macro(curve: DataFrame, by: Sequence[str] = ("n",)) -> DataFrame:
    """Plain means over targets, or over folds."""
    return curve.groupBy(*by).agg(F.avg("eer").alias("avg_eer"), F.avg("auc").alias("avg_auc"))


def one_vs_rest(df: DataFrame, user: str, targets: Sequence[int], claimed: str | None = None) -> DataFrame:
    """Every row once for each target, label 1 where ``user`` is the target. claimed: only rows that claim to be the target."""
    out = df.withColumn("target", F.explode(F.array(*(F.lit(t).cast("long") for t in targets))))
    out = out if claimed is None else out.where(F.col(claimed) == F.col("target"))
    return out.withColumn("label", (F.col(user) == F.col("target")).cast("long"))


def fold_means(df: DataFrame, by: Sequence[str], session: Sequence[str], order: Sequence[str], sizes: Sequence[int], fold: str = "fold") -> DataFrame:
    """(n, avg_eer, avg_auc): means over the folds of each fold's means over the targets."""
    per_fold = macro(fusion_curve(df, [fold, *by], session, order, sizes), [fold, "n"])
    return per_fold.groupBy("n").agg(F.avg("avg_eer").alias("avg_eer"), F.avg("avg_auc").alias("avg_auc"))


def at_own_threshold(df: DataFrame, thresholds: DataFrame, by: Sequence[str]) -> DataFrame:
    """``at_threshold`` with each group's threshold from (by, threshold), as estimated elsewhere."""
    return at_threshold(df.join(thresholds.select(*by, "threshold"), list(by)), F.col("threshold"), by)


def zipped(scores: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Scores with their labels and sessions by sample key, where arrays would be zipped by place."""
    return scores.join(labels, list(key))


def cover_summary(covered: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean, median) of covered numbers."""
    return covered.groupBy(*by).agg(F.avg("covered").alias("mean"), F.median("covered").alias("median"))


def interval_cover(df: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """(by, covered): whole numbers inside the union of closed intervals; touching ones merge."""
    df = shared.dealt(df.select(*by, left, right), by, COVERED)
    w = Window.partitionBy(*by).orderBy(left, right)
    before = F.max(right).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(left) > before + 1, F.lit(True)).cast("int")
    islands = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w)).groupBy(*by, "_island").agg((F.max(right) - F.min(left) + 1).alias("_n"))
    return islands.groupBy(*by).agg(F.sum("_n").cast("long").alias("covered"))
