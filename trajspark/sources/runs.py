"""Runs of an evaluation by folds: scores and curves of each fold are kept, so that a stopped run goes on and a finished one is evaluated anew.

A run is a folder: ``about`` says what it is made of, ``scores/fold=k`` has a fold's scores
and ``curves/fold=k`` its metrics by target and fusion size. A fold is finished when both
have been written as a whole; curves come last, so a fold that was cut off is done again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark import shared
from trajspark.operators import scoring

STAMP = r"\d{8}_\d{6}"
_ABOUT = "source string, folds int, by array<string>, session array<string>, order array<string>"


def resolve(spark: SparkSession, path: str, *roots: str) -> str:
    """The path itself where it is absolute (or has a scheme), else the first root that holds it; none is an error."""
    if path.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path
    tried = [f"{r.rstrip('/')}/{path}" for r in roots]
    found = next((t for t in tried if shared.exists(spark, t)), None)
    if found is None:
        raise FileNotFoundError(f"none of {tried} exists")
    return found


def store_in(spark: SparkSession, root: str, preferred: Sequence[str] = (), mark: str = "rows") -> str:
    """The store at or below a folder: the folder itself, else the first preferred name, else the first by name; a store has a child called ``mark``."""
    root = root.rstrip("/")
    names = shared.children(spark, root)
    for place in [root, *(f"{root}/{n}" for n in [*(p for p in preferred if p in names), *names])]:
        if shared.exists(spark, f"{place}/{mark}"):
            return place
    raise FileNotFoundError(f"no store in {root}")


def latest(spark: SparkSession, root: str, pattern: str = STAMP) -> str:
    """The folder of the last run by name; names are time stamps unless a pattern says otherwise."""
    found = [n for n in shared.children(spark, root) if re.fullmatch(pattern, n)]
    if not found:
        raise FileNotFoundError(f"no run in {root}")
    return f"{root.rstrip('/')}/{max(found)}"


def about(spark: SparkSession, path: str):
    """What the run is made of, as one row."""
    return spark.read.schema(_ABOUT).json(f"{path}/about").first()


def _whole(spark: SparkSession, path: str) -> bool:
    return shared.exists(spark, f"{path}/_SUCCESS")


def finished(spark: SparkSession, path: str) -> list[int]:
    """Finished folds; a finished fold after one that isn't is an error, as no run leaves that."""
    names = [n for n in shared.children(spark, f"{path}/curves") if n.startswith("fold=")]
    held = sorted(k for k in (int(n.removeprefix("fold=")) for n in names) if _whole(spark, f"{path}/curves/fold={k}") and _whole(spark, f"{path}/scores/fold={k}"))
    if held != list(range(len(held))):
        raise ValueError(f"folds {held} of {path} are finished, but one before them is not")
    return held


def run_folds(
    spark: SparkSession,
    path: str,
    scored: Callable[[int], DataFrame],
    *,
    source: str,
    folds: int,
    sizes: Sequence[int],
    by: Sequence[str] = ("target",),
    session: Sequence[str] = ("session",),
    order: Sequence[str] = ("idx",),
    at_most: int | None = None,
) -> list[int]:
    """Score and evaluate the folds that the run lacks, in order; gives the folds that were done.

    scored: a fold's rows (by, session, order, score, label), other columns are left
    out. A run that was begun with another source, other folds or other keys is refused.
    at_most: stop after so many folds; the next call goes on from there.
    """
    made = (source, folds, list(by), list(session), list(order))
    if not _whole(spark, f"{path}/about"):
        spark.createDataFrame([made], _ABOUT).coalesce(1).write.mode("overwrite").json(f"{path}/about")
    elif tuple(about(spark, path)) != made:
        raise ValueError(f"{path} was begun with {tuple(about(spark, path))}, not {made}")
    todo = list(range(len(finished(spark, path)), folds))[:at_most]
    columns = list(dict.fromkeys([*by, *session, *order, "score", "label"]))
    for k in todo:
        scored(k).select(*columns).write.mode("overwrite").parquet(f"{path}/scores/fold={k}")
        kept = spark.read.parquet(f"{path}/scores/fold={k}")
        scoring.fusion_curve(kept, by, session, order, sizes).write.mode("overwrite").parquet(f"{path}/curves/fold={k}")
    return todo


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    held = finished(spark, path)
    if not held:
        raise ValueError(f"{path} has no finished fold")
    found = spark.read.option("basePath", f"{path}/{what}").parquet(*(f"{path}/{what}/fold={k}" for k in held))
    return found.withColumn("fold", F.col("fold").cast("long"))


def stored_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores of all finished folds, with their fold."""
    return _read(spark, path, "scores")


def per_target(spark: SparkSession, path: str) -> DataFrame:
    """(fold, by, n, eer, auc, threshold) of all finished folds, as the run found them."""
    return _read(spark, path, "curves")


def summary(curves: DataFrame) -> DataFrame:
    """(fold, n, avg_eer, avg_auc): plain means over a fold's targets."""
    return scoring.macro(curves, ["fold", "n"])


def reevaluated(spark: SparkSession, path: str, sizes: Sequence[int]) -> DataFrame:
    """``per_target`` computed anew from the stored scores, at any fusion sizes; nothing is scored again."""
    made = about(spark, path)
    return scoring.fusion_curve(stored_scores(spark, path), ["fold", *made.by], made.session, made.order, sizes)
