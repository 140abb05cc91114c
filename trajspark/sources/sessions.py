"""Session logs, stores of samples and small dimension tables.

A session is a text file with a header whose line order is the order of events.
Files are read whole, so a session stays in one task and its lines are numbered
without a shuffle; sessions are small by nature (hundreds of lines).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions.scalars import file_stem
from trajspark.operators.clean import PROFILES, clean, profile, renumber

KEYS = ("user", "session")
# Directories that hold splits, not users.
SPLIT_DIRS = r"^(training_files|testing_files.*)$"


def read_sessions(spark: SparkSession, root: str, *, skip_splits: bool = True, header: Sequence[str] | None = None) -> DataFrame:
    """(user, session, seq, columns of the log as text) of all files root/<user>/<file>.

    header: column names; by default those of the first file. Every file's own
    header line is left out. A session's name is its file's without extension.
    """
    files = spark.read.text(f"{root.rstrip('/')}/*/*", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    files = files.select(F.element_at(F.split("path", "/"), -2).alias("user"), file_stem(F.col("path")).alias("session"), F.split(F.rtrim(F.regexp_replace("value", "\r", "")), "\n").alias("lines"))
    if skip_splits:
        files = files.where(~F.col("user").rlike(SPLIT_DIRS))
    if header is None:
        first = files.select(F.get("lines", F.lit(0)).alias("h")).first()
        header = [h.strip('"') for h in first.h.split(",")] if first and first.h else []
    lines = files.select("user", "session", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("seq", "line"))
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    parsed = lines.where(F.trim("line") != "").select("user", "session", F.col("seq").cast("long").alias("seq"), F.from_csv("line", schema.simpleString() if not any(" " in h for h in header) else ", ".join(f"`{h}` STRING" for h in header)).alias("r"))
    return parsed.select("user", "session", "seq", *(F.col("r")[h].alias(h) for h in header))


def load_events(spark: SparkSession, root: str, dataset: str, *, split: str = "", **options) -> DataFrame:
    """(dataset, split, user, session, seq, time, x, y, kind) of a directory of logs, cleaned; see ``clean``."""
    profile(dataset)
    raw = read_sessions(spark, root, skip_splits=options.pop("skip_splits", True))
    out = renumber(clean(raw, dataset, KEYS, **options), KEYS)
    return out.select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), *KEYS, "seq", "time", "x", "y", "kind")


def claimed(genuine: DataFrame, imposter: DataFrame) -> DataFrame:
    """Genuine and imposter rows together, with is_imposter; labels of imposters are 0, the claimed user stays."""
    mark = lambda df, bad: df.withColumn("is_imposter", F.lit(bad)).withColumn("label", F.lit(0 if bad else 1).cast("long"))
    return mark(genuine, False).unionByName(mark(imposter, True))


def user_index(df: DataFrame) -> DataFrame:
    """(user, user_idx) in natural order; one small row a user."""
    from pyspark.sql import Window

    from trajspark.functions.scalars import natural_key

    return df.select("user").distinct().withColumn("user_idx", F.row_number().over(Window.orderBy(natural_key(F.col("user")), "user")) - 1)


def write_samples(df: DataFrame, path: str, *, resume: bool = False, partition_by: Sequence[str] = ("user",)) -> None:
    """Write samples (sample_id, ...) as Parquet; an existing store is refused, or with ``resume`` completed by the samples it lacks."""
    if resume and _exists(df.sparkSession, path):
        held = df.sparkSession.read.parquet(path).select("sample_id")
        df.join(held, "sample_id", "left_anti").write.mode("append").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cached_table(spark: SparkSession, path: str, build, *, rescan: bool = False, required: Sequence[str] = ()) -> DataFrame:
    """A small JSON table (bounds, statistics): read if it is there, else built and saved; needed columns are checked."""
    if rescan or not _exists(spark, path):
        build().write.mode("overwrite").json(path)
    found = spark.read.json(path)
    if missing := set(required) - set(found.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    if not found.take(1):
        raise ValueError(f"{path} is empty")
    return found


def write_results(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def image_tree(spark: SparkSession, root: str) -> DataFrame:
    """(user, session, idx, content) of images root/<user>/<session>-<idx>.png; other names are left out."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*.png").select("content", F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    parsed = files.select(F.element_at(F.split("path", "/"), -2).alias("user"), F.regexp_extract(name, r"^(session_\d+)-(\d+)\.png$", 1).alias("session"), F.regexp_extract(name, r"^(session_\d+)-(\d+)\.png$", 2).try_cast("int").alias("idx"), "content")
    return parsed.where("session <> ''")


__all__ = ["KEYS", "PROFILES", "cached_table", "claimed", "image_tree", "load_events", "read_samples", "read_sessions", "user_index", "write_results", "write_samples"]
