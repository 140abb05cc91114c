"""Stores of fixed shape: rows known before they are written, completed after they were cut off."""

import shutil

import pytest
from pyspark.sql import functions as F

from trajspark.sources import tensors


def samples(spark, n=57):
    df = spark.range(n).select(F.concat(F.lit("user"), F.col("id") % 11).alias("user"), F.concat(F.lit("session_"), F.col("id") % 4).alias("session"), F.col("id").alias("idx"))
    return df.withColumn("values", F.array("idx", F.col("idx") * 2, F.lit(1), F.lit(0)))


def rows(df):
    return sorted((r.row, r.user, r.session, r.idx, r.user_idx, tuple(r.values), tuple(r.label)) for r in df.select("row", "user", "session", "idx", "user_idx", F.col("values"), "label").collect())


def test_rows_are_in_natural_order(spark, tmp_path):
    path = str(tmp_path / "store")
    tensors.write_tensors(samples(spark).repartition(5), path, [2, 2], rows_a_part=10)
    got = rows(tensors.read_tensors(spark, path))
    assert [r[0] for r in got] == list(range(57))
    key = lambda r: (int(r[1][4:]), int(r[2][8:]), r[3])
    assert [r[1:4] for r in got] == [r[1:4] for r in sorted(got, key=key)]
    assert all(r[5] == (r[3], 2 * r[3], 1, 0) and r[4] == int(r[1][4:]) and r[6].index(1) == r[4] and len(r[6]) == 11 for r in got)


@pytest.mark.parametrize("cut", ["parts", "rows", "all"])
def test_a_store_cut_off_is_completed(spark, tmp_path, cut):
    whole, path = str(tmp_path / "whole"), str(tmp_path / "store")
    tensors.write_tensors(samples(spark), whole, [4], rows_a_part=10)
    tensors.write_tensors(samples(spark).repartition(3), path, [4], rows_a_part=10, parts_a_job=2)
    if cut == "parts":
        for p in (3, 5):
            shutil.rmtree(tmp_path / "store" / "rows" / f"part={p}")
    elif cut == "rows":
        own = spark.read.parquet(f"{path}/rows/part=4").where("row < 43")
        own.coalesce(1).write.parquet(str(tmp_path / "some"))
        shutil.rmtree(tmp_path / "store" / "rows" / "part=4")
        shutil.move(tmp_path / "some", tmp_path / "store" / "rows" / "part=4")
    else:
        shutil.rmtree(tmp_path / "store" / "rows")
    with pytest.raises(ValueError, match="lacks"):
        tensors.read_tensors(spark, path)
    assert tensors.write_tensors(samples(spark), path, [4], resume=True, rows_a_part=10) == {"parts": 2, "rows": 1, "all": 6}[cut]
    assert rows(tensors.read_tensors(spark, path)) == rows(tensors.read_tensors(spark, whole))
    assert tensors.write_tensors(samples(spark), path, [4], resume=True, rows_a_part=10) == 0


def test_what_is_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no store"):
        tensors.write_tensors(samples(spark), path, [4], resume=True)
    with pytest.raises(ValueError, match="shape"):
        tensors.write_tensors(samples(spark), path, [5])
    tensors.write_tensors(samples(spark), path, [4])
    with pytest.raises(ValueError, match="already"):
        tensors.write_tensors(samples(spark), path, [4])
    with pytest.raises(ValueError, match="other samples"):
        tensors.write_tensors(samples(spark, 58), path, [4], resume=True)


def test_bytes_and_places(spark, tmp_path):
    own = samples(spark).withColumn("values", F.lit(bytearray(b"abcdef")))
    tensors.write_tensors(own, str(tmp_path / "b" / "event8"), [3, 1, 2])
    assert tensors.read_tensors(spark, str(tmp_path / "b" / "event8")).count() == 57
    found = tensors.tensor_root(spark, str(tmp_path / "b"), ["event9", "event8"])
    assert found.endswith("event8") and tensors.tensor_root(spark, found) == found
    with pytest.raises(ValueError, match="no store"):
        tensors.tensor_root(spark, str(tmp_path))
