"""Profiles kept up file by file equal a whole profile, and read only what changed."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.operators import fileprofile
from tallyframe.operators.fileprofile import FileProfiles
from tallyframe.operators.profile import profile

EXACT = ("position", "name", "dtype", "kind", "inferred", "n_rows", "n_non_null", "n_null", "n_distinct", "samples", "min", "max",
         "q25", "median", "q75", "top", "top_freq", "n_whitespace", "n_numeric", "flags")


def same(kept, whole):
    a, b = (df.orderBy("position").collect() for df in (kept, whole))
    for x, y in zip(a, b, strict=True):
        for field in EXACT:
            assert x[field] == y[field], (x["name"], field)
        for field in ("mean", "std", "null_rate", "distinct_rate"):
            assert x[field] == (pytest.approx(y[field]) if y[field] is not None else None), (x["name"], field)


def table(spark, start, n):
    return spark.range(start, start + n).selectExpr(
        "id", "CAST(id % 7 AS INT) AS seven", "IF(id % 3 = 0, NULL, id * 0.5D) AS half", "IF(id % 5 = 0, ' x', string(id % 4)) AS word",
        "date_add(DATE'2024-01-01', CAST(id % 9 AS INT)) AS day", "id % 2 = 0 AS even", "array(id % 2) AS list",
        "repeat(concat('long text ', string(id % 3)), 20) AS prose", "CAST(NULL AS STRING) AS none")


def parts(folder):
    return sorted(glob.glob(f"{folder}/*.parquet"))


def test_only_changed_files_are_read_again(spark, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "state")
    table(spark, 0, 90).repartition(3, "seven").write.parquet(data)
    files = FileProfiles(spark, data, store)
    first = files.refresh()
    assert len(first.read) == len(parts(data)) and not first.kept and files.stale().count() == 0
    same(files.profile(), profile(spark.read.parquet(data)))
    assert files.refresh().read == []
    # one of the files changes, another goes, a new one comes
    other = str(tmp_path / "other")
    table(spark, 500, 20).coalesce(1).write.parquet(other)
    old = parts(data)
    shutil.copy(parts(other)[0], old[0])
    for path in glob.glob(f"{data}/.*.crc"):
        os.unlink(path)
    os.unlink(old[1])
    shutil.copy(parts(other)[0], f"{data}/part-new.parquet")
    states = {os.path.basename(r.path): r.state for r in files.stale().collect()}
    assert states == {os.path.basename(old[0]): "changed", os.path.basename(old[1]): "gone", "part-new.parquet": "new"}
    done = files.refresh()
    assert sorted(map(os.path.basename, done.read)) == sorted([os.path.basename(old[0]), "part-new.parquet"])
    assert len(done.gone) == 1 and len(done.kept) == len(old) - 2
    # the plan that counts reads those files and no other
    assert sorted(map(os.path.basename, files.changed_rows(done.read).inputFiles())) == sorted(map(os.path.basename, done.read))
    same(files.profile(), profile(spark.read.parquet(data)))


def test_empty_files_and_a_failed_refresh(spark, tmp_path, monkeypatch):
    data, store = str(tmp_path / "data"), str(tmp_path / "state")
    table(spark, 0, 1).limit(0).write.parquet(data)
    files = FileProfiles(spark, data, store)
    files.refresh()
    same(files.profile(), profile(spark.read.parquet(data)))
    table(spark, 0, 10).coalesce(1).write.mode("append").parquet(data)
    before = files.versions.current()
    monkeypatch.setattr(files.versions, "use", lambda name: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        files.refresh()
    assert files.versions.current() == before and files.profile().where(F.col("n_rows") > 0).count() == 0
    monkeypatch.undo()
    assert len(files.refresh().read) == 1
    same(files.profile(), profile(spark.read.parquet(data)))


def test_one_large_file_is_counted_by_many_tasks(spark, tmp_path, monkeypatch):
    data = str(tmp_path / "data")
    table(spark, 0, 900).coalesce(1).write.parquet(data)
    files = FileProfiles(spark, data, str(tmp_path / "state"))
    size = os.path.getsize(parts(data)[0])
    monkeypatch.setattr(session, "TASK_BYTES", size // 6)
    rows = fileprofile.spread(files.changed_rows(parts(data)), size)
    held = rows.groupBy(F.spark_partition_id()).count().collect()
    assert rows.count() == 900 and len(held) >= 6 and max(r["count"] for r in held) < 300
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with session.small_tasks(spark, size):
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 6
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    files.refresh()
    same(files.profile(), profile(spark.read.parquet(data)))
