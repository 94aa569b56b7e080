"""Tables that are replaced as a whole."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from waystone.sources import cache, catalog, commit


def rows(d):
    return sorted(map(tuple, d.collect()))


@pytest.fixture
def two(spark):
    return spark.createDataFrame([(1, 2.0, None), (2, 3.5, "x")], "a long, b double, c string")


def test_a_failing_write_leaves_the_old_rows(spark, two, tmp_path):
    path = str(tmp_path / "t")
    assert commit.current(spark, path) is None
    commit.publish(two, path)
    bad = two.repartition(2).withColumn("c", F.when(F.col("a") == 2, F.raise_error(F.lit("broken"))).otherwise("y"))
    with pytest.raises(Exception, match="broken"):
        commit.publish(bad, path)
    assert rows(commit.current(spark, path)) == rows(two)
    commit.publish(two.limit(0), path)
    assert commit.current(spark, path).count() == 0 and commit.current(spark, path).columns == ["a", "b", "c"]
    assert len(glob.glob(f"{path}/data-*")) == 2  # the last one's and the one's before it, nothing of the failure


def test_a_reader_keeps_what_it_opened(spark, two, tmp_path):
    path = str(tmp_path / "t")
    commit.publish(two, path)
    old = commit.current(spark, path)
    commit.publish(two.union(two), path)
    assert old.count() == 2 and commit.current(spark, path).count() == 4


def test_a_table_may_be_made_of_itself(spark, two, tmp_path):
    path = str(tmp_path / "t")
    commit.publish(two, path)
    commit.publish(commit.current(spark, path).withColumn("a", F.col("a") + 1), path)
    assert [r[0] for r in rows(commit.current(spark, path))] == [2, 3]


@pytest.mark.parametrize("harm", ["pointer", "data", "part", "other"])
def test_what_is_broken_is_removed(spark, two, tmp_path, harm):
    path = str(tmp_path / "t")
    e = commit.publish(two.repartition(2), path)
    if harm == "pointer":
        open(f"{path}/{commit.POINTER}", "w").write("{")
        os.remove(f"{path}/.{commit.POINTER}.crc") if os.path.exists(f"{path}/.{commit.POINTER}.crc") else None
    elif harm == "data":
        shutil.rmtree(f"{path}/{e.data}")
    elif harm == "part":
        os.remove(next(f for f in glob.glob(f"{path}/{e.data}/part-*") if spark.read.parquet(f).count()))
    else:
        two.withColumn("a", F.col("a") + 7).write.mode("overwrite").parquet(f"{path}/{e.data}")
    assert commit.current(spark, path) is None and not os.path.exists(path)


def test_other_versions_are_passed_over_and_kept(spark, two, tmp_path):
    path = str(tmp_path / "t")
    commit.publish(two, path, format=1, maker=3)
    assert commit.current(spark, path, 1, 4) is None and commit.current(spark, path, 2, 3) is None and rows(commit.current(spark, path, 1, 3)) == rows(two)


def test_cache_entries_have_versions(spark, tmp_path):
    root, columns = str(tmp_path), ["source", "lat", "lon"]
    p = spark.createDataFrame([("a", 1.0, 2.0)], "source string, lat double, lon double")
    cache.write_cache(p, root, "k")
    assert rows(cache.read_cache(spark, root, "k", columns)) == [("a", 1.0, 2.0)] and cache.read_cache(spark, root, "k", columns, parser=cache.PARSER + 1) is None
    cache.write_cache(p.withColumn("lat", F.lit(99.0)), root, "k")
    assert cache.read_cache(spark, root, "k", columns) is None and commit.pointer(spark, f"{root}/k") is None


def test_export_requests_come_back(spark, tmp_path):
    path = str(tmp_path / "r")
    kinds = "id long, start_year int, start_month int, end_year int, end_month int, movement string, pacing string, detection string, framing string, scale double, points long, framing_on boolean"
    d = spark.createDataFrame([(i, 2024, 1, 2024, 2, "steady", "balanced", "balanced", "close", 2.0, 10, True) for i in range(5)], kinds)
    assert catalog.stored_export_requests(spark, path) is None
    catalog.write_export_requests(d, path)
    with pytest.raises(Exception, match="disk"):
        catalog.write_export_requests(d.withColumn("scale", F.raise_error(F.lit("disk")).cast("double")), path)
    assert [(r.id, r.framing, r.scale) for r in catalog.stored_export_requests(spark, path).orderBy("id").collect()] == [(i, "close", 2.0) for i in range(5)]
