"""Stored tables: versions, replays, changes by copy, compaction, bounds, early stops, broken writes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldstream.operators import ml
from fieldstream.sources.stored import Stored
from fieldstream.streaming import jobs

START = datetime(2024, 1, 1)
ROWS = "id long, at timestamp_ntz, status string, extra int"


def at(minutes):
    return F.lit(str(START + timedelta(minutes=minutes))).cast("timestamp_ntz")


def batch(spark, low, high, status="ACTIVE"):
    return spark.createDataFrame([(i, START + timedelta(minutes=i), status, i % 7) for i in range(low, high)], ROWS).coalesce(1)


@pytest.fixture
def table(spark, tmp_path):
    found = Stored(spark, f"{tmp_path}/t", "at")
    for n in range(4):
        assert found.append(batch(spark, 100 * n, 100 * n + 100), n)
    return found


def names(table):
    return {r["file"] for r in table.files().collect() if r["file"]}


def ids(rows):
    return sorted(r["id"] for r in rows.select("id").collect())


def test_replays_and_versions(spark, table):
    before = table.read()
    assert not table.append(batch(spark, 0, 5), 2) and ids(table.read()) == list(range(400))
    table.append(batch(spark, 400, 410), 4)
    assert ids(before) == list(range(400)) and ids(table.read()) == list(range(410))
    table.append(batch(spark, 0, 0), 5)  # a batch without rows counts as well
    assert not table.append(batch(spark, 0, 9), 5) and ids(table.read()) == list(range(410))


def test_changes_rewrite_only_their_files(spark, table):
    before = names(table)
    changes = spark.createDataFrame([(5, "RESOLVED"), (7, None), (399, "IGNORED"), (1000, "IGNORED")], "id long, status string")
    assert table.change(changes) == 3
    after = names(table)
    assert len(before & after) == 2 and ids(table.read()) == list(range(400))
    found = {r["id"]: r["status"] for r in table.read().collect()}
    assert (found[5], found[7], found[399], found[6]) == ("RESOLVED", None, "IGNORED", "ACTIVE")
    assert table.change(changes.where("id = 1000")) == 0 and names(table) == after
    assert table.remove(F.col("status") == "RESOLVED") == 1 and len(after & names(table)) == 2 and 5 not in ids(table.read())
    assert not table.append(batch(spark, 0, 5), 0)  # its rows are in rewritten files


def test_compaction_is_by_size_and_keeps_batches(spark, table):
    assert table.compact() == 4 and ids(table.read()) == list(range(400))
    large = names(table)
    assert not table.append(batch(spark, 0, 5), 3)
    for n in (4, 5):
        table.append(batch(spark, 100 * n, 100 * n + 50), n)
    most = max(r["bytes"] for r in table.files().where(F.col("high") > at(400)).collect())
    assert min(r["bytes"] for r in table.files().where(F.col("high") < at(400)).collect()) > most
    assert table.compact(most + 1) == 2 and large < names(table) and table.compact(most + 1) == 0
    assert ids(table.read()) == [*range(450), *range(500, 550)]
    assert table.vacuum() > 0 and ids(table.read()) == [*range(450), *range(500, 550)]


def test_ranges_read_their_files(table):
    rows = table.read(at(150), at(250))
    assert ids(rows) == list(range(150, 251)) and len(rows.inputFiles()) == 2
    assert table.count(at(50), at(349)) == 300 and table.count(at(1000), at(2000)) == 0
    assert ids(table.range_or_all(at(10), at(20), 11)) == list(range(10, 21)) and len(table.range_or_all(at(10), at(20), 11).inputFiles()) == 1
    assert table.range_or_all(at(10), at(20), 12).count() == 400


def test_newest_rows_stop_early(spark, table):
    assert ids(table.newest(10)) == list(range(390, 400)) and len(table.newest(10).inputFiles()) == 1
    assert ids(table.newest(150)) == list(range(250, 400)) and len(table.newest(150).inputFiles()) < 4
    assert ids(table.newest(3, F.col("id") % 100 == 0)) == [100, 200, 300]
    assert table.newest(1000).count() == 400
    tied = spark.createDataFrame([(i, START + timedelta(minutes=399), "ACTIVE", 0) for i in (1000, 1001)], ROWS)
    table.append(tied, 9)
    table.append(spark.createDataFrame([(2000, None, "ACTIVE", 0)], ROWS), 10)
    assert ids(table.newest(2)) == [1000, 1001] and ids(table.newest(3)) == [399, 1000, 1001]
    assert table.newest(1000).count() == 403 and table.count(at(0), at(500)) == 402


def test_a_write_without_commit_does_not_count(spark, table, monkeypatch):
    def broken(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(Stored, "_commit", broken)
        table.append(batch(spark, 400, 500), 4)
    assert ids(table.read()) == list(range(400))
    assert table.append(batch(spark, 400, 500), 4) and ids(table.read()) == list(range(500))
    spark.range(1).write.parquet(f"{table.root}/manifest/v=000000000099")
    import os

    os.remove(f"{table.root}/manifest/v=000000000099/_SUCCESS")
    assert ids(table.read()) == list(range(500))
    assert table.append(batch(spark, 500, 501), 5) and table.read().count() == 501


def test_no_table(spark, tmp_path):
    none = Stored(spark, f"{tmp_path}/none", "at")
    assert none.remove(F.lit(True)) == 0 and none.compact() == 0
    with pytest.raises(ValueError, match="no table"):
        none.read()
    none.append(batch(spark, 0, 0), 0)
    assert none.read().count() == 0 and none.newest(3).count() == 0 and none.change(spark.createDataFrame([(1, "X")], "id long, status string")) == 0


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    table = Stored(spark, f"{tmp_path}/t", "at")
    batch(spark, 0, 50).repartition(3).write.parquet(f"{tmp_path}/in")
    for checkpoint in ("a", "b"):  # the second starts anew: all its batches are there
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.drained(jobs._started(stream, jobs.stored_table(table), f"{tmp_path}/{checkpoint}", "silver", jobs.NOW))
    assert ids(table.read()) == list(range(50))


def test_training_rows_push_their_range(spark, table):
    rows = ml.training_rows(table.read(), str(START), str(START + timedelta(minutes=99)), least=100, time="at")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "GreaterThanOrEqual(at" in plan and ids(rows) == list(range(100))
    assert ml.training_rows(table.read(), str(START), str(START + timedelta(minutes=98)), least=100, time="at").count() == 400
