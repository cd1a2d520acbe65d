"""The fact table on disk: upserts of hot months, swaps that break off, pruning, expiry."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from windrow.operators import align
from windrow.sources import readers

SHAPE = "station string, species string, ts timestamp_ntz, value double, ingest_ts timestamp"


def rows(spark, n, value, month=1, ingest=1):
    start = dt.datetime(2024, month, 1)
    return spark.range(n).selectExpr("concat('s', id % 50) as station", "'x' as species", f"cast(timestamp'{start}' + make_interval(0,0,0,0,0,id div 50) as timestamp_ntz) as ts", f"cast({value} + id as double) as value", f"timestamp'2024-06-0{ingest}' as ingest_ts")


def table(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("station", "ts", "value").collect()))


def files(path, month):
    return [f for f in os.listdir(f"{path}/month_start={month}") if f.endswith(".parquet")]


def test_a_hot_month_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        align.upsert_table(path, rows(spark, 20_000, 0).unionByName(rows(spark, 50, 0, 2)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files(path, "2024-01-01")) >= 3 and spark.read.parquet(path).count() == 20_050
    assert not [n for n in os.listdir(path) if n in ("_staging", "_replaced") and os.listdir(f"{path}/{n}")]


def test_upserts_are_idempotent_and_touch_their_months_only(spark, tmp_path):
    path = str(tmp_path / "t")
    align.upsert_table(path, rows(spark, 100, 0).unionByName(rows(spark, 100, 0, 2)))
    before = files(path, "2024-01-01")
    for _ in range(2):
        align.upsert_table(path, rows(spark, 60, 1000, 2, 2))
    got = table(spark, path)
    assert files(path, "2024-01-01") == before and len(got) == 200
    assert sum(v >= 1000 for _, _, v in got) == 60
    align.upsert_table(path, rows(spark, 60, 5000, 2, 1))  # older than what is there
    assert table(spark, path) == got
    align.upsert_table(path, rows(spark, 0, 0))
    assert table(spark, path) == got


@pytest.mark.parametrize("at", range(6))
def test_a_failure_anywhere_loses_nothing(spark, tmp_path, monkeypatch, at):
    """The swap breaks at its first, second, ... move; the table is then as before or after, and a second run completes it."""
    path = str(tmp_path / "t")
    align.upsert_table(path, rows(spark, 100, 0).unionByName(rows(spark, 100, 0, 2)))
    old = table(spark, path)
    moves, rename = [0], align.rename

    def breaking(*a):
        if moves[0] == at:
            raise OSError("lost")
        moves[0] += 1
        rename(*a)

    monkeypatch.setattr(align, "rename", breaking)
    new = rows(spark, 100, 1000, 1, 2).unionByName(rows(spark, 100, 1000, 2, 2)).unionByName(rows(spark, 10, 0, 3))
    if at < 5:
        with pytest.raises(OSError):
            align.upsert_table(path, new)
    else:
        align.upsert_table(path, new)
    monkeypatch.setattr(align, "rename", rename)
    align.recover(spark, path)
    now = table(spark, path)
    assert {(s, t) for s, t, _ in old} <= {(s, t) for s, t, _ in now}  # no key is gone
    align.upsert_table(path, new)
    assert len(table(spark, path)) == 210 and sum(v >= 1000 for _, _, v in table(spark, path)) == 200
    assert not align.folders(spark, f"{path}/_replaced")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_months_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    align.upsert_table(path, rows(spark, 50, 0).unionByName(rows(spark, 50, 0, 2)).unionByName(rows(spark, 50, 0, 5)))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    some = readers.history(spark, path, at("2024-02-01"), at("2024-03-01"))
    assert "PartitionFilters: [isnotnull(month_start" in plan(some).replace("\n", " ") and some.count() == 50
    kept = align.retain(readers.history(spark, path), at("2024-05-20"), 60)
    assert "PartitionFilters: [isnotnull(month_start" in plan(kept) and kept.count() == 50


def test_expired_months_go_from_disk(spark, tmp_path):
    path = str(tmp_path / "t")
    align.upsert_table(path, rows(spark, 50, 0).unionByName(rows(spark, 50, 0, 2)).unionByName(rows(spark, 50, 0, 5)))
    assert align.expire(spark, path, dt.datetime(2024, 5, 30), 90) == [dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    assert [n for n in sorted(os.listdir(path)) if n.startswith("month_start")] == ["month_start=2024-05-01"]
    assert align.expire(spark, path, dt.datetime(2024, 5, 30), 90) == [] and spark.read.parquet(path).count() == 50
    align.upsert_table(path, rows(spark, 0, 0))
    assert align.expire(spark, str(tmp_path / "none"), dt.datetime(2024, 5, 30)) == []
