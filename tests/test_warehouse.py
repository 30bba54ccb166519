import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from streamloom.sources import warehouse
from streamloom.sources.schemas import EVENT_ROW


def event_rows(spark, *given):
    out = []
    for i, (app, at) in enumerate(given):
        ms = int((at - datetime(1970, 1, 1)).total_seconds() * 1000)
        own = {"id": str(i), "app_id": app, "timestamp_ms": ms, "year": at.year, "month": at.month, "day": at.day, "hour": at.hour}
        out.append(tuple(own.get(f.name) for f in EVENT_ROW.fields))
    return spark.createDataFrame(out, EVENT_ROW)


DAY = datetime(2025, 11, 4, 17, 12)
FIVE = [("app-1", DAY), ("app-1", DAY), ("app-1", DAY.replace(hour=18)), ("app-2", DAY), ("app-1", DAY.replace(day=5))]


def files(path):
    return sorted(os.path.relpath(os.path.join(a, x), path) for a, _, b in os.walk(path) for x in b if x.endswith(".parquet"))


def test_partitions_pruning_and_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warehouse.append(event_rows(spark, *FIVE), path, "unheard-of")
    assert len({os.path.dirname(f) for f in files(tmp_path / "w")}) == 4
    assert any("month=11/day=04/hour=17" in f and "snappy" in f for f in files(tmp_path / "w"))
    back = warehouse.read(spark, path)
    assert sorted(r["id"] for r in back.collect()) == list("01234") and back.schema["month"].dataType.typeName() == "integer"
    near = warehouse.time_range(back, datetime(2025, 11, 4, 17), datetime(2025, 11, 4, 18))
    assert near.count() == 3 and "year" in near._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert len(near.inputFiles()) <= len(back.inputFiles())
    warehouse.create_table(spark, "events_test", path)
    try:
        assert spark.table("events_test").count() == 5
        assert warehouse.partitions_of(spark, "events_test", "app-1").count() == 3
    finally:
        spark.sql("DROP TABLE events_test")


def test_codecs():
    assert [warehouse.codec(x) for x in ("GZIP", "zstd", "none", "lzo", None)] == ["gzip", "zstd", "none", "snappy", "snappy"]


@pytest.mark.parametrize(("sizes", "packs"), [([7, 41, 33], 1), ([48] * 6, 3), ([12], 0), ([], 0), ([150, 410], 0), ([99, 1, 60, 60], 1)])
def test_packing(spark, sizes, packs):
    table = spark.createDataFrame([("p", f"f{i}.parquet", s) for i, s in enumerate(sizes)], "partition string, path string, size long")
    assert warehouse.pack_files(table, 100).count() == packs


def test_cold_paths():
    now = datetime(2024, 3, 1, 0, 20)
    path = lambda *x: "w/app_id=a/year={:04}/month={:02}/day={:02}/hour={:02}".format(*x)
    assert all(warehouse.cold_path(path(*x), now) for x in ((2024, 2, 29, 23), (2024, 2, 1, 5), (2023, 12, 31, 23)))
    assert not any(warehouse.cold_path(p, now) for p in (path(2024, 3, 1, 0), path(2024, 3, 1, 1), "w/app_id=a/year=2024/month=1/day=1/hour=1", path(2024, 13, 1, 1)))


def test_compaction_keeps_rows_and_leaves_hot_and_broken_files(spark, tmp_path):
    path, now = f"file://{tmp_path}/w", DAY.replace(hour=18, minute=40)
    for _ in range(3):
        warehouse.append(event_rows(spark, *FIVE[:4]), path)
    broken = tmp_path / "w/app_id=app-2/year=2025/month=11/day=04/hour=17/part-broken.parquet"
    broken.write_bytes(b"PAR1 no")
    before = files(tmp_path / "w")
    assert warehouse.compact(spark, path, now) == 2
    after = files(tmp_path / "w")
    per = lambda names, x: sum(x in n for n in names)
    assert (per(before, "app-1/year=2025/month=11/day=04/hour=17"), per(after, "app-1/year=2025/month=11/day=04/hour=17")) == (3, 1)
    # the good files of the broken one's pack are rewritten without it
    assert per(after, "hour=18") == 3 and broken.exists() and per(after, "app-2") == 2
    broken.unlink()
    assert warehouse.read(spark, path).count() == 12
    assert warehouse.compact(spark, path, now) == 0
    assert warehouse.drop_before(spark, path, now.replace(day=6), 24) and warehouse.read(spark, path).where(F.lit(True)).count() == 0


def test_a_swap_that_broke_off_is_read_once_and_ended(spark, tmp_path, monkeypatch):
    path, now = f"file://{tmp_path}/w", DAY.replace(day=20)
    for _ in range(2):
        warehouse.append(event_rows(spark, *FIVE), path)

    def stop(self, p):
        raise OSError("lost")

    real = warehouse.Files.delete
    for broken in ("delete", "move"):
        monkeypatch.setattr(warehouse.Files, broken, stop if broken == "delete" else lambda self, a, b: stop(self, a))
        with pytest.raises(OSError):
            warehouse.compact(spark, path, now)
        monkeypatch.undo()
        assert warehouse.read(spark, path).count() == 10
        if broken == "delete":  # the new files are in: the next run removes the old ones
            warehouse.recover(spark, path)
            assert len(files(tmp_path / "w")) - sum("_compacted" in f for f in files(tmp_path / "w")) == 4
            for _ in range(2):
                warehouse.append(event_rows(spark, *FIVE), path)
            assert warehouse.read(spark, path).count() == 20
            warehouse.drop_before(spark, path, now, 24)
            for _ in range(2):
                warehouse.append(event_rows(spark, *FIVE), path)
    assert warehouse.Files.delete is real
    assert warehouse.compact(spark, path, now) == 4 and warehouse.read(spark, path).count() == 10


def test_a_rename_that_fails_loses_nothing(spark, tmp_path):
    files_ = warehouse.Files(spark, f"file://{tmp_path}")
    with pytest.raises(Exception):
        files_.move(f"file://{tmp_path}/none", f"file://{tmp_path}/x/y")


def test_sink_table_compaction_and_retention_are_one_table(spark, tmp_path):
    """Rows counted after each step: two batches, one retried, compacted beside a hot hour, retried again, read by SQL, dropped."""
    path, now = f"file://{tmp_path}/w", DAY.replace(hour=18, minute=40)
    old, hot = event_rows(spark, *FIVE[:2], FIVE[3]), event_rows(spark, *FIVE[:2], FIVE[2])
    warehouse.append_batch(old, path, 0)
    warehouse.append_batch(hot, path, 1)
    warehouse.append_batch(hot, path, 1)
    assert warehouse.read(spark, path).count() == 6
    assert warehouse.compact(spark, path, now) == 1
    assert warehouse.read(spark, path).count() == 6
    warehouse.append_batch(old, path, 0)
    assert warehouse.read(spark, path).count() == 6
    warehouse.create_table(spark, "sink_test", path)
    try:
        assert spark.table("sink_test").count() == 6 and spark.table("sink_test").where("app_id = 'app-2' and hour = 17").count() == 1
    finally:
        spark.sql("DROP TABLE sink_test")
    gone = warehouse.drop_before(spark, path, DAY.replace(day=5, hour=17), 23)
    assert gone and all("hour=17" in p for p in gone)
    assert [(r["hour"]) for r in warehouse.read(spark, path).collect()] == [18]


def test_sinks_do_not_touch_each_other(spark, tmp_path):
    """Two sinks, and one with a new checkpoint, number their batches from 0 each."""
    path = f"file://{tmp_path}/w"
    for sink in ("a", "b", "a-again"):
        for number in (0, 1, 1):
            warehouse.append_batch(event_rows(spark, *FIVE), path, number, sink=sink)
    assert warehouse.read(spark, path).count() == 30
    assert sorted(os.listdir(tmp_path / "w/_sinks"))[-1] == "b" and not os.listdir(tmp_path / "w/_pending")
    assert len([x for x in os.listdir(tmp_path / "w/_sinks") if not x.startswith(".")]) == 3  # one mark a sink, however many batches


@pytest.mark.parametrize("broken", ["move", "mark", "write"])
def test_a_batch_that_broke_off_is_unseen_and_ends_once(spark, tmp_path, monkeypatch, broken):
    path = f"file://{tmp_path}/w"
    warehouse.append_batch(event_rows(spark, *FIVE[:2]), path, 0)
    moved, real_move, real_write = [], warehouse.Files.move, warehouse.Files.write

    def move(self, a, b):
        if len(moved) == 2:
            raise OSError("lost")
        moved.append(a)
        real_move(self, a, b)

    def write(self, p, text):
        if "_sinks" in p if broken == "mark" else "_pending" in p:
            real_write(self, p, text[: len(text) // 2] if broken == "write" else "")
            raise OSError("lost")
        real_write(self, p, text)

    monkeypatch.setattr(warehouse.Files, *("move", move) if broken == "move" else ("write", write))
    with pytest.raises(OSError):
        warehouse.append_batch(event_rows(spark, *FIVE), path, 1)
    monkeypatch.undo()
    assert warehouse.read(spark, path).count() == 2
    assert warehouse.compact(spark, path, DAY.replace(day=20)) == 0
    for _ in range(2):
        warehouse.append_batch(event_rows(spark, *FIVE), path, 1)
        assert warehouse.read(spark, path).count() == 7


def test_compaction_keeps_each_files_codec(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    for name, app in (("zstd", "app-1"), ("zstd", "app-1"), ("gzip", "app-2"), ("gzip", "app-2"), ("none", "app-3"), ("none", "app-3")):
        warehouse.append(event_rows(spark, (app, DAY)), path, name)
    assert warehouse.compact(spark, path, DAY.replace(day=20), files_at_once=3) == 3
    assert [(f.split("/")[0][-1], f.rsplit(".", 2)[1][:4]) for f in files(tmp_path / "w") if "compacted" in f] == [("1", "zstd"), ("2", "gz"), ("3", files(tmp_path / "w")[-1].rsplit(".", 2)[1][:4])]
    assert "snappy" not in files(tmp_path / "w")[-1]


def test_unreadable_files_are_found_by_halves(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    for _ in range(9):
        warehouse.append(event_rows(spark, ("a", DAY)), path)
    own = [f"{path}/{f}" for f in files(tmp_path / "w")]
    for f in (own[2], own[7]):
        (tmp_path / f.split(str(tmp_path) + "/")[1]).write_bytes(b"PAR1")
    assert warehouse._unreadable(spark, own) == {own[2], own[7]}


def test_a_cut_within_an_hour(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    at = [DAY.replace(minute=m) for m in (0, 12, 12, 59)]
    warehouse.append(event_rows(spark, *[("app é=1", t) for t in at], ("b", DAY.replace(hour=16)), ("b", DAY.replace(hour=18))), path, "zstd")
    untouched = [f for f in files(tmp_path / "w") if "hour=18" in f]
    warehouse.append(event_rows(spark, ("b", DAY.replace(minute=40))), path)
    assert warehouse.keep_since(spark, path, DAY.replace(minute=12)) == (1, 1)
    left = warehouse.read(spark, path).select("app_id", "timestamp_ms").collect()
    assert len(left) == 5 and min(r["timestamp_ms"] for r in left) == int((DAY.replace(minute=12) - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert set(untouched) < set(files(tmp_path / "w")) and any("cut-" in f and "zstd" in f for f in files(tmp_path / "w"))
    assert warehouse.keep_since(spark, path, DAY.replace(minute=12)) == (0, 0)
    assert warehouse.keep_since(spark, path, DAY.replace(day=9))[0] == 3 and warehouse.read(spark, path).count() == 0
