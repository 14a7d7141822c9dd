"""State in key buckets, watermarks, restarts and new checkpoints."""

import datetime as dt
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from valorum.streaming import streams as sm

EDITS = "ticker string, event_time timestamp_ntz, id long, ke double"
QUOTES = "ticker string, ts timestamp_ntz, close double"
DAY0 = dt.datetime(2024, 1, 1)


def at(day, hour=0):
    return DAY0 + dt.timedelta(days=day, hours=hour)


def land(spark, folder, name, rows, schema):
    """One more file of a source folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def files(state):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{state}/current/*/*.parquet")}


def edits(spark, state):
    return {r.ticker: (r.id, r.ke) for r in sm.read_state(spark, state).collect()}


def run_edits(spark, work, src, checkpoint):
    q = sm.stream_assumptions(source(spark, src, EDITS), f"{work}/state", f"{work}/log", checkpoint, buckets=8)
    q.awaitTermination()
    return q


def test_new_checkpoint_loses_neither_state_nor_log(spark, tmp_path):
    work = str(tmp_path)
    land(spark, work + "/s1", "a", [("A", at(1), 1, 0.1), ("B", at(1), 2, 0.2)], EDITS)
    run_edits(spark, work, work + "/s1", work + "/c1")
    land(spark, work + "/s2", "a", [("C", at(2), 3, 0.3), ("A", at(0), 9, 0.9)], EDITS)  # C is new, A's edit is late
    run_edits(spark, work, work + "/s2", work + "/c2")
    assert edits(spark, work + "/state") == {"A": (1, 0.1), "B": (2, 0.2), "C": (3, 0.3)}
    assert spark.read.parquet(work + "/log").count() == 4
    # A checkpoint that was lost and made anew under its old path replays everything: same state.
    land(spark, work + "/s1", "b", [("B", at(3), 4, 0.4)], EDITS)
    run_edits(spark, work, work + "/s1", work + "/c3")
    run_edits(spark, work, work + "/s1", work + "/c1")
    assert edits(spark, work + "/state") == {"A": (1, 0.1), "B": (4, 0.4), "C": (3, 0.3)}


def test_batches_are_merged_in_small_splits(spark, tmp_path, monkeypatch):
    """A task's sort is as large as its split, however large the batch; the caller's session keeps its setting."""
    work, seen, merge = str(tmp_path), [], sm.merge_batch
    monkeypatch.setattr(sm, "SPLIT_BYTES", 4096)
    monkeypatch.setattr(sm, "merge_batch", lambda changes, *a, **b: (seen.append(changes.rdd.getNumPartitions()), merge(changes, *a, **b)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    land(spark, work + "/s", "a", [(f"K{i % 50}", at(i % 7, i % 24), i, i / 7) for i in range(3000)], EDITS)
    run_edits(spark, work, work + "/s", work + "/c")
    size = sum(os.path.getsize(f) for f in glob.glob(f"{work}/log/*/*/*.parquet"))
    assert size > 3 * 4096 and min(seen) >= size // 4096
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert len(edits(spark, work + "/state")) == 50


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    work = str(tmp_path)
    land(spark, work + "/s", "a", [(f"K{i}", at(1), i, 0.1) for i in range(200)], EDITS)
    run_edits(spark, work, work + "/s", work + "/c")
    before = files(work + "/state")
    assert len(before) == 8  # one file for each bucket
    land(spark, work + "/s", "b", [("K7", at(2), 900, 0.7)], EDITS)
    run_edits(spark, work, work + "/s", work + "/c")
    after = files(work + "/state")
    assert len(after) == 8 and len(set(before.items()) & set(after.items())) == 7
    assert edits(spark, work + "/state")["K7"] == (900, 0.7) and sm.read_state(spark, work + "/state").count() == 200
    state = spark.read.parquet(work + "/state/current")
    plan = state.where(F.col("bucket_of_8").isin(3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket_of_8" in plan.replace("PartitionFilters: [isnotnull(bucket_of_8#", "PartitionFilters: [bucket_of_8#")
    read = sm.read_state(spark, work + "/state")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in read and "Window" not in read and "Aggregate" not in read
    with pytest.raises(ValueError):
        sm.merge_batch(spark.createDataFrame([("Z", at(1), 1, 0.1)], EDITS), 0, work + "/state", "w", order_by=sm.EDIT_ORDER, buckets=16)


def test_replay_after_a_crash_between_the_steps(spark, tmp_path):
    state = str(tmp_path / "state")
    merge = lambda rows, b: sm.merge_batch(spark.createDataFrame(rows, EDITS), b, state, "w", order_by=sm.EDIT_ORDER, buckets=2)
    merge([(f"K{i}", at(1), i, 0.1) for i in range(20)], 0)
    second = [(f"K{i}", at(2), 100 + i, 0.2) for i in range(20)]
    merge(second, 1)
    want = edits(spark, state)
    # Buckets gone while they were replaced: the marked content stands aside.
    shutil.rmtree(glob.glob(f"{state}/current/bucket_of_2=*")[0])
    merge(second, 1)
    assert edits(spark, state) == want and len(want) == 20
    # No mark: the batch is merged from its rows.
    shutil.rmtree(f"{state}/marks/w/slot=1")
    merge(second, 1)
    assert edits(spark, state) == want
    merge([], 2)  # a batch without rows
    merge([], 2)
    assert edits(spark, state) == want


def kept_rows(batches, delay):
    """What the watermark leaves: a day is closed once it ends at or before the newest time less the delay.

    Newest of the batches before the last one: Spark drops late rows by the watermark that the last batch ran with.
    """
    newest, kept, late, marks = None, [], 0, [None]
    for rows in batches:
        mark = marks[-1]
        marks.append(None if newest is None else newest - delay)
        for r in rows:
            end = dt.datetime(r[1].year, r[1].month, r[1].day) + dt.timedelta(days=1)
            if mark is None or end > mark:
                kept.append(r)
            else:
                late += 1
        times = [r[1] for r in rows]
        newest = max([t for t in (newest, *times) if t is not None])
    return kept, late


def newest(rows):
    out = {}
    for k, t, c in rows:
        if c is not None and (k not in out or (t, c) > out[k]):
            out[k] = (t, c)
    return out


def test_watermark_late_rows_and_restart(spark, tmp_path):
    work, delay = str(tmp_path), dt.timedelta(days=2)
    batches = [
        [("A", at(1), 1.0), ("B", at(2), 2.0), ("A", at(1, 5), 1.5), ("N", at(2), None)],
        [("A", at(10), 3.0), ("C", at(10, 1), 4.0)],
        [("G", at(2), 1.0), ("G", at(10), 2.0)],  # day 2 is still open here
        [("B", at(8, 13), 5.0), ("D", at(9), 6.0), ("E", at(3), 7.0), ("B", at(4), 8.0)],  # two inside, two beyond
        [("A", at(9, 20), 9.0), ("C", at(10, 1), 4.5), ("F", at(6), 1.0)],  # older than A's newest; a tie in time; beyond
    ]
    for i, rows in enumerate(batches[:4]):
        land(spark, work + "/s", f"b{i}", rows, QUOTES)
    go = lambda: sm.stream_latest_quote(source(spark, work + "/s", QUOTES), work + "/state", work + "/c", delay="2 days", buckets=4)
    q = go()
    q.awaitTermination()
    kept, late = kept_rows(batches[:4], delay)
    state = lambda: {r.ticker: (r.last_ts, r.price) for r in sm.read_state(spark, work + "/state").collect()}
    assert state() == newest(kept) and sm.late_groups(q) == late == 2
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 5  # closed days have left the store
    # Restarted from the checkpoint, the watermark still holds.
    land(spark, work + "/s", "b4", batches[4], QUOTES)
    q = go()
    q.awaitTermination()
    kept, late = kept_rows(batches, delay)
    assert late == 3 and sm.late_groups(q) == 1 and state() == newest(kept)
    assert state()["A"] == (at(10), 3.0) and state()["C"] == (at(10, 1), 4.5) and "E" not in state()


def test_nothing_late_equals_batch(spark, tmp_path):
    work = str(tmp_path)
    rows = [(f"T{i % 7}", at(i % 9, i % 24), None if i % 5 == 0 else float(i % 13)) for i in range(300)]
    for i in range(3):
        land(spark, work + "/s", f"b{i}", rows[i::3], QUOTES)
    q = sm.stream_latest_quote(source(spark, work + "/s", QUOTES), work + "/state", work + "/c", delay="30 days", buckets=4)
    q.awaitTermination()
    assert {r.ticker: (r.last_ts, r.price) for r in sm.read_state(spark, work + "/state").collect()} == newest(rows)
    assert sm.late_groups(q) == 0
