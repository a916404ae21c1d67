"""Streams over several files: many batches, late rows, restarts from the same checkpoint, no rows at all."""

from __future__ import annotations

import os
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parcelytics.streaming import jobs

SCHEMA = "user_id long, event_id long, ts timestamp, value double"
START = datetime(2024, 1, 1)


def rows_of(batch: int):
    """30 events of 5 users; every batch is two days on, and one of its rows is 20 hours late."""
    out = [(i % 5, batch * 100 + i, START + timedelta(days=2 * batch, hours=i), float(i * batch % 7)) for i in range(30)]
    return out[:-1] + [(4, batch * 100 + 29, START + timedelta(days=2 * batch, hours=9), 1.0)]


def put(spark, folder, batch):
    """One Parquet file; its time decides when the stream reads it."""
    part = f"{folder}-parts/{batch}"
    spark.createDataFrame(rows_of(batch), SCHEMA).coalesce(1).write.parquet(part)
    os.makedirs(folder, exist_ok=True)
    name = next(n for n in os.listdir(part) if n.endswith(".parquet"))
    os.link(f"{part}/{name}", f"{folder}/{batch}.parquet")
    os.utime(f"{folder}/{batch}.parquet", (time.time() - 1000 + batch,) * 2)


@pytest.fixture
def folder(spark, tmp_path):
    for batch in range(3):
        put(spark, f"{tmp_path}/in", batch)
    return str(tmp_path)


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def latest(batches):
    best = {}
    for b in range(batches):
        for user, event, ts, value in rows_of(b):
            if user not in best or (ts, event) > best[user][:2]:
                best[user] = (ts, event, value)
    return {u: v[1] for u, v in best.items()}


def test_latest_per_key_with_restart(spark, folder):
    run = lambda: jobs.run_latest_per_key(spark, f"{folder}/in/*.parquet", schema(spark), f"{folder}/work", ["user_id"], ["ts", "event_id"], files_per_trigger=1)
    assert {r["user_id"]: r["event_id"] for r in run().collect()} == latest(3)
    assert len(jobs._manifest(spark, f"{folder}/work")) == 1  # a small table needs one bucket
    assert {r["user_id"]: r["event_id"] for r in run().collect()} == latest(3)  # nothing new
    put(spark, f"{folder}/in", 3)
    assert {r["user_id"]: r["event_id"] for r in run().collect()} == latest(4)
    versions = {n for n in os.listdir(f"{folder}/work") if n[0] == "v"}
    assert f"v{0}" not in versions  # every user had newer rows, so the first versions are gone


def test_replayed_batch_changes_nothing(spark, folder):
    sink = jobs.upsert_latest(f"{folder}/own", ["user_id"], ["ts", "event_id"])
    for b in (0, 1, 1, 2, 2):
        sink(spark.createDataFrame(rows_of(b), SCHEMA), b)
    got = jobs._read(spark, f"{folder}/own", jobs._manifest(spark, f"{folder}/own"), schema(spark))
    assert {r["user_id"]: r["event_id"] for r in got.collect()} == latest(3)


def test_window_counts_of_many_batches(spark, folder):
    got = jobs.run_window_counts(spark, f"{folder}/in/*.parquet", schema(spark), f"{folder}/counts", "user_id", "ts", "1 day", files_per_trigger=1)
    want = Counter((ts.replace(hour=0), user) for b in range(3) for user, _, ts, _ in rows_of(b))
    assert {(r["window_start"].replace(tzinfo=None), r["user_id"]): r["n"] for r in got.collect()} == dict(want)


def test_quota_of_many_batches(spark, folder):
    run = lambda: jobs.run_quota(spark, f"{folder}/in/*.parquet", schema(spark), f"{folder}/quota", "user_id", "event_id", "ts", 3, files_per_trigger=1)
    run()
    put(spark, f"{folder}/in", 3)
    got = {r["event_id"]: r["used"] for r in run().collect()}
    everything = [r for b in range(4) for r in rows_of(b)]
    for b in range(4):
        seen = [r for r in everything if r[1] < (b + 1) * 100]  # what had come by then
        for user, event, ts, _ in rows_of(b):
            assert got[event] == sum(u == user and ts - timedelta(days=3) <= at <= ts for u, _, at, _ in seen)


def test_empty_streams(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in/*.parquet", schema(spark))
    assert jobs.run_latest_per_key(*args, f"{tmp_path}/a", ["user_id"], ["ts"]).collect() == []
    assert jobs.run_window_counts(*args, f"{tmp_path}/b", "user_id", "ts", "1 day").collect() == []
    assert jobs.run_quota(*args, f"{tmp_path}/c", "user_id", "event_id", "ts", 3).collect() == []


def test_buckets_follow_the_size_of_the_table(spark, tmp_path):
    """Splits while batches arrive, batches that touch few buckets, a replayed batch, and the latest row per key at every point."""
    rng = random.Random(6)
    sink = jobs.upsert_latest(f"{tmp_path}/t", ["k"], ["ts"], bucket_rows=40)
    latest, shape = {}, "k long, ts long, v string"
    for batch_id in range(7):
        keys = [rng.randrange(800) for _ in range(150)] if batch_id not in (0, 5) else [rng.randrange(20)]
        rows = [(k, batch_id * 1000 + i, f"{batch_id}.{i}") for i, k in enumerate(keys)]
        before = jobs._manifest(spark, f"{tmp_path}/t")
        for _ in range(2 if batch_id == 3 else 1):  # the same batch again leaves the same table
            sink(spark.createDataFrame(rows, shape), batch_id)
        latest |= {k: (k, ts, v) for k, ts, v in rows}
        manifest = jobs._manifest(spark, f"{tmp_path}/t")
        table = jobs._read(spark, f"{tmp_path}/t", manifest, spark.createDataFrame([], shape).schema)
        assert sorted(map(tuple, table.collect())) == sorted(latest.values())
        assert sum(rows for _, rows in manifest.values()) == len(latest)
        finest = max(bits for bits, _ in manifest)
        assert sum(1 << (finest - bits) for bits, _ in manifest) == 1 << finest  # every hash has one bucket
        if batch_id == 5:  # one key rewrites the bucket it falls into, split or not
            assert len([leaf for leaf, entry in before.items() if manifest.get(leaf) != entry]) == 1
    assert len(manifest) > 8
