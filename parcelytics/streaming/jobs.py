"""Structured Streaming forms of the usage operators; each `build_*` works on any stream, `run_*` drains a folder."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from parcelytics.plans.scale import keep_last, maybe_broadcast


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; the last part of `path` is a name or a pattern of names in its folder."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def build_window_counts(stream: DataFrame, key: str, ts: str, width: str, late: str = "1 hour") -> DataFrame:
    """Events per key and time window, with a watermark bounding the state."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    counts = timed.groupBy(F.window("__ts", width), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n")


def run_window_counts(spark: SparkSession, path: str, schema: StructType, work: str, key: str, ts: str, width: str, files_per_trigger: int | None = None) -> DataFrame:
    """Drain the files into an update-mode upsert table and return the final counts."""
    counts = build_window_counts(file_stream(spark, path, schema, files_per_trigger), key, ts, width)
    return _drain_upsert(counts, work, ["window_start", key], ["n"], "update")


def _quota_step(user: str, event: str, span_us: int, late_us: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at_us", event])
        known = sorted(times + rows["at_us"].tolist())
        used = [bisect.bisect_right(known, at) - bisect.bisect_left(known, at - span_us) for at in rows["at_us"]]
        newest = known[-1]
        state.update(([x for x in known if x >= newest - span_us - late_us],))
        state.setTimeoutTimestamp(max((newest + span_us + late_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({event: rows[event].to_numpy(), user: [key[0]] * len(rows), "used": used})

    return step


def build_quota(stream: DataFrame, user: str, event: str, ts: str, days: int, late_days: int = 1) -> DataFrame:
    """Trailing count per event. The state of a user holds the times of one period and of the lateness allowed, and goes
    when both have passed. An event up to `late_days` behind the newest one is counted among all that came before it;
    counts already given don't change; later events are dropped by the watermark. Rows without a time are left out."""
    span, late = days * 86_400_000_000, late_days * 86_400_000_000
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    at = F.col(ts).cast("timestamp")
    timed = stream.select(user, event, at.alias("at"), F.unix_micros(at).alias("at_us")).filter("at IS NOT NULL").withWatermark("at", f"{late_days} days")
    return timed.groupBy(user).applyInPandasWithState(
        _quota_step(user, event, span, late), f"{event} {kinds[event]}, {user} {kinds[user]}, used long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def run_quota(spark: SparkSession, path: str, schema: StructType, work: str, user: str, event: str, ts: str, days: int, files_per_trigger: int | None = None) -> DataFrame:
    """Drain the files that haven't been read yet; a run with the same `work` folder goes on where the last one ended."""
    out = build_quota(file_stream(spark, path, schema, files_per_trigger), user, event, ts, days)
    q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start(f"{work}/table")
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{work}/table")


#: Rows of a bucket of an upserted table beyond which it is split when it is next written.
BUCKET_ROWS = 1_000_000


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _manifest(spark: SparkSession, work: str, before: int | None = None) -> dict[tuple[int, int], tuple[int, int]]:
    """(bits, bucket) -> (version, rows) of the newest finished batch (below `before`); one row per bucket.

    A bucket holds the keys whose hash ends in these bits; buckets of different bits together cover every hash once.
    """
    fs, at = _folder(spark, f"{work}/manifest")
    if not fs.exists(at):
        return {}
    ids = [int(s.getPath().getName()) for s in fs.listStatus(at) if fs.exists(_folder(spark, f"{s.getPath()}/_SUCCESS")[1])]
    ids = [i for i in ids if before is None or i < before]
    if not ids:
        return {}
    return {(r["bits"], r["bucket"]): (r["version"], r["rows"]) for r in spark.read.parquet(f"{work}/manifest/{max(ids)}").collect()}


def _read(spark: SparkSession, work: str, manifest: dict[tuple[int, int], tuple[int, int]], schema: StructType) -> DataFrame:
    paths = [f"{work}/v{version}/__bucket={bits}-{bucket}" for (bits, bucket), (version, rows) in sorted(manifest.items()) if rows]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _bits_for(rows: int, limit: int) -> int:
    return max(0, math.ceil(math.log2(rows / limit))) if rows else 0


def _with_buckets(df: DataFrame, keys: Sequence[str], leaves: Sequence[tuple[int, int]]) -> DataFrame:
    """`df` with `__bucket` ('bits-bucket') of each row; the table of all hash endings has a few rows per bucket."""
    finest = max(bits for bits, _ in leaves)
    endings = [(bucket + (k << bits), f"{bits}-{bucket}") for bits, bucket in leaves for k in range(1 << (finest - bits))]
    table = df.sparkSession.createDataFrame(endings, "__end long, __bucket string")
    return df.withColumn("__end", F.pmod(F.xxhash64(*keys), F.lit(1 << finest))).join(maybe_broadcast(table), "__end").drop("__end")


def upsert_latest(work: str, keys: Sequence[str], order: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: merge a batch into a latest-per-key table of hash buckets, whose number follows its size.

    A batch writes new versions of the buckets it touches and then a manifest of all buckets' versions; a bucket that has grown
    beyond `bucket_rows` is split by further bits of the hash when it is written, the others stay as they are. Both are fixed by
    the batch's id and built from the manifest before it, so a replayed batch writes the same again. Versions that neither
    this manifest nor the one before names are deleted.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, work, batch_id)
        batch = batch.persist()
        if not before:
            bits = _bits_for(batch.count(), bucket_rows)
            before = {(bits, b): (-1, 0) for b in range(1 << bits)}
        tagged = _with_buckets(batch, keys, list(before))
        touched = {tuple(map(int, r[0].split("-"))) for r in tagged.select("__bucket").distinct().collect()}
        after = dict(before)
        if touched:
            written = []
            for bits, bucket in touched:
                more = _bits_for(before[bits, bucket][1], bucket_rows)
                written += [(bits + more, bucket + (k << bits)) for k in range(1 << more)]
                del after[bits, bucket]
            old = _read(spark, work, {leaf: before[leaf] for leaf in touched}, batch.schema)
            leaves = [*written, *(leaf for leaf in before if leaf not in touched)]
            merged = keep_last(old.unionByName(batch), keys, [F.col(c) for c in order])
            _with_buckets(merged, keys, leaves).write.mode("overwrite").partitionBy("__bucket").parquet(f"{work}/v{batch_id}")
            counts = spark.read.schema("__bucket string").parquet(f"{work}/v{batch_id}").groupBy("__bucket").agg(F.count("*").alias("n"))
            rows = {r["__bucket"]: r["n"] for r in counts.collect()}
            after |= {(bits, bucket): (batch_id, rows.get(f"{bits}-{bucket}", 0)) for bits, bucket in written}
        batch.unpersist()
        listed = spark.createDataFrame([(*leaf, *entry) for leaf, entry in sorted(after.items())], "bits int, bucket long, version int, rows long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{work}/manifest/{batch_id}")
        fs, at = _folder(spark, work)
        named = {version for version, _ in (*before.values(), *after.values())}
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if name[0] == "v" and name[1:].isdigit() and int(name[1:]) < batch_id and int(name[1:]) not in named:
                fs.delete(status.getPath(), True)

    return sink


def run_latest_per_key(spark: SparkSession, path: str, schema: StructType, work: str, keys: Sequence[str], order: Sequence[str],
                       prepare: Callable[[DataFrame], DataFrame] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Drain the files that haven't been read yet into a latest-per-key table."""
    stream = file_stream(spark, path, schema, files_per_trigger)
    stream = prepare(stream) if prepare else stream
    return _drain_upsert(stream, work, keys, order, "append")


def _drain_upsert(stream: DataFrame, work: str, keys: Sequence[str], order: Sequence[str], mode: str) -> DataFrame:
    """Run to the end of what is there; the checkpoint stays in `work`, so a restart reads only new files."""
    spark = stream.sparkSession
    q = (stream.writeStream.outputMode(mode).foreachBatch(upsert_latest(work, keys, order)).option("checkpointLocation", f"{work}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return _read(spark, work, _manifest(spark, work), stream.schema)
