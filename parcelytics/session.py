"""Session settings the operators rely on, and the reliable checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Folders of the tables frozen by this process.
FROZEN: list[str] = []


def build_session(app_name: str = "parcelytics", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; `master` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def partitions_for(input_bytes: float, per_partition: int = 128 * 1024 * 1024) -> str:
    """Value of spark.sql.shuffle.partitions for an input of that size: AQE merges small partitions but never splits them."""
    return str(max(200, min(int(input_bytes / per_partition), 100_000)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a throw-away local one only in local mode when none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="parcelytics-checkpoint-")
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def freeze(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and read it back.

    Later steps see one fixed version of the rows, their lineage ends here, a lost executor costs a re-read, and the
    optimizer knows the real size of the table. The table stays until `clear_frozen`.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/frozen-{uuid.uuid4().hex}"
    df.write.parquet(path)
    FROZEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_frozen(spark: SparkSession) -> int:
    """Delete the tables frozen so far by this process; call it once the results that read them are written."""
    jvm, count = spark.sparkContext._jvm, 0
    while FROZEN:
        path = jvm.org.apache.hadoop.fs.Path(FROZEN.pop())
        count += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return count
