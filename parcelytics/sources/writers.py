"""Sinks: provenance sidecar, category files, multi-table cleaning output, append-only run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelytics.operators import rules


def write_with_provenance(df: DataFrame, path: str, meta: dict[str, str]) -> None:
    """The table as Parquet and its provenance as a one-row sidecar table next to it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    pairs = F.create_map(*[F.lit(str(x)) for item in meta.items() for x in item])
    df.sparkSession.range(1).select(pairs.alias("meta")).write.mode("overwrite").parquet(f"{path}/provenance")


def write_commented_csv(df: DataFrame, path: str, meta: dict[str, str]) -> None:
    """CSV parts and a text part holding `# key=value` lines, for readers that expect the commented form."""
    df.write.mode("overwrite").option("header", True).csv(path)
    lines = [(f"# {key}={value}",) for key, value in meta.items()]
    df.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(path)


def write_category(df: DataFrame, path: str, category: str) -> None:
    """One folder per category; rows of a category stay together, and AQE cuts a large one over tasks by its size."""
    df.hint("rebalance", category).write.mode("overwrite").partitionBy(category).parquet(path)


def write_cleaned(flagged: DataFrame, path: str) -> None:
    """Clean rows, dropped rows with their reason, and the counts per reason."""
    rules.kept(flagged).write.mode("overwrite").parquet(f"{path}/clean")
    rules.dropped(flagged).write.mode("overwrite").parquet(f"{path}/dropped")
    summary = flagged.groupBy(F.coalesce("drop_rule", F.lit("kept")).alias("drop_rule")).agg(F.count("*").alias("n"))
    summary.write.mode("overwrite").parquet(f"{path}/summary")


def append_run_log(df: DataFrame, path: str, dataset: str, timestamp: str) -> None:
    """Append experiment rows to one log table."""
    stamped = df.withColumn("dataset", F.lit(dataset)).withColumn("logged_at", F.lit(timestamp).cast("timestamp"))
    stamped.write.mode("append").parquet(path)
