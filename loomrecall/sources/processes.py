"""Runtime process records: a folder of JSON files, broken ones set aside, and their state by heartbeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROCESS = "id string, role string, serverName string, pid int, ppid int, cwd string, runtimeVersion string, startedAt timestamp, lastHeartbeatAt timestamp, _broken string"


def read_processes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, malformed files)."""
    rows = spark.read.schema(PROCESS).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    named = rows.withColumn("file", F.col("_metadata.file_path"))
    bad = F.col("_broken").isNotNull() | F.col("id").isNull() | F.col("pid").isNull()
    return named.where(~bad).drop("_broken"), named.where(bad).select("file")


def process_state(alive: Column, heartbeat: Column, now: Column, stale_after_s: int = 60) -> Column:
    """active, heartbeat-stale, heartbeat-missing or pid-not-running."""
    late = F.unix_millis(now) - F.unix_millis(heartbeat) > F.lit(stale_after_s * 1000)
    return F.when(~alive, "pid-not-running").when(heartbeat.isNull(), "heartbeat-missing").when(late, "heartbeat-stale").otherwise("active")


def duplicate_roles(records: DataFrame, state: str = "state") -> DataFrame:
    """Roles of active processes that more than one of them holds, with the least and greatest start."""
    return records.where(F.col(state) == "active").groupBy("role", "cwd").agg(F.count(F.lit(1)).alias("n"), F.min("startedAt").alias("first"), F.max("startedAt").alias("last")).where("n > 1")
