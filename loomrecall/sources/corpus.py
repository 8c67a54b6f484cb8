"""Record corpora: JSON lines, JSON snapshots, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrecall.session import materialize

_IDENTITY = "struct<namespace:string,leafName:string,parentContext:string,stableKey:string>"
RECORD = f"id string, scope string, provenance struct<source:string,timestamp:string,adapter:string,origin:string>, identity {_IDENTITY}, content string, metadata struct<createdAt:string,updatedAt:string,sourcePath:string>, lifecycle string"


def _active(rows: DataFrame) -> DataFrame:
    """Records with defaults; ``content`` may be a string or an object; tombstones are skipped."""
    body = F.try_parse_json("content")
    is_object = F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False))
    text = F.when(is_object, F.try_variant_get(body, "$.text", "string")).otherwise(F.col("content"))
    structured = F.when(is_object, F.to_json(F.try_variant_get(body, "$.structured", "variant")))
    kept = rows.where(F.col("id").isNotNull() & (F.coalesce("lifecycle", F.lit("active")) != "deleted"))
    return kept.select(
        "id", F.coalesce("scope", F.lit("project")).alias("scope"), F.coalesce("identity.namespace", F.lit("default")).alias("namespace"), F.col("identity.leafName").alias("leaf_name"), F.col("identity.parentContext").alias("parent_context"),
        F.col("provenance.source").alias("source"), text.alias("text"), structured.alias("structured"), F.col("metadata.updatedAt").alias("updated_at"), *[c for c in rows.columns if c.startswith("_at_")],
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Active records of a JSON-lines corpus; of one id the last active line counts, by file and position. A broken line is an error; ``broken_lines`` lists them."""
    rows = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_at_file"), F.monotonically_increasing_id().alias("_at_line"))
    last = _active(placed).groupBy("id").agg(F.max_by(F.struct("scope", "namespace", "leaf_name", "parent_context", "source", "text", "structured", "updated_at"), F.struct("_at_file", "_at_line")).alias("r"))
    return last.select("id", "r.*")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the lines of a JSON-lines corpus that are no JSON objects."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("trim(value) <> ''")
    return lines.where(~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Active records of JSON snapshots of the form {version, records: [...]}."""
    doc = spark.read.schema(f"version int, records array<struct<{RECORD.replace(' struct', ':struct').replace(' string', ':string').replace(f'identity {_IDENTITY}', f'identity:{_IDENTITY}')}>>").option("multiLine", "true").json(path)
    return _active(doc.select(F.inline("records")))


def write_jsonl(records: DataFrame, path: str) -> None:
    """Records as JSON lines; the committer makes the folder appear as a whole."""
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.mode("overwrite").text(path)


def bucketed_store(records: DataFrame, path: str, buckets: int = 16) -> None:
    """Upsert by id, overwriting only the buckets that ``records`` touch; their other rows stay. The unit of replacement is a hash bucket of the id.

    ``buckets`` is fixed by the first write and should grow with the store (a bucket of some 100 MB). The merged buckets are written beside
    the store first, so that they are never read and overwritten at once.
    """
    spark = records.sparkSession
    keyed = records.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast(T.IntegerType()))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        keyed = materialize(keyed, "store-new")
        touched = F.broadcast(keyed.select("bucket").distinct())  # at most ``buckets`` rows
        stays = spark.read.parquet(path).join(touched, "bucket", "left_semi").join(keyed.select("id"), "id", "left_anti")
        keyed = materialize(stays.unionByName(keyed, allowMissingColumns=True).select(*keyed.columns), "store-merged")
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    spark.catalog.refreshByPath(path)
