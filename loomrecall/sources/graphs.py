"""Graph exports and reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT = (
    "nodes array<struct<id:string,label:string,file_type:string,source_file:string,source_location:string,community:int,norm_label:string>>, "
    "links array<struct<source:string,target:string,_src:string,_tgt:string,relation:string,confidence:string,confidence_score:double,weight:double,source_file:string,source_location:string>>"
)


def read_export(spark: SparkSession, path: str, base: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON exports. Rows without id, label, end or relation are left out; paths below ``base`` become relative; edge ids are hashes of their parts."""
    doc = spark.read.schema(EXPORT).option("multiLine", "true").json(path)
    rel = lambda c: F.when(F.lit(bool(base)) & F.col(c).startswith(base.rstrip("/") + "/"), F.substring(c, len(base.rstrip("/")) + 2, 100000)).otherwise(F.col(c))
    nodes = doc.select(F.inline("nodes")).where("id is not null and label is not null").withColumn("source_file", rel("source_file"))
    nodes = nodes.withColumn("line", F.regexp_extract("source_location", r"^L(\d+)$", 1).try_cast("int"))
    links = doc.select(F.inline("links")).withColumns({"source": F.coalesce("source", "_src"), "target": F.coalesce("target", "_tgt")}).where("source is not null and target is not null and relation is not null")
    key = F.substring(F.sha1(F.concat_ws("\0", "source", "relation", "target")), 1, 24)
    edges = links.select(key.alias("id"), "source", "target", "relation", F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"), F.coalesce("confidence_score", F.lit(1.0)).alias("confidence_score"), F.coalesce("weight", F.lit(1.0)).alias("weight"), rel("source_file").alias("source_file"), "source_location")
    return nodes.groupBy("id").agg(F.first(F.struct(*[c for c in nodes.columns if c != "id"])).alias("r")).select("id", "r.*"), edges.dropDuplicates(["id"])


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Communities of markdown reports: community, name, cohesion, nodes."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^#{2,4} Community \d+[^\n]*(?:\n(?!#)[^\n]*)*"), F.lit(0))).alias("b"))
    grab = lambda p: F.regexp_extract("b", p, 1)
    return blocks.select(grab(r"Community (\d+)").cast("int").alias("community"), F.trim(grab(r"Community \d+\s*[-–:]?\s*\"?([^\"\n(]*)")).alias("name"), grab(r"(?i)cohesion:?\*{0,2}\s*([\d.]+)").try_cast("double").alias("cohesion"), grab(r"(?i)nodes(?: \((\d+)\))").try_cast("int").alias("nodes"))
