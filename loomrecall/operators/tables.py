"""The current row of each entity: exact copies and superseded rows fall away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order`` (nulls last). ``order`` should break ties; exact copies may tie."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def current_files(files: DataFrame) -> DataFrame:
    return newest(files, ["id"], ["updated_at", "mtime_ms", "content_hash"])


def current_chunks(chunks: DataFrame) -> DataFrame:
    return newest(chunks, ["id"], ["updated_at", "chunk_hash", "search_text"])


def current_records(records: DataFrame) -> DataFrame:
    """Active memory records with flat columns; tombstones are skipped and do not retract an older active row."""
    flat = records.where(F.coalesce("lifecycle", F.lit("active")) != "deleted").select(
        "id", "scope", F.col("identity.namespace").alias("namespace"), F.col("identity.leaf_name").alias("leaf_name"), F.col("identity.parent_context").alias("parent_context"), F.col("identity.stable_key").alias("stable_key"),
        F.col("provenance.source").alias("source"), F.col("provenance.adapter").alias("adapter"), F.col("provenance.origin").alias("origin"), F.col("content.text").alias("text"), F.col("content.structured").alias("structured"),
        F.col("metadata.created_at").alias("created_at"), F.col("metadata.updated_at").alias("updated_at"), F.col("metadata.source_path").alias("source_path"),
    )
    return newest(flat, ["id"], ["updated_at", "text", "structured"])


#: The same in SQL, for the queries' SQL.
FILES_SQL = "files AS (SELECT * FROM file_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, mtime_ms DESC NULLS LAST, content_hash DESC NULLS LAST) = 1)"
CHUNKS_SQL = "chunks AS (SELECT * FROM indexed_chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, chunk_hash DESC NULLS LAST, search_text DESC NULLS LAST) = 1)"
RECORDS_SQL = """records AS (SELECT id, scope, identity.namespace AS namespace, identity.leaf_name AS leaf_name, identity.parent_context AS parent_context, identity.stable_key AS stable_key,
  provenance.source AS source, provenance.adapter AS adapter, provenance.origin AS origin, content.text AS text, content.structured AS structured,
  metadata.created_at AS created_at, metadata.updated_at AS updated_at, metadata.source_path AS source_path
  FROM memory_records WHERE coalesce(lifecycle, 'active') <> 'deleted'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY metadata.updated_at DESC NULLS LAST, content.text DESC NULLS LAST, content.structured DESC NULLS LAST) = 1)"""
#: Tokens of a column ``t``: identifiers and their parts.
SPLIT_SQL = """list_concat([lower(w)], CASE WHEN len(parts) >= 2 THEN parts ELSE [] END)"""


def tokens_sql(source: str, key: str, text: str) -> str:
    """CTE ``toks(key, tok)`` with every search token of ``text`` in ``source``."""
    return f"""words AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM {source}),
  split AS (SELECT {key}, w, CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda p: p <> '')
    ELSE list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p)) END AS parts FROM words),
  toks AS (SELECT {key}, unnest({SPLIT_SQL}) AS tok FROM split)"""


def chunk_path(chunk_file_id: str) -> Column:
    """The path inside a file record id."""
    return F.regexp_replace(F.col(chunk_file_id), r"^file-record:(?:project:)?[^:]*:", "")


PATH_SQL = "regexp_replace(file_record_id, '^file-record:(?:project:)?[^:]*:', '')"
