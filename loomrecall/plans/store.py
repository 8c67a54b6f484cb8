"""Queries on the record store, index maintenance and embedding state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrecall.functions import constants as C
from loomrecall.functions import text as T
from loomrecall.operators import records as R
from loomrecall.operators import scan
from loomrecall.operators.tables import CHUNKS_SQL, FILES_SQL, RECORDS_SQL, current_chunks, current_files, current_records
from loomrecall.plans.registry import query
from loomrecall.session import table

_FLAT_SQL = """flat AS (SELECT id, scope, identity.namespace AS namespace, content.text AS text, content.structured AS structured, metadata.created_at AS created_at, metadata.updated_at AS updated_at, lifecycle, provenance.source AS source FROM memory_records)"""


def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memory_records").select("id", "scope", F.col("identity.namespace").alias("namespace"), F.col("content.text").alias("text"), F.col("content.structured").alias("structured"), F.col("metadata.created_at").alias("created_at"), F.col("metadata.updated_at").alias("updated_at"), "lifecycle", F.col("provenance.source").alias("source"))


@query(
    f"""WITH {_FLAT_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, '') DESC, CASE WHEN source = 'session-capture' THEN 1 ELSE 0 END DESC, coalesce(text, '') DESC, coalesce(structured, '') DESC, coalesce(lifecycle, '') DESC) AS rn, min(created_at) OVER (PARTITION BY id) AS c0, count(*) OVER (PARTITION BY id) AS writes FROM flat)
  SELECT id, md5(coalesce(text, '') || '|' || coalesce(structured, '')) AS payload, lifecycle, updated_at, c0 AS created_at, writes FROM o WHERE rn = 1"""
)
def record_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured records merged into the others: the newest write of each id, with the earliest creation time."""
    flat = flat_records(spark, sf_dir)
    captured = F.coalesce(F.col("source") == "session-capture", F.lit(False))
    out = R.upsert(flat.where(~captured), flat.where(captured), "id", ["text", "structured", "lifecycle"], "created_at", "updated_at")
    return out.select("id", F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("|"), F.coalesce("structured", F.lit("")))).alias("payload"), "lifecycle", "updated_at", "created_at", "writes")


@query(f"WITH {RECORDS_SQL} SELECT id, scope, namespace, md5(coalesce(text, '')) AS text_hash, md5(coalesce(structured, '')) AS structured_hash FROM records")
def active_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared corpus without tombstones; the last active row of an id counts."""
    h = lambda c: F.md5(F.coalesce(F.col(c), F.lit("")))
    return current_records(table(spark, sf_dir, "memory_records")).select("id", "scope", "namespace", h("text").alias("text_hash"), h("structured").alias("structured_hash"))


_EDGES_SQL = f"""{_FLAT_SQL}, a AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, ''), coalesce(text, ''), coalesce(structured, ''), coalesce(lifecycle, '')) = 1),
  b AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, '') DESC, coalesce(text, '') DESC, coalesce(structured, '') DESC, coalesce(lifecycle, '') DESC) = 1)"""


def _edge_rows(flat: DataFrame, latest: bool) -> DataFrame:
    order = [F.coalesce(F.col(c), F.lit("")) for c in ("updated_at", "text", "structured", "lifecycle")]
    w = Window.partitionBy("id").orderBy(*[o.desc() if latest else o.asc() for o in order])
    return flat.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


@query(
    f"WITH {_EDGES_SQL}, x AS (SELECT * FROM a WHERE scope <> 'agent'), y AS (SELECT * FROM b WHERE coalesce(lifecycle, '') <> 'deleted') SELECT coalesce(x.id, y.id) AS id, CASE WHEN y.id IS NULL THEN 'left-only' WHEN x.id IS NULL THEN 'right-only' WHEN x.text IS NOT DISTINCT FROM y.text AND x.structured IS NOT DISTINCT FROM y.structured AND x.updated_at IS NOT DISTINCT FROM y.updated_at THEN 'identical' ELSE 'differing' END AS state FROM x FULL OUTER JOIN y ON x.id = y.id"
)
def snapshot_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first writes (without one scope) against the last active ones, id by id."""
    flat = flat_records(spark, sf_dir)
    first = _edge_rows(flat, False).where("scope <> 'agent'")
    last = _edge_rows(flat, True).where("coalesce(lifecycle, '') <> 'deleted'")
    return R.compare(first, last, "id", ["text", "structured", "updated_at"])


@query(f"WITH {_EDGES_SQL} SELECT a.id, concat_ws(',', CASE WHEN a.scope IS DISTINCT FROM b.scope THEN 'scope' END, CASE WHEN a.text IS DISTINCT FROM b.text THEN 'text' END, CASE WHEN a.structured IS DISTINCT FROM b.structured THEN 'structured' END, CASE WHEN a.updated_at IS DISTINCT FROM b.updated_at THEN 'updated_at' END, CASE WHEN a.lifecycle IS DISTINCT FROM b.lifecycle THEN 'lifecycle' END) AS changed FROM a JOIN b USING (id)")
def record_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flat_records(spark, sf_dir)
    return R.changed_fields(_edge_rows(flat, False), _edge_rows(flat, True), "id", ["scope", "text", "structured", "updated_at", "lifecycle"])


QUERY = "stale chunk"


def _rank_sql(mode: str) -> str:
    hay = "lower(id || ' ' || coalesce(namespace, '') || ' ' || coalesce(leaf_name, '') || ' ' || coalesce(parent_context, '') || ' ' || coalesce(text, ''))"
    fin = """lower('{"source":"' || coalesce(source, '') || '","structured":' || coalesce(structured, '{}') || ',"text":"' || coalesce(text, '') || '"}')"""
    share = lambda f: f"((CASE WHEN contains({f}, 'stale') THEN 1 ELSE 0 END) + (CASE WHEN contains({f}, 'chunk') THEN 1 ELSE 0 END)) / 2.0::DOUBLE"
    score = "lexical * 0.4::DOUBLE + semantic * 0.5::DOUBLE + sc * 0.05::DOUBLE + pv * 0.03::DOUBLE + cx * 0.015::DOUBLE + rc * 0.005::DOUBLE + CASE WHEN semantic > 0 THEN 0.35::DOUBLE ELSE 0 END" if mode == "hybrid" else f"{mode} + sc + cx + pv + rc"
    return f"""WITH {RECORDS_SQL}, g AS (SELECT id, CASE WHEN {hay} = '{QUERY}' THEN 1.0::DOUBLE WHEN contains({hay}, '{QUERY}') THEN 0.8::DOUBLE ELSE {share(hay)} END AS lexical, CASE WHEN contains({fin}, '{QUERY}') THEN 0.5::DOUBLE ELSE 0.5::DOUBLE * {share(fin)} END AS semantic,
  CASE scope WHEN 'project' THEN 0.2::DOUBLE WHEN 'dir' THEN 0.15::DOUBLE WHEN 'user' THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS sc, CASE WHEN coalesce(origin, '') <> '' THEN 0.1::DOUBLE ELSE 0.04::DOUBLE END AS pv,
  CASE WHEN coalesce(parent_context, '') <> '' AND contains(lower(parent_context), '{QUERY}') THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END AS cx, CASE WHEN coalesce(updated_at, '') <> '' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS rc FROM records)
  SELECT id, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round({score}, 6) AS score FROM g WHERE lexical > 0 OR semantic > 0"""


def _ranked(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return R.ranked_signals(current_records(table(spark, sf_dir, "memory_records")), QUERY, mode)

    run.__name__ = f"signal_rank_{mode}"
    return query(_rank_sql(mode))(run)


signal_rank_lexical, signal_rank_semantic, signal_rank_hybrid = _ranked("lexical"), _ranked("semantic"), _ranked("hybrid")


@query(f"WITH {RECORDS_SQL} SELECT id, namespace, 'scope-filtered' AS reason FROM records WHERE scope = 'project' AND coalesce(lower(trim(parent_context)), 'root') = 'workspace/docs'")
def identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lookup(current_records(table(spark, sf_dir, "memory_records")), scope="project", parent="workspace/docs").select("id", "namespace", "reason")


_DIRS_SQL = "list_slice(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'), 1, len(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.')) - 1)"
_IGN_SQL = "[" + ", ".join(f"'{d}'" for d in C.IGNORED_DIRS) + "]"
_SENS_SQL = "(?:^|[{\\[,])\\s*[\"''](?:" + "|".join(C.SENSITIVE_FIELDS) + ")[\"'']\\s*:\\s*(?:[\"'']|[{\\[]|true\\b|false\\b|null\\b|-?\\d)"


@query(
    f"""WITH {FILES_SQL}, {CHUNKS_SQL}, s AS (SELECT file_record_id, bool_or(regexp_matches(chunk_text, '{_SENS_SQL}')) AS sens FROM chunks GROUP BY 1),
  r AS (SELECT CASE WHEN list_has_any({_DIRS_SQL}, {_IGN_SQL}) OR regexp_matches(path, '-(?:wal|shm)$') THEN 'ignored' WHEN size_bytes > 6000 THEN 'oversized' WHEN regexp_matches(lower(path), '(?:\\.db|\\.sqlite|\\.sqlite3)$') THEN 'extension' WHEN coalesce(sens, false) THEN 'sensitive' END AS reason, size_bytes FROM files LEFT JOIN s ON s.file_record_id = files.id)
  SELECT coalesce(reason, 'indexed') AS reason, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM r GROUP BY 1"""
)
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the reason for which a scan leaves them out (with a size limit that these tables reach)."""
    sens = current_chunks(table(spark, sf_dir, "indexed_chunks")).groupBy("file_record_id").agg(F.max(T.sensitive(F.col("chunk_text"))).alias("sens"))
    files = current_files(table(spark, sf_dir, "file_records")).join(sens.withColumnRenamed("file_record_id", "id"), "id", "left")
    reason = scan.skip_reason(F.col("path"), F.col("size_bytes"), F.col("sens"), max_bytes=6000)
    return files.groupBy(F.coalesce(reason, F.lit("indexed")).alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


_SCANS_SQL = """a AS (SELECT * FROM file_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at, mtime_ms, content_hash) = 1), b AS (SELECT * FROM file_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, mtime_ms DESC NULLS LAST, content_hash DESC NULLS LAST) = 1),
  o AS (SELECT * FROM a WHERE size_bytes % 7 <> 0), n AS (SELECT * FROM b WHERE size_bytes % 11 <> 0)"""


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An earlier and a later scan: the first row of each file without some sizes, and the last row without others."""
    files = table(spark, sf_dir, "file_records")
    w = Window.partitionBy("id").orderBy(*[F.col(c).asc_nulls_last() for c in ("updated_at", "mtime_ms", "content_hash")])
    first = files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.where("size_bytes % 7 <> 0"), current_files(files).where("size_bytes % 11 <> 0")


@query(
    f"""WITH {_SCANS_SQL}, j AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'deleted' WHEN o.content_hash IS DISTINCT FROM n.content_hash THEN 'changed' WHEN o.mtime_ms IS DISTINCT FROM n.mtime_ms OR o.size_bytes IS DISTINCT FROM n.size_bytes THEN 'touched' ELSE 'unchanged' END AS state FROM o FULL OUTER JOIN n ON o.id = n.id)
  SELECT id, state, CASE state WHEN 'new' THEN 'confirmed-by-hash' WHEN 'changed' THEN 'changed' WHEN 'deleted' THEN 'deleted' END AS audit FROM j"""
)
def incremental_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _scans(spark, sf_dir)
    return scan.changes(before, after)


@query(f"WITH {_SCANS_SQL}, {CHUNKS_SQL} SELECT chunks.id AS chunk_id, chunks.file_record_id FROM chunks WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = chunks.file_record_id)")
def orphaned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose file the later scan no longer sees: what delete reconciliation removes."""
    after = _scans(spark, sf_dir)[1]
    return current_chunks(table(spark, sf_dir, "indexed_chunks")).join(after.select(F.col("id").alias("file_record_id")), "file_record_id", "left_anti").select(F.col("id").alias("chunk_id"), "file_record_id")


_LATEST_VEC_SQL = "v AS (SELECT * FROM record_embeddings QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY updated_at DESC NULLS LAST, status DESC) = 1)"


def latest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("record_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("status").desc())
    return table(spark, sf_dir, "record_embeddings").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


_CLASS_SQL = "CASE WHEN v.record_id IS NULL THEN 'missing' WHEN v.status = 'failed' THEN 'failed' WHEN v.dimension <> v.configured_dimension OR len(v.embedding) IS DISTINCT FROM v.dimension THEN 'incompatible' WHEN v.identity_version IS DISTINCT FROM 'v2' THEN 'stale' ELSE 'ready' END"


def _class(present: str = "record_id"):
    return (
        F.when(F.col(present).isNull(), "missing").when(F.col("status") == "failed", "failed").when((F.col("dimension") != F.col("configured_dimension")) | ~F.size("embedding").eqNullSafe(F.col("dimension")), "incompatible")
        .when(~F.col("identity_version").eqNullSafe(F.lit("v2")), "stale").otherwise("ready")
    )


@query(f"WITH {RECORDS_SQL}, {_LATEST_VEC_SQL}, c AS (SELECT {_CLASS_SQL} AS state FROM records LEFT JOIN v ON v.record_id = records.id) SELECT state, count(*) AS records FROM c GROUP BY state")
def embedding_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active records by the state of their vector: ready, missing, stale, incompatible or failed."""
    records = current_records(table(spark, sf_dir, "memory_records")).select("id")
    both = records.join(latest_vectors(spark, sf_dir), F.col("id") == F.col("record_id"), "left")
    return both.groupBy(_class().alias("state")).agg(F.count(F.lit(1)).alias("records"))


@query(f"WITH {RECORDS_SQL}, {_LATEST_VEC_SQL} SELECT id FROM records WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.record_id = records.id AND {_CLASS_SQL} IN ('ready', 'stale'))")
def embedding_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active records that an embedding refresh has to take up: no usable vector yet."""
    ready = latest_vectors(spark, sf_dir).where(_class().isin("ready", "stale")).select(F.col("record_id").alias("id"))
    return current_records(table(spark, sf_dir, "memory_records")).select("id").join(ready, "id", "left_anti")


@query(f"WITH {_LATEST_VEC_SQL} SELECT provider_key, model, configured_dimension, count(*) AS vectors, count(*) FILTER (WHERE status = 'ready') AS ready, count(DISTINCT dimension) AS dimensions, max(updated_at) AS last_update FROM v GROUP BY 1, 2, 3")
def embedding_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = latest_vectors(spark, sf_dir)
    return v.groupBy("provider_key", "model", "configured_dimension").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_distinct("dimension").alias("dimensions"), F.max("updated_at").alias("last_update"))


@query(f"WITH {RECORDS_SQL}, {_LATEST_VEC_SQL} SELECT v.record_id, (v.text_hash = left(v.content_hash, 40)) AS hash_agrees, records.scope FROM v JOIN records ON records.id = v.record_id WHERE v.status = 'ready'")
def ready_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready vectors with their record, checked by hash."""
    v = latest_vectors(spark, sf_dir).where("status = 'ready'")
    return v.join(current_records(table(spark, sf_dir, "memory_records")).select("id", "scope"), F.col("record_id") == F.col("id")).select("record_id", (F.col("text_hash") == F.left("content_hash", F.lit(40))).alias("hash_agrees"), "scope")


@query(f"WITH {CHUNKS_SQL} SELECT project_key, count(*) AS chunks, (sum(coalesce(length(chunk_text), 0) + coalesce(length(search_text), 0) + 256))::BIGINT AS estimated_bytes FROM chunks GROUP BY project_key")
def memory_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.length("chunk_text"), F.lit(0)) + F.coalesce(F.length("search_text"), F.lit(0)) + 256
    return current_chunks(table(spark, sf_dir, "indexed_chunks")).groupBy("project_key").agg(F.count(F.lit(1)).alias("chunks"), F.sum(size).alias("estimated_bytes"))


@query(f"WITH {CHUNKS_SQL}, {FILES_SQL} SELECT c.project_key, count(*) AS chunks, count(DISTINCT c.file_record_id) AS files, sum(f.size_bytes)::BIGINT AS bytes_weighted FROM chunks c JOIN files f ON f.id = c.file_record_id GROUP BY 1")
def indexed_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their files by project; the chunks of a file are counted before the join, so a hot file is one row in it."""
    per_file = current_chunks(table(spark, sf_dir, "indexed_chunks")).groupBy("project_key", "file_record_id").agg(F.count(F.lit(1)).alias("n"))
    joined = per_file.join(current_files(table(spark, sf_dir, "file_records")).select(F.col("id").alias("file_record_id"), "size_bytes"), "file_record_id")
    return joined.groupBy("project_key").agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("files"), F.sum(F.col("n") * F.col("size_bytes")).alias("bytes_weighted"))
