"""Reporting queries over index, store and session state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrecall.functions import text as T
from loomrecall.operators.sessions import numbered
from loomrecall.operators.tables import CHUNKS_SQL, FILES_SQL, RECORDS_SQL, current_chunks, current_files, current_records
from loomrecall.plans.registry import query
from loomrecall.session import table

_EXT = "lower(regexp_extract(parse_filename(replace(path, '\\', '/')), '.(\\.[^.]*)$', 1))"


@query(
    f"""WITH {FILES_SQL}, c AS (SELECT CASE WHEN {_EXT} = '' THEN 'Other' ELSE upper(substr({_EXT}, 2)) END AS language, count(*) AS n FROM files GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, language) AS rk FROM c)
  SELECT CASE WHEN rk <= 16 THEN language ELSE 'Other' END AS language, sum(n)::BIGINT AS files FROM r GROUP BY 1"""
)
def language_top16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension: the 16 commonest, the rest as Other. The counts are ranked, not the files."""
    ext = T.extension(F.col("path"))
    counts = current_files(table(spark, sf_dir, "file_records")).groupBy(F.when(ext == "", "Other").otherwise(F.upper(F.substring(ext, 2, 100))).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "language").limit(16).select(F.col("language").alias("_l"))
    named = counts.join(F.broadcast(top), F.col("language") == F.col("_l"), "left")
    return named.groupBy(F.coalesce("_l", F.lit("Other")).alias("language")).agg(F.sum("n").alias("files"))


@query("WITH t AS (SELECT DISTINCT id, session_id, agent, model, turn_ts FROM session_turns WHERE session_id IS NOT NULL) SELECT session_id, count(*) AS turns, min(turn_ts) AS started, max(turn_ts) AS last_seen, count(DISTINCT agent) AS agents, count(DISTINCT agent) > 1 AS collision FROM t GROUP BY 1")
def active_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as contexts: first and last sign of life, and whether several clients share one."""
    t = table(spark, sf_dir, "session_turns").where("session_id is not null").select("id", "session_id", "agent", "model", "turn_ts").distinct()
    agents = F.count_distinct("agent")
    return t.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.min("turn_ts").alias("started"), F.max("turn_ts").alias("last_seen"), agents.alias("agents"), (agents > 1).alias("collision"))


@query("WITH g AS (SELECT source_kind, state, count(*) AS n, min(project_key) AS first_key FROM file_search_projects GROUP BY 1, 2) SELECT * FROM g WHERE n > 1")
def duplicate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles (source and state) that more than one project holds."""
    return table(spark, sf_dir, "file_search_projects").groupBy("source_kind", "state").agg(F.count(F.lit(1)).alias("n"), F.min("project_key").alias("first_key")).where("n > 1")


@query(
    f"""WITH {FILES_SQL}, {CHUNKS_SQL}, f AS (SELECT project_key, count(*) AS files FROM files GROUP BY 1), c AS (SELECT project_key, count(*) AS chunks FROM chunks GROUP BY 1)
  SELECT p.project_key, p.state, coalesce(files, 0) AS files, coalesce(chunks, 0) AS chunks, CASE WHEN coalesce(chunks, 0) > 0 THEN 'ready' WHEN coalesce(files, 0) > 0 OR p.state = 'enabled' THEN 'degraded' ELSE 'missing' END AS health FROM file_search_projects p LEFT JOIN f USING (project_key) LEFT JOIN c USING (project_key)"""
)
def project_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = current_files(table(spark, sf_dir, "file_records")).groupBy("project_key").agg(F.count(F.lit(1)).alias("files"))
    c = current_chunks(table(spark, sf_dir, "indexed_chunks")).groupBy("project_key").agg(F.count(F.lit(1)).alias("chunks"))
    p = table(spark, sf_dir, "file_search_projects").join(f, "project_key", "left").join(c, "project_key", "left")
    files, chunks = F.coalesce("files", F.lit(0)), F.coalesce("chunks", F.lit(0))
    health = F.when(chunks > 0, "ready").when((files > 0) | (F.col("state") == "enabled"), "degraded").otherwise("missing")
    return p.select("project_key", "state", files.alias("files"), chunks.alias("chunks"), health.alias("health"))


@query(f"WITH {RECORDS_SQL} SELECT scope, source, count(*) AS records, count(*) FILTER (WHERE text IS NULL) AS without_text, count(DISTINCT namespace) AS namespaces FROM records GROUP BY 1, 2")
def record_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = current_records(table(spark, sf_dir, "memory_records"))
    return r.groupBy("scope", "source").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("text").isNull()).alias("without_text"), F.count_distinct("namespace").alias("namespaces"))


@query("SELECT DISTINCT result_id, query_text, searched_at FROM search_results ORDER BY searched_at DESC, result_id LIMIT 50 OFFSET 50")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the search log."""
    rows = table(spark, sf_dir, "search_results").select("result_id", "query_text", "searched_at").distinct()
    return rows.orderBy(F.desc("searched_at"), "result_id").offset(50).limit(50)


@query("SELECT project_key, arg_max(result_id, (searched_at, result_id)) AS last_result, max(searched_at) AS last_search, count(DISTINCT result_id) AS searches FROM search_results GROUP BY 1")
def latest_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "search_results")
    return rows.groupBy("project_key").agg(F.max_by("result_id", F.struct("searched_at", "result_id")).alias("last_result"), F.max("searched_at").alias("last_search"), F.count_distinct("result_id").alias("searches"))


@query(
    f"""WITH {FILES_SQL}, r AS (SELECT project_key, path, size_bytes, row_number() OVER (PARTITION BY project_key ORDER BY size_bytes DESC, path) AS rank, count(*) OVER (PARTITION BY project_key) AS n FROM files)
  SELECT project_key, CASE WHEN rank < 4 OR n = rank THEN path ELSE '(more)' END AS entry, rank, CASE WHEN rank < 4 OR n = rank THEN size_bytes ELSE n - 3 END AS amount FROM r WHERE rank <= 4"""
)
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest files of each project, cut to four lines; the last one says how many more there are."""
    files = current_files(table(spark, sf_dir, "file_records"))
    n = files.groupBy("project_key").agg(F.count(F.lit(1)).alias("n"))
    best = numbered(files, ["project_key"], [F.desc("size_bytes"), F.col("path")]).where("rank <= 4").join(n, "project_key")
    shown = (F.col("rank") < 4) | (F.col("n") == F.col("rank"))
    return best.select("project_key", F.when(shown, F.col("path")).otherwise("(more)").alias("entry"), "rank", F.when(shown, F.col("size_bytes")).otherwise(F.col("n") - 3).alias("amount"))


@query(
    """WITH s AS (SELECT DISTINCT result_id, search_mode, score, lexical_score, semantic_score FROM search_results) SELECT search_mode, count(*) AS results, count(semantic_score) > 0 AS semantic_used, count(*) FILTER (WHERE semantic_score IS NULL AND search_mode <> 'bm25') > 0 AS degraded, round(avg(score), 6) AS mean_score FROM s GROUP BY 1"""
)
def search_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mode: whether vectors were used, and whether results of a mode that needs them lack them."""
    s = table(spark, sf_dir, "search_results").select("result_id", "search_mode", "score", "lexical_score", "semantic_score").distinct()
    lacking = F.count_if(F.col("semantic_score").isNull() & (F.col("search_mode") != "bm25")) > 0
    return s.groupBy("search_mode").agg(F.count(F.lit(1)).alias("results"), (F.count("semantic_score") > 0).alias("semantic_used"), lacking.alias("degraded"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(
    f"""WITH {RECORDS_SQL}, l AS (SELECT scope, id, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM records WHERE text IS NOT NULL AND scope IN ('user', 'project')), d AS (SELECT scope, left(trim(line), 220) AS line, min(id) AS first_id FROM l WHERE trim(line) <> '' AND contains(lower(line), 'rollup') GROUP BY 1, 2)
  SELECT scope, line, row_number() OVER (PARTITION BY scope ORDER BY first_id, line) AS rank FROM d QUALIFY rank <= 4"""
)
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines for a prompt's context: of either scope the first four distinct lines on a subject, shortened."""
    r = current_records(table(spark, sf_dir, "memory_records")).where(F.col("text").isNotNull() & F.col("scope").isin("user", "project"))
    lines = r.select("scope", "id", F.explode(F.split("text", r"\r?\n")).alias("line")).where((F.trim("line") != "") & F.lower("line").contains("rollup"))
    distinct = lines.groupBy("scope", F.left(F.trim("line"), F.lit(220)).alias("line")).agg(F.min("id").alias("first_id"))
    return numbered(distinct, ["scope"], [F.col("first_id"), F.col("line")]).where("rank <= 4").select("scope", "line", "rank")


@query(
    "WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM p) SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice, o_orderdate FROM w WHERE rn = 1"
)
def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row per key on a large fact table, by a mergeable aggregate instead of a sort of all rows of a key."""
    o = table(spark, sf_dir, "orders")
    last = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("r"))
    return last.select("o_custkey", "r.o_orderkey", F.round("r.o_totalprice", 2).alias("o_totalprice"), "r.o_orderdate")


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2"
)
def fact_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status rollup over the largest table: one pass with map-side sums."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))), 2).alias("revenue"), F.max("l_shipdate").alias("last_ship"))


