"""Queries on the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrecall.functions import text as T
from loomrecall.operators import codegraph as G
from loomrecall.operators.components import connected_components
from loomrecall.operators.tables import CHUNKS_SQL, FILES_SQL, PATH_SQL, current_chunks, current_files
from loomrecall.plans.registry import query
from loomrecall.plans.texts import FOLDER_SQL
from loomrecall.session import kept, materialize, table, table_version

_NO = "(" + ", ".join(f"'{x}'" for x in G.NO_CALLS) + ")"
SYMS_SQL = f"""{CHUNKS_SQL}, {FILES_SQL}, decl AS (SELECT project_key, file_record_id, coalesce(start_line, 1) AS line, unnest(list_concat(regexp_extract_all(chunk_text, '{G.DECLARATION}'), list_transform(regexp_extract_all(chunk_text, '{G.ARROW}', 1), lambda x: 'function ' || x))) AS d FROM chunks),
  syms AS (SELECT project_key, file_record_id, label, min(kind) AS kind, min(line) AS line, file_record_id || '#' || label AS id, {PATH_SQL} AS source_file
    FROM (SELECT project_key, file_record_id, line, regexp_extract(d, '\\s+([A-Za-z_][A-Za-z0-9_]*)$', 1) AS label, regexp_extract(d, '^(\\w+)', 1) AS kind FROM decl) GROUP BY project_key, file_record_id, label)"""
_QUOTED_IMPORT = G.IMPORT.replace("'", "''")
_TAILS = "[" + ", ".join(f"'{t}'" for t in ["", *G.EXTENSIONS, *[f"/index{e}" for e in G.EXTENSIONS], "/__init__.py"]) + "]"
_HAS_EXT = " OR ".join(f"ends_with({PATH_SQL}, '{e}')" for e in G.EXTENSIONS)
IMPORTS_SQL = f"""imp AS (SELECT DISTINCT project_key, file_record_id AS source, {PATH_SQL} AS path, unnest(CASE WHEN ends_with({PATH_SQL}, '.py') THEN list_concat(regexp_extract_all(chunk_text, '{G.PY_IMPORT}', 1), regexp_extract_all(chunk_text, '{G.PY_IMPORT}', 2)) ELSE regexp_extract_all(chunk_text, '{_QUOTED_IMPORT}', 1) END) AS spec FROM chunks WHERE {_HAS_EXT}),
  ib AS (SELECT project_key, source, spec, CASE WHEN starts_with(spec, '.') THEN list_reduce(list_concat([''], string_split(regexp_replace(path, '/?[^/]*$', '') || '/' || CASE WHEN ends_with(path, '.py') THEN repeat('../', length(regexp_extract(spec, '^(\\.*)', 1)) - 1) || replace(regexp_replace(spec, '^\\.+', ''), '.', '/') ELSE spec END, '/')),
    lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN x ELSE a || '/' || x END) END AS base FROM imp WHERE spec <> ''),
  tr AS (SELECT project_key, source, spec, base || unnest({_TAILS}) AS path, generate_subscripts({_TAILS}, 1) AS nth FROM ib WHERE base IS NOT NULL), th AS (SELECT tr.project_key, tr.source, tr.spec, files.id AS target FROM tr JOIN files ON files.project_key = tr.project_key AND files.path = tr.path QUALIFY row_number() OVER (PARTITION BY tr.project_key, tr.source, tr.spec ORDER BY nth, files.id) = 1),
  imports AS (SELECT ib.project_key, ib.source, ib.spec, coalesce(th.target, 'import:' || ib.project_key || ':' || ib.spec) AS target, th.target IS NOT NULL AS resolved FROM ib LEFT JOIN th ON th.project_key = ib.project_key AND th.source = ib.source AND th.spec = ib.spec)"""
HERITAGE_SQL = f"""based AS (SELECT project_key, file_record_id, unnest(regexp_extract_all(chunk_text, '{G.BASED}')) AS d FROM chunks),
  bt AS (SELECT project_key, file_record_id || '#' || regexp_extract(d, '^(?:class|interface)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS source, regexp_replace(regexp_replace(d, '^(?:class|interface)\\s+[A-Za-z_][A-Za-z0-9_]*', ''), '<[^<>]*>', '', 'g') AS tail FROM based),
  bn AS (SELECT DISTINCT project_key, source, regexp_extract(x, '([A-Za-z_][A-Za-z0-9_]*)\\s*$', 1) AS label FROM (SELECT project_key, source, unnest(list_filter(string_split(regexp_replace(tail, '[()]|\\b(?:extends|implements)\\b', ',', 'g'), ','), lambda y: NOT contains(y, '='))) AS x FROM bt)),
  heritage AS (SELECT DISTINCT bn.project_key, bn.source, s.id AS target FROM bn JOIN (SELECT project_key, label, min(id) AS id FROM syms GROUP BY 1, 2) s ON s.project_key = bn.project_key AND s.label = bn.label WHERE bn.label <> '' AND bn.source <> s.id)"""
GRAPH_SQL = f"""{SYMS_SQL}, {IMPORTS_SQL}, {HERITAGE_SQL}, nodes AS (SELECT project_key, id, list_extract(string_split(replace(path, '\\', '/'), '/'), -1) AS label, 'file' AS kind, path AS source_file FROM files UNION ALL SELECT project_key, id, label, kind, source_file FROM syms
    UNION ALL SELECT DISTINCT project_key, target, spec, 'import', NULL FROM imports WHERE NOT resolved),
  made AS (SELECT DISTINCT project_key, file_record_id AS source, rtrim(replace(unnest(regexp_extract_all(chunk_text, '{G.CALL}')), '(', '')) AS label FROM chunks),
  firsts AS (SELECT project_key, label, id AS target, file_record_id FROM syms QUALIFY row_number() OVER (PARTITION BY project_key, label ORDER BY id) <= 3),
  edges AS (SELECT project_key, file_record_id AS source, id AS target, 'contains' AS relation, 'EXTRACTED' AS confidence, 1.0::DOUBLE AS weight FROM syms
    UNION ALL SELECT m.project_key, m.source, f.target, 'calls', 'INFERRED', 0.8::DOUBLE FROM made m JOIN firsts f ON f.project_key = m.project_key AND f.label = m.label WHERE m.label NOT IN {_NO} AND f.file_record_id <> m.source
    UNION ALL SELECT project_key, source, target, 'extends', 'INFERRED', 0.8::DOUBLE FROM heritage UNION ALL SELECT DISTINCT project_key, source, target, 'imports_from', 'EXTRACTED', 1.0::DOUBLE FROM imports)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the whole chunk table, written once for each version of the tables."""
    return _graph(spark, sf_dir)[1:]


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    names = ("indexed_chunks", "file_records")
    build = lambda: G.code_graph(current_chunks(table(spark, sf_dir, names[0])), current_files(table(spark, sf_dir, names[1])))
    return kept(spark, "graph", table_version(spark, sf_dir, names), build)


@query(f"WITH {SYMS_SQL} SELECT project_key, id, label, kind, line FROM syms")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.symbols(current_chunks(table(spark, sf_dir, "indexed_chunks"))).select("project_key", "id", "label", "kind", "line")


@query(f"WITH {GRAPH_SQL} SELECT project_key, source, target, relation FROM edges WHERE relation = 'calls'")
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = current_chunks(table(spark, sf_dir, "indexed_chunks"))
    return G.calls(chunks, G.symbols(chunks)).select("project_key", "source", "target", "relation")


@query(f"WITH {SYMS_SQL}, {IMPORTS_SQL} SELECT project_key, source, spec, target, resolved FROM imports")
def file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file imports, resolved to a file of its project where there is one."""
    return G.imports(current_chunks(table(spark, sf_dir, "indexed_chunks")), current_files(table(spark, sf_dir, "file_records")))


@query(f"WITH {GRAPH_SQL} SELECT project_key, source, target, relation FROM edges WHERE relation IN ('extends', 'imports_from')")
def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from classes to their bases, and from files to what they import."""
    return graph(spark, sf_dir)[1].where("relation in ('extends', 'imports_from')").select("project_key", "source", "target", "relation")


@query(f"WITH {GRAPH_SQL}, r AS (SELECT relation, confidence, count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM edges GROUP BY 1, 2) SELECT * FROM r")
def graph_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph(spark, sf_dir)[1]
    return e.groupBy("relation", "confidence").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


@query(f"WITH {GRAPH_SQL}, d AS (SELECT project_key, source AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT project_key, target, 1, 0 FROM edges) SELECT project_key, id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM d GROUP BY 1, 2")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(graph(spark, sf_dir)[1])


@query(
    f"""WITH {GRAPH_SQL}, hit AS (SELECT project_key, id, label, kind, CASE WHEN lower(label) = 'chunk' THEN 100 WHEN contains(lower(label), 'chunk') THEN 60 WHEN contains(lower(coalesce(source_file, '')), 'chunk') THEN 35 END AS score FROM nodes),
  d AS (SELECT project_key, source AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT project_key, target, 1, 0 FROM edges), g AS (SELECT project_key, id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM d GROUP BY 1, 2)
  SELECT h.project_key, h.id, h.label, score, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree FROM hit h LEFT JOIN g USING (project_key, id) WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY h.project_key ORDER BY score DESC, h.label, h.id) <= 10"""
)
def graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vertices of each project for a text, with their degrees."""
    n, e = graph(spark, sf_dir)
    hit = n.withColumn("score", G.match_score(F.col("label"), F.col("source_file"), "chunk")).where("score is not null")
    w = Window.partitionBy("project_key").orderBy(F.desc("score"), "label", "id")
    best = hit.withColumn("_rn", F.row_number().over(w)).where("_rn <= 10")
    best = materialize(best.drop("_rn"), "graph-hits")
    out = best.join(G.degrees(e, best), ["project_key", "id"], "left")
    return out.select("project_key", "id", "label", "score", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


@query(
    f"""WITH {GRAPH_SQL}, two AS (SELECT project_key, source AS u, target AS v, relation, weight FROM edges UNION ALL SELECT project_key, target, source, relation, weight FROM edges)
  SELECT project_key, u, v, relation, row_number() OVER (PARTITION BY project_key, u ORDER BY weight DESC, relation, v) AS rank FROM two WHERE u IN (SELECT id FROM nodes WHERE kind = 'class') QUALIFY rank <= 5"""
)
def graph_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best edges of every class."""
    n, e = graph(spark, sf_dir)
    return G.top_adjacent(e, n.where("kind = 'class'")).select("project_key", "u", "v", "relation", "rank")


@query(
    f"""WITH {GRAPH_SQL}, hit AS (SELECT project_key, id, label, CASE WHEN lower(label) = 'chunk' THEN 100 WHEN contains(lower(label), 'chunk') THEN 60 WHEN contains(lower(coalesce(source_file, '')), 'chunk') THEN 35 END AS score FROM nodes),
  best AS (SELECT project_key, id FROM hit WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_key ORDER BY score DESC, label, id) = 1), two AS (SELECT project_key, source AS u, target AS v, relation, weight FROM edges UNION ALL SELECT project_key, target, source, relation, weight FROM edges),
  one AS (SELECT project_key, id, min(label) AS label, min(kind) AS kind FROM nodes GROUP BY 1, 2), near AS (SELECT t.*, row_number() OVER (PARTITION BY t.project_key, t.u ORDER BY weight DESC, relation, v) AS rank FROM two t JOIN best b ON b.project_key = t.project_key AND b.id = t.u QUALIFY rank <= 10)
  SELECT n.project_key, n.u, n.relation, n.v, one.label AS v_label, one.kind AS v_kind, n.rank FROM near n LEFT JOIN one ON one.project_key = n.project_key AND one.id = n.v"""
)
def graph_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vertex of each project for a text, with its ten best edges and what stands at their other ends."""
    n, e = graph(spark, sf_dir)
    hit = n.withColumn("score", G.match_score(F.col("label"), F.col("source_file"), "chunk")).where("score is not null")
    w = Window.partitionBy("project_key").orderBy(F.desc("score"), "label", "id")
    best = hit.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("project_key", "id")
    return G.labelled(G.top_adjacent(e, best, 10), n).select("project_key", "u", "relation", "v", "v_label", "v_kind", "rank")


@query(
    f"""WITH {GRAPH_SQL}, adj AS (SELECT DISTINCT u, v FROM (SELECT source AS u, target AS v FROM edges UNION ALL SELECT target, source FROM edges)), s AS (SELECT min(source) AS s FROM edges WHERE relation = 'calls'), t AS (SELECT max(f.id) AS t FROM edges e JOIN syms f ON f.id = e.target WHERE e.relation = 'calls' AND e.source = (SELECT s FROM s)),
  l0 AS (SELECT s AS node, NULL::VARCHAR AS parent, 0 AS depth FROM s), l1 AS (SELECT v AS node, min(u) AS parent, 1 AS depth FROM adj JOIN l0 ON u = l0.node WHERE v NOT IN (SELECT node FROM l0) GROUP BY v),
  l2 AS (SELECT v AS node, min(u) AS parent, 2 AS depth FROM adj JOIN l1 ON u = l1.node WHERE v NOT IN (SELECT node FROM l0 UNION ALL SELECT node FROM l1) GROUP BY v), al AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2),
  p AS (SELECT al.* FROM al, t WHERE node = t.t), p1 AS (SELECT al.* FROM al JOIN p ON al.node = p.parent), p2 AS (SELECT al.* FROM al JOIN p1 ON al.node = p1.parent) SELECT depth::BIGINT AS depth, node FROM (SELECT * FROM p UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""
)
def graph_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest path from the first calling file to the last symbol that it calls."""
    e = graph(spark, sf_dir)[1]
    called = e.where("relation = 'calls'")
    source = called.agg(F.min("source").alias("s"))
    ends = called.join(F.broadcast(source), F.col("source") == F.col("s")).groupBy("s").agg(F.max("target").alias("t"))
    return G.shortest_path(e, "s", "t", ends)


@query(
    f"""WITH {GRAPH_SQL}, k AS (SELECT project_key, id, label, {FOLDER_SQL.format('source_file')} AS folder FROM nodes),
  sz AS (SELECT project_key, folder, count(*) AS node_count, array_to_string(list_slice(list(label ORDER BY id), 1, 8), ', ') AS preview FROM k GROUP BY 1, 2), kd AS (SELECT DISTINCT project_key, id, folder FROM k),
  inn AS (SELECT e.project_key, x.folder, count(*) AS edges FROM edges e JOIN kd x ON x.project_key = e.project_key AND x.id = e.source JOIN kd y ON y.project_key = e.project_key AND y.id = e.target WHERE x.folder = y.folder GROUP BY 1, 2)
  SELECT s.project_key, row_number() OVER (PARTITION BY s.project_key ORDER BY node_count DESC, s.folder) - 1 AS community, s.folder, node_count, round(coalesce(edges, 0) / greatest(1, node_count * greatest(1, node_count - 1))::DOUBLE, 3) AS cohesion, preview FROM sz s LEFT JOIN inn i ON i.project_key = s.project_key AND i.folder = s.folder"""
)
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return G.communities(n, e)


@query(
    f"""WITH {GRAPH_SQL}, e AS (SELECT project_key, round(100.0::DOUBLE * count(*) FILTER (WHERE confidence = 'EXTRACTED') / count(*), 1) AS extracted_percent, round(100.0::DOUBLE * count(*) FILTER (WHERE confidence = 'INFERRED') / count(*), 1) AS inferred_percent, count(*) AS edges FROM edges GROUP BY 1),
  sz AS (SELECT project_key, {FOLDER_SQL.format('source_file')} AS folder, count(*) AS n FROM nodes GROUP BY 1, 2), v AS (SELECT project_key, count(*) FILTER (WHERE n = 1) AS isolated, count(*) FILTER (WHERE n <= 2) AS thin FROM sz GROUP BY 1) SELECT e.*, isolated, thin FROM e JOIN v USING (project_key)"""
)
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of what was read and what was inferred, and communities of one vertex (isolated) or of at most two (thin)."""
    n, e = graph(spark, sf_dir)
    share = lambda c: F.round(F.lit(100.0) * F.count_if(F.col("confidence") == c) / F.count(F.lit(1)), 1)
    per = e.groupBy("project_key").agg(share("EXTRACTED").alias("extracted_percent"), share("INFERRED").alias("inferred_percent"), F.count(F.lit(1)).alias("edges"))
    sizes = n.groupBy("project_key", T.folder(F.col("source_file")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    return per.join(sizes.groupBy("project_key").agg(F.count_if(F.col("n") == 1).alias("isolated"), F.count_if(F.col("n") <= 2).alias("thin")), "project_key")


@query(
    f"""WITH {SYMS_SQL}, h AS (SELECT DISTINCT result_id, 'file-record:' || project_key || ':' || regexp_replace(replace(file_path, '\\', '/'), '^\\./', '') AS file_record_id, chunk_index FROM search_results),
  r AS (SELECT h.result_id, h.file_record_id, c.start_line, c.end_line FROM h JOIN chunks c ON c.file_record_id = h.file_record_id AND c.chunk_index = h.chunk_index WHERE c.start_line IS NOT NULL AND c.end_line IS NOT NULL)
  SELECT r.result_id, s.label, (CASE WHEN s.line BETWEEN r.start_line AND r.end_line THEN 0 ELSE least(abs(s.line - r.start_line), abs(s.line - r.end_line)) END)::BIGINT AS distance,
  row_number() OVER (PARTITION BY r.result_id ORDER BY CASE WHEN s.line BETWEEN r.start_line AND r.end_line THEN 0 ELSE least(abs(s.line - r.start_line), abs(s.line - r.end_line)) END, s.label) AS rank FROM r JOIN syms s ON s.file_record_id = r.file_record_id QUALIFY rank <= 5"""
)
def nearest_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five symbols nearest to each logged hit, by lines within its file."""
    chunks = current_chunks(table(spark, sf_dir, "indexed_chunks"))
    path = F.regexp_replace(T.slashed(F.col("file_path")), r"^\./", "")
    hits = table(spark, sf_dir, "search_results").select("result_id", F.concat(F.lit("file-record:"), "project_key", F.lit(":"), path).alias("file_record_id"), "chunk_index").distinct()
    ranges = hits.join(chunks.select("file_record_id", "chunk_index", "start_line", "end_line"), ["file_record_id", "chunk_index"]).where("start_line is not null and end_line is not null")
    # Equal ranges of a file are compared with its symbols once, whatever the number of hits in them.
    places = ranges.select("file_record_id", "start_line", "end_line").distinct()
    away = F.when(F.col("line").between(F.col("start_line"), F.col("end_line")), F.lit(0)).otherwise(F.least(F.abs(F.col("line") - F.col("start_line")), F.abs(F.col("line") - F.col("end_line"))))
    at = ["file_record_id", "start_line", "end_line"]
    w = Window.partitionBy(*at).orderBy("distance", "label")
    near = places.join(G.symbols(chunks).select("file_record_id", "label", "line"), "file_record_id").select(*at, "label", away.cast("long").alias("distance"))
    best = near.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")
    return ranges.join(best, at).select("result_id", "label", "distance", "rank")


@query(
    f"""WITH {GRAPH_SQL}, h AS (SELECT DISTINCT result_id, project_key, 'file-record:' || project_key || ':' || regexp_replace(replace(file_path, '\\', '/'), '^\\./', '') AS file_record_id FROM search_results),
  two AS (SELECT project_key, source AS u, target AS v, relation, weight FROM edges UNION ALL SELECT project_key, target, source, relation, weight FROM edges), near AS (SELECT *, row_number() OVER (PARTITION BY project_key, u ORDER BY weight DESC, relation, v) AS rank FROM two WHERE u IN (SELECT file_record_id FROM h) QUALIFY rank <= 3),
  one AS (SELECT project_key, id, min(label) AS label FROM nodes GROUP BY 1, 2)
  SELECT h.result_id, h.file_record_id, f.label AS file_label, n.relation, n.v, o.label AS v_label, n.rank FROM h JOIN one f ON f.project_key = h.project_key AND f.id = h.file_record_id LEFT JOIN near n ON n.project_key = h.project_key AND n.u = h.file_record_id LEFT JOIN one o ON o.project_key = n.project_key AND o.id = n.v"""
)
def hit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each logged hit with the vertex of its file and that file's three best edges."""
    n, e = graph(spark, sf_dir)
    path = F.regexp_replace(T.slashed(F.col("file_path")), r"^\./", "")
    hits = table(spark, sf_dir, "search_results").select("result_id", "project_key", F.concat(F.lit("file-record:"), "project_key", F.lit(":"), path).alias("id")).distinct()
    files = n.select("project_key", "id", F.col("label").alias("file_label")).dropDuplicates(["project_key", "id"])
    near = G.labelled(G.top_adjacent(e, hits.select("project_key", "id").distinct(), 3), n).select("project_key", F.col("u").alias("id"), "relation", "v", "v_label", "rank")
    return hits.join(files, ["project_key", "id"]).join(near, ["project_key", "id"], "left").select("result_id", F.col("id").alias("file_record_id"), "file_label", "relation", "v", "v_label", "rank")


@query(
    """WITH RECURSIVE pairs AS (SELECT DISTINCT s_suppkey AS a, 1000000 + s_nationkey AS b FROM supplier UNION SELECT DISTINCT 2000000 + c_custkey, 1000000 + c_nationkey FROM customer), m AS (SELECT b, least(min(a), b) AS lo, count(*) AS n FROM pairs GROUP BY b) SELECT lo::BIGINT AS component, n + 1 AS vertices FROM m"""
)
def linked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of suppliers and customers that share a nation."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), (F.lit(1000000) + F.col("s_nationkey")).cast("long").alias("b"))
    c = table(spark, sf_dir, "customer").select((F.lit(2000000) + F.col("c_custkey")).alias("a"), (F.lit(1000000) + F.col("c_nationkey")).cast("long").alias("b"))
    return connected_components(s.unionByName(c), "a", "b").groupBy("component").agg(F.count(F.lit(1)).alias("vertices"))
