"""Queries on the inverted index and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrecall.functions import text as T
from loomrecall.operators import index
from loomrecall.operators.tables import CHUNKS_SQL, PATH_SQL, RECORDS_SQL, SPLIT_SQL, chunk_path, current_chunks, current_records, tokens_sql
from loomrecall.plans.registry import query
from loomrecall.session import table

TERMS = ["cached", "query", "lease"]
_IN = "('" + "', '".join(TERMS) + "')"


def bm25_sql(toks: str, key: str, lens: str, terms: str = _IN) -> str:
    """Score per key from CTEs of tokens and lengths (key, len)."""
    return f"""st AS (SELECT count(*)::DOUBLE AS n, CASE WHEN sum(len) > 0 THEN sum(len)::DOUBLE / count(*) ELSE 1.0::DOUBLE END AS av FROM {lens}),
  tf AS (SELECT {key}, tok, count(*)::DOUBLE AS tf FROM {toks} WHERE tok IN {terms} GROUP BY ALL), df AS (SELECT tok, count(*)::DOUBLE AS df FROM tf GROUP BY tok),
  scored AS (SELECT tf.{key}, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av))) AS score FROM tf JOIN df USING (tok) JOIN {lens} AS l ON l.{key} = tf.{key}, st GROUP BY tf.{key})"""


@query(f"WITH {CHUNKS_SQL}, {tokens_sql('chunks', 'id', 'search_text')} SELECT tok AS token, count(DISTINCT id) AS df, count(*) AS n FROM toks GROUP BY tok")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = current_chunks(table(spark, sf_dir, "indexed_chunks"))
    return index.document_frequency(index.postings(chunks, ["id"], T.tokens(F.col("search_text"))))


@query(
    f"WITH src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {tokens_sql('src', 'doc_id', 'text')}, lens AS (SELECT src.doc_id, coalesce(c, 0) AS len FROM src LEFT JOIN (SELECT doc_id, count(*) AS c FROM toks GROUP BY doc_id) k USING (doc_id)), {bm25_sql('toks', 'doc_id', 'lens')} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, doc_id LIMIT 20"
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    scored = index.bm25(docs, ["doc_id"], T.tokens(F.col("text")), TERMS)
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(
    f"""WITH {CHUNKS_SQL}, cand AS (SELECT id, chunk_text, search_text FROM chunks WHERE ends_with({PATH_SQL}, '.py') AND contains({PATH_SQL}, 'src/') AND search_text IS NOT NULL), {tokens_sql('cand', 'id', 'search_text')},
  cw AS (SELECT id, unnest(regexp_extract_all(chunk_text, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM cand), cs AS (SELECT id, w, CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda p: p <> '') ELSE list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p)) END AS parts FROM cw),
  cc AS (SELECT id, sum(len({SPLIT_SQL}))::BIGINT AS c FROM cs GROUP BY id), sc AS (SELECT id, count(*) AS c FROM toks GROUP BY id),
  lens AS (SELECT cand.id, coalesce(nullif(cc.c, 0), sc.c, 0) AS len FROM cand LEFT JOIN cc USING (id) LEFT JOIN sc USING (id)), {bm25_sql('toks', 'id', 'lens')}
  SELECT id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, id LIMIT 20"""
)
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of the chunks of one language below a folder; the statistics are those of the filtered chunks, lengths those of the chunk text."""
    path = chunk_path("file_record_id")
    cand = current_chunks(table(spark, sf_dir, "indexed_chunks")).where((T.language(path) == "python") & path.contains("src/") & F.col("search_text").isNotNull())
    own = F.size(T.tokens(F.col("chunk_text")))
    length = F.when(own > 0, own).otherwise(F.size(T.tokens(F.col("search_text"))))
    scored = index.bm25(cand, ["id"], T.tokens(F.col("search_text")), TERMS, length)
    return scored.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(
    f"""WITH {CHUNKS_SQL}, src AS (SELECT id, project_key, search_text FROM chunks WHERE search_text IS NOT NULL), {tokens_sql('src', 'id', 'search_text')},
  lens AS (SELECT src.id, src.project_key, coalesce(c, 0) AS len FROM src LEFT JOIN (SELECT id, count(*) AS c FROM toks GROUP BY id) k USING (id)), st AS (SELECT project_key, count(*)::DOUBLE AS n, CASE WHEN sum(len) > 0 THEN sum(len)::DOUBLE / count(*) ELSE 1.0::DOUBLE END AS av FROM lens GROUP BY project_key),
  qs AS (SELECT DISTINCT query_text, project_key FROM search_results), qw AS (SELECT query_text, project_key, unnest(regexp_extract_all(query_text, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM qs),
  qp AS (SELECT query_text, project_key, w, CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda p: p <> '') ELSE list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p)) END AS parts FROM qw),
  qt AS (SELECT DISTINCT query_text, project_key, unnest({SPLIT_SQL}) AS tok FROM qp), tf AS (SELECT t.id, l.project_key, l.len, t.tok, count(*)::DOUBLE AS tf FROM toks t JOIN lens l USING (id) GROUP BY ALL), df AS (SELECT project_key, tok, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
  s AS (SELECT q.query_text, q.project_key, tf.id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av))), 6) AS score
    FROM qt q JOIN tf ON tf.project_key = q.project_key AND tf.tok = q.tok JOIN df ON df.project_key = q.project_key AND df.tok = q.tok JOIN st ON st.project_key = q.project_key GROUP BY ALL)
  SELECT query_text, project_key, id, score, row_number() OVER (PARTITION BY query_text, project_key ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10"""
)
def bm25_query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks for every logged query within its project, all queries of a project in one pass over blocks of its chunks."""
    chunks = current_chunks(table(spark, sf_dir, "indexed_chunks")).where("search_text is not null")
    queries = table(spark, sf_dir, "search_results").select("project_key", "query_text").distinct()
    scored = index.bm25_many(chunks, queries, ["project_key"], ["id"], T.tokens(F.col("search_text")), limit=10)
    w = Window.partitionBy("query_text", "project_key").orderBy(F.desc("score"), "id")
    return scored.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10")


_SCOPE_SQL = "CASE scope WHEN 'project' THEN 0 WHEN 'dir' THEN 1 WHEN 'user' THEN 2 ELSE 3 END"
_MEM_TEXT_SQL = "id || ' ' || scope || ' ' || coalesce(namespace, '') || ' ' || coalesce(leaf_name, '') || ' ' || coalesce(parent_context, '') || ' ' || coalesce(source, '') || ' ' || coalesce(adapter, '') || ' ' || coalesce(origin, '') || ' ' || coalesce(text, '') || ' ' || coalesce(structured, '{}')"
_MEM_TERMS = ["rollup", "chunk", "stale"]


def memory_text() -> Column:
    """All searchable words of a record; missing parts leave an empty slot."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws(" ", F.col("id"), F.col("scope"), *[e(c) for c in ("namespace", "leaf_name", "parent_context", "source", "adapter", "origin", "text")], F.coalesce(F.col("structured"), F.lit("{}")))


def memory_bm25_scores(records: DataFrame, terms: list[str]) -> DataFrame:
    """(id, scope, score) of records, lengths counted over all their tokens, at least 1."""
    toks = T.wide_tokens(memory_text())
    return index.bm25(records, ["id", "scope"], toks, terms, F.greatest(F.size(toks), F.lit(1)))


@query(
    f"""WITH {RECORDS_SQL}, m AS (SELECT id, scope, {_MEM_TEXT_SQL} AS body FROM records WHERE scope IN ('project', 'user')), toks AS (SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_-]+')) AS tok FROM m),
  lens AS (SELECT m.id, greatest(coalesce(c, 0), 1) AS len FROM m LEFT JOIN (SELECT id, count(*) AS c FROM toks GROUP BY id) k USING (id)), {bm25_sql('toks', 'id', 'lens', "('rollup', 'chunk', 'stale')")}
  SELECT s.id, m.scope, round(score, 6) AS score FROM scored s JOIN m USING (id) ORDER BY round(score, 6) DESC, {_SCOPE_SQL}, s.id LIMIT 25"""
)
def memory_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = current_records(table(spark, sf_dir, "memory_records")).where(F.col("scope").isin("project", "user"))
    scored = memory_bm25_scores(records, _MEM_TERMS).withColumn("score", F.round("score", 6))
    scope = F.when(F.col("scope") == "project", 0).when(F.col("scope") == "dir", 1).when(F.col("scope") == "user", 2).otherwise(3)
    return scored.orderBy(F.desc("score"), scope, "id").limit(25)


@query(
    """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, (CASE WHEN contains(t, '100%') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'lease_holder') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'merge') THEN 1 ELSE 0 END) AS n FROM d)
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank, round(1.0::DOUBLE / row_number() OVER (ORDER BY doc_id), 6) AS score FROM h WHERE n > 0 ORDER BY doc_id LIMIT 50"""
)
def like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search for up to three terms, wildcards taken literally, scored by the reciprocal of the rank."""
    low = F.lower("text")
    hit = low.contains("100%") | low.contains("lease_holder") | low.contains("merge")
    best = table(spark, sf_dir, "documents").where(hit).select("doc_id").orderBy("doc_id").limit(50)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("doc_id")).cast("long"))
    return ranked.select("doc_id", "rank", F.round(F.lit(1.0) / F.col("rank"), 6).alias("score"))
