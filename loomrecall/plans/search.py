"""Queries on vector search, hybrid fusion and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrecall.functions import constants as C
from loomrecall.functions import text as T
from loomrecall.functions import vectors as V
from loomrecall.operators import fusion, index, vectors
from loomrecall.operators.tables import CHUNKS_SQL, PATH_SQL, RECORDS_SQL, chunk_path, current_chunks, current_records, tokens_sql
from loomrecall.plans.index import _MEM_TERMS, _MEM_TEXT_SQL, TERMS, bm25_sql, memory_bm25_scores
from loomrecall.plans.registry import query
from loomrecall.plans.texts import _PENALTY_SQL, STEM_SQL, split_sql
from loomrecall.session import table

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(
    f"""WITH c AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS cs FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
  SELECT query_id, vec_id, round(cs, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(cs, 9) DESC, vec_id) AS rank FROM c QUALIFY rank <= 10"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors for each query vector (every row whose id is divisible by 100), against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.exact_neighbors(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).withColumn("cosine", F.round("cosine", 6))


@query(
    f"""WITH c AS (SELECT b.vec_id, {_COS} AS cs FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0) SELECT vec_id, round(cs, 6) AS cosine FROM c WHERE round(cs, 9) >= 0.35"""
)
def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of at least the memory threshold to one vector, in columns alone."""
    rows = table(spark, sf_dir, "embeddings")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    cs = V.cosine(F.col("q"), F.col("embedding"))
    # The query side is one row.
    return rows.where("vec_id <> 0").join(F.broadcast(one)).select("vec_id", cs.alias("cosine")).where(F.round("cosine", 9) >= C.MEMORY_MIN_COSINE).withColumn("cosine", F.round("cosine", 6))


_LEX_SQL = f"src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {tokens_sql('src', 'doc_id', 'text')}, lens AS (SELECT src.doc_id, coalesce(c, 0) AS len FROM src LEFT JOIN (SELECT doc_id, count(*) AS c FROM toks GROUP BY doc_id) k USING (doc_id)), {bm25_sql('toks', 'doc_id', 'lens')}"
_SEM_SQL = f"sem AS (SELECT b.vec_id AS doc_id, {_COS} AS cs FROM embeddings a, embeddings b JOIN documents d ON d.doc_id = b.vec_id WHERE a.vec_id = 0)"


@query(
    f"""WITH {_LEX_SQL}, {_SEM_SQL}, l AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM scored QUALIFY r <= 50), s AS (SELECT doc_id, row_number() OVER (ORDER BY round(cs, 9) DESC, doc_id) AS r FROM sem QUALIFY r <= 50),
  f AS (SELECT coalesce(l.doc_id, s.doc_id) AS doc_id, 0.5::DOUBLE * coalesce(1.0::DOUBLE / (60.0::DOUBLE + s.r), 0.0::DOUBLE) + 0.5::DOUBLE * coalesce(1.0::DOUBLE / (60.0::DOUBLE + l.r), 0.0::DOUBLE) AS score FROM l FULL OUTER JOIN s USING (doc_id))
  SELECT doc_id, round(score, 6) AS score FROM f ORDER BY round(score, 9) DESC, doc_id LIMIT 20"""
)
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and vectors fused by reciprocal ranks; 50 candidates from each side for 20 results."""
    docs = table(spark, sf_dir, "documents")
    rows = table(spark, sf_dir, "embeddings")
    lexical = index.bm25(docs.where("text is not null"), ["doc_id"], T.tokens(F.col("text")), TERMS)
    lexical = lexical.orderBy(F.desc(F.round("score", 6)), "doc_id").limit(50).withColumn("lr", F.row_number().over(Window.orderBy(F.desc(F.round("score", 6)), "doc_id"))).select("doc_id", "lr")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = rows.join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id")).join(F.broadcast(one)).select("doc_id", F.round(V.cosine(F.col("q"), F.col("embedding")), 9).alias("cs"))
    semantic = near.orderBy(F.desc("cs"), "doc_id").limit(50).withColumn("sr", F.row_number().over(Window.orderBy(F.desc("cs"), "doc_id"))).select("doc_id", "sr")
    fused = lexical.join(semantic, "doc_id", "full_outer").select("doc_id", (F.lit(0.5) * F.coalesce(fusion.rrf(F.col("sr")), F.lit(0.0)) + F.lit(0.5) * F.coalesce(fusion.rrf(F.col("lr")), F.lit(0.0))).alias("score"))
    return fused.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(20).withColumn("score", F.round("score", 6))


_USABLE_SQL = "vecs AS (SELECT record_id, embedding, provider_key, model FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY updated_at DESC, status DESC) AS rn FROM record_embeddings) WHERE rn = 1 AND status = 'ready' AND len(embedding) = dimension AND dimension = configured_dimension AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"


def usable_record_vectors(rows: DataFrame) -> DataFrame:
    """Latest ready, complete, finite and non-zero vector of each record."""
    w = Window.partitionBy("record_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("status").desc_nulls_last())
    last = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 and status = 'ready'").where((F.size("embedding") == F.col("dimension")) & (F.col("dimension") == F.col("configured_dimension")))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return last.where(finite & F.exists("embedding", lambda x: x != 0)).select("record_id", "embedding", "provider_key", "model")


@query(
    f"""WITH {RECORDS_SQL}, {_USABLE_SQL}, m AS (SELECT id, scope, {_MEM_TEXT_SQL} AS body FROM records), toks AS (SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_-]+')) AS tok FROM m),
  lens AS (SELECT m.id, greatest(coalesce(c, 0), 1) AS len FROM m LEFT JOIN (SELECT id, count(*) AS c FROM toks GROUP BY id) k USING (id)), {bm25_sql('toks', 'id', 'lens', "('rollup', 'chunk', 'stale')")},
  l AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM scored QUALIFY r <= 100), qv AS (SELECT * FROM vecs WHERE record_id = (SELECT min(record_id) FROM vecs)),
  sm AS (SELECT b.record_id AS id, {_COS} AS cs FROM qv a JOIN vecs b ON a.provider_key = b.provider_key AND a.model = b.model JOIN records ON records.id = b.record_id), s AS (SELECT id, row_number() OVER (ORDER BY round(cs, 9) DESC, id) AS r FROM sm WHERE round(cs, 9) >= 0.35 QUALIFY r <= 100),
  ln AS (SELECT id, (1.0::DOUBLE / (60.0::DOUBLE + r)) / (1.0::DOUBLE / 61.0::DOUBLE) AS v FROM l), sn AS (SELECT id, (1.0::DOUBLE / (60.0::DOUBLE + r)) / (1.0::DOUBLE / 61.0::DOUBLE) AS v FROM s)
  SELECT coalesce(ln.id, sn.id) AS id, round(0.5::DOUBLE * coalesce(ln.v, 0) + 0.5::DOUBLE * coalesce(sn.v, 0), 6) AS score FROM ln FULL OUTER JOIN sn ON ln.id = sn.id ORDER BY score DESC, id LIMIT 30"""
)
def memory_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record search by words and by the vector of one record, each side's reciprocal ranks divided by their best."""
    records = current_records(table(spark, sf_dir, "memory_records"))
    lex = memory_bm25_scores(records, _MEM_TERMS).withColumn("s", F.round("score", 6)).orderBy(F.desc("s"), "id").limit(100)
    lex = lex.select("id", (fusion.rrf(F.row_number().over(Window.orderBy(F.desc("s"), "id"))) / F.lit(1.0 / 61.0)).alias("lv"))
    vecs = usable_record_vectors(table(spark, sf_dir, "record_embeddings"))
    one = vecs.orderBy("record_id").limit(1).select(F.col("embedding").alias("q"), F.col("provider_key").alias("qp"), F.col("model").alias("qm"))
    near = vecs.join(F.broadcast(one), (F.col("provider_key") == F.col("qp")) & (F.col("model") == F.col("qm"))).join(records.select("id"), F.col("record_id") == F.col("id"), "left_semi")
    sem = near.select(F.col("record_id").alias("id"), F.round(V.cosine(F.col("q"), F.col("embedding")), 9).alias("cs")).where(F.col("cs") >= C.MEMORY_MIN_COSINE).orderBy(F.desc("cs"), "id").limit(100)
    sem = sem.select("id", (fusion.rrf(F.row_number().over(Window.orderBy(F.desc("cs"), "id"))) / F.lit(1.0 / 61.0)).alias("sv"))
    both = lex.join(sem, "id", "full_outer")
    score = F.round(F.lit(0.5) * F.coalesce("lv", F.lit(0.0)) + F.lit(0.5) * F.coalesce("sv", F.lit(0.0)), 6)
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(30)


_HITS_SQL = "hits AS (SELECT query_text, project_key, regexp_replace(replace(file_path, '\\', '/'), '^\\./', '') AS file_path, chunk_index, max(score) AS score, max(lexical_score) AS lexical_score, max(semantic_score) AS semantic_score FROM search_results WHERE score IS NOT NULL GROUP BY 1, 2, 3, 4)"
_BY = ["query_text"]


def logged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged search results as candidates: one row per query, project, file (one spelling) and chunk."""
    path = F.regexp_replace(T.slashed(F.col("file_path")), r"^\./", "")
    rows = table(spark, sf_dir, "search_results").where("score is not null").withColumn("file_path", path)
    return rows.groupBy("query_text", "project_key", "file_path", "chunk_index").agg(F.max("score").alias("score"), F.max("lexical_score").alias("lexical_score"), F.max("semantic_score").alias("semantic_score"))


_OUT = ["query_text", "project_key", "file_path", "chunk_index"]


@query(
    f"""WITH {_HITS_SQL}, l AS (SELECT query_text, project_key, file_path, chunk_index, row_number() OVER (PARTITION BY query_text ORDER BY lexical_score DESC, project_key, file_path, chunk_index) AS r FROM hits WHERE lexical_score IS NOT NULL),
  s AS (SELECT query_text, project_key, file_path, chunk_index, row_number() OVER (PARTITION BY query_text ORDER BY semantic_score DESC, project_key, file_path, chunk_index) AS r FROM hits WHERE semantic_score IS NOT NULL)
  SELECT query_text, project_key, file_path, chunk_index, round(alpha * coalesce(1.0::DOUBLE / (60 + s.r), 0) + (1 - alpha) * coalesce(1.0::DOUBLE / (60 + l.r), 0), 6) AS score
  FROM (SELECT *, CASE WHEN regexp_matches(trim(query_text), '{C.SYMBOL_QUERY}') THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS alpha FROM hits) h LEFT JOIN l USING (query_text, project_key, file_path, chunk_index) LEFT JOIN s USING (query_text, project_key, file_path, chunk_index) WHERE l.r IS NOT NULL OR s.r IS NOT NULL"""
)
def logged_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the logged word and vector scores of each query, weighted by the kind of the query."""
    hits = logged_hits(spark, sf_dir)
    ties = ["project_key", "file_path", "chunk_index"]
    lex = fusion.ranked(hits.where("lexical_score is not null"), _BY, "lexical_score", ties, "lr").select(*_OUT, "lr")
    sem = fusion.ranked(hits.where("semantic_score is not null"), _BY, "semantic_score", ties, "sr").select(*_OUT, "sr")
    both = lex.join(sem, _OUT, "full_outer")
    alpha = F.when(T.is_symbol_query(F.col("query_text")), F.lit(C.SYMBOL_ALPHA)).otherwise(F.lit(C.DEFAULT_ALPHA))
    score = alpha * F.coalesce(fusion.rrf(F.col("sr")), F.lit(0.0)) + (F.lit(1.0) - alpha) * F.coalesce(fusion.rrf(F.col("lr")), F.lit(0.0))
    return both.select(*_OUT, F.round(score, 6).alias("score"))


_COH_SQL = """coh AS (SELECT query_text, project_key, file_path, chunk_index, CASE WHEN fr = 1 AND top <> 0 THEN score + top * 0.2::DOUBLE * fsum / max(fsum) OVER (PARTITION BY query_text) ELSE score END AS score
  FROM (SELECT *, sum(score) OVER (PARTITION BY query_text, file_path) AS fsum, max(score) OVER (PARTITION BY query_text) AS top, row_number() OVER (PARTITION BY query_text, file_path ORDER BY score DESC, project_key, chunk_index) AS fr FROM hits))"""


@query(f"WITH {_HITS_SQL}, {_COH_SQL} SELECT query_text, project_key, file_path, chunk_index, round(score, 6) AS score FROM coh")
def coherence_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.coherence_boost(logged_hits(spark, sf_dir), _BY, "file_path", "score", ["project_key", "chunk_index"])
    return out.select(*_OUT, F.round("score", 6).alias("score"))


_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in C.STOPWORDS) + ")"
_KW_PARTS = "CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda q: q <> '') ELSE list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda q: lower(q)) END"
_STEM_BOOST_SQL = f"""qs AS (SELECT DISTINCT query_text FROM hits), qw AS (SELECT query_text, unnest(regexp_extract_all(query_text, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM qs),
  qk AS (SELECT query_text, w, {_KW_PARTS} AS parts FROM qw WHERE length(w) > 1 AND lower(w) NOT IN {_STOP_SQL} AND NOT list_contains(regexp_extract_all(query_text, '\\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\\b'), w)),
  kw AS (SELECT DISTINCT query_text, k FROM (SELECT query_text, unnest(list_concat([lower(w)], CASE WHEN len(parts) >= 2 THEN parts ELSE [] END)) AS k FROM qk) WHERE length(k) > 1 AND k NOT IN {_STOP_SQL}),
  kn AS (SELECT query_text, count(*) AS n FROM kw GROUP BY query_text), ps AS (SELECT DISTINCT file_path, file_path AS p FROM hits), pv AS (SELECT file_path, {STEM_SQL} AS st, lower(coalesce(list_extract(list_filter(string_split(p, '/'), lambda x: x <> ''), -2), '')) AS par FROM ps),
  vv AS (SELECT file_path, unnest(list_filter(list_distinct(list_concat({split_sql("st")}, {split_sql("par")})), lambda x: x <> '')) AS v FROM pv),
  mt AS (SELECT h.query_text, h.file_path, count(DISTINCT k) AS m FROM (SELECT DISTINCT query_text, file_path FROM hits) h JOIN kw USING (query_text) JOIN vv USING (file_path)
    WHERE k = v OR (length(k) <= length(v) AND length(k) >= 3 AND starts_with(v, k)) OR (length(v) < length(k) AND length(v) >= 3 AND starts_with(k, v)) GROUP BY 1, 2),
  stm AS (SELECT h.query_text, h.project_key, h.file_path, h.chunk_index, h.score + CASE WHEN NOT regexp_matches(trim(h.query_text), '{C.SYMBOL_QUERY}') AND coalesce(m, 0) / n::DOUBLE >= 0.1 THEN max(h.score) OVER (PARTITION BY h.query_text) * (m / n::DOUBLE) ELSE 0 END AS score
    FROM hits h LEFT JOIN mt ON mt.query_text = h.query_text AND mt.file_path = h.file_path LEFT JOIN kn ON kn.query_text = h.query_text)"""


@query(f"WITH {_HITS_SQL}, {_STEM_BOOST_SQL} SELECT query_text, project_key, file_path, chunk_index, round(score, 6) AS score FROM stm")
def stem_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.stem_boost(logged_hits(spark, sf_dir), _BY, "query_text", "file_path", "score").select(*_OUT, F.round("score", 6).alias("score"))


def _saturated_sql(source: str, k: int) -> str:
    return f"""pen AS (SELECT query_text, project_key, file_path, chunk_index, score * ({_PENALTY_SQL}) AS score FROM (SELECT *, file_path AS p FROM {source})),
  sat AS (SELECT *, score * pow(0.5::DOUBLE, row_number() OVER (PARTITION BY query_text, file_path ORDER BY score DESC, project_key, chunk_index) - 1) AS eff FROM pen)
  SELECT query_text, project_key, file_path, chunk_index, round(eff, 6) AS score, row_number() OVER (PARTITION BY query_text ORDER BY eff DESC, file_path, project_key, chunk_index) AS rank FROM sat QUALIFY rank <= {k}"""


@query(f"WITH {_HITS_SQL}, {_saturated_sql('hits', 5)}")
def rerank_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.saturated(logged_hits(spark, sf_dir), _BY, "file_path", "score", ["project_key", "chunk_index"], 5)
    return out.select(*_OUT, F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_HITS_SQL}, {_COH_SQL}, {_saturated_sql('coh', 10)}")
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence boost, path penalties and decay per file in a row, as a hybrid search ends."""
    boosted = fusion.coherence_boost(logged_hits(spark, sf_dir), _BY, "file_path", "score", ["project_key", "chunk_index"])
    out = fusion.saturated(boosted, _BY, "file_path", "score", ["project_key", "chunk_index"], 10)
    return out.select(*_OUT, F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {_LEX_SQL}, cov AS (SELECT doc_id, count(DISTINCT tok) AS coverage FROM toks WHERE tok IN ('cached', 'query', 'lease') GROUP BY doc_id), mx AS (SELECT max(coverage) AS top FROM cov)
  SELECT s.doc_id, coverage, round(score * CASE WHEN top > 1 AND coverage = top THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM scored s JOIN cov USING (doc_id), mx ORDER BY score DESC, doc_id LIMIT 25"""
)
def coverage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word search where only the texts with the most query terms are boosted, if any holds more than one."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    toks = T.tokens(F.col("text"))
    scored = index.bm25(docs, ["doc_id"], toks, TERMS)
    cover = docs.select("doc_id", F.size(F.array_intersect(toks, F.array(*[F.lit(t) for t in TERMS]))).cast("long").alias("coverage")).where("coverage > 0")
    top = cover.agg(F.max("coverage").alias("top"))
    gain = F.when((F.col("top") > 1) & (F.col("coverage") == F.col("top")), F.lit(2.0)).otherwise(F.lit(1.0))
    out = scored.join(cover, "doc_id").join(F.broadcast(top)).select("doc_id", "coverage", F.round(F.col("score") * gain, 6).alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(25)


@query(
    f"""WITH {CHUNKS_SQL}, seeds AS (SELECT file_record_id, max(end_line) // 2 + 1 AS seed FROM chunks GROUP BY 1) SELECT s.file_record_id, s.seed::BIGINT AS seed, c.chunk_index, c.id AS chunk_id FROM seeds s JOIN chunks c USING (file_record_id)
  WHERE s.seed BETWEEN c.start_line AND c.end_line QUALIFY row_number() OVER (PARTITION BY s.file_record_id ORDER BY c.chunk_index, c.id) = 1"""
)
def seed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line to chunk: the first chunk in order whose lines hold the middle line of each file (an interval join on the file)."""
    chunks = current_chunks(table(spark, sf_dir, "indexed_chunks"))
    seeds = chunks.groupBy("file_record_id").agg((F.floor(F.max("end_line") / 2) + 1).alias("seed"))
    hit = chunks.join(seeds, "file_record_id").where(F.col("seed").between(F.col("start_line"), F.col("end_line")))
    first = Window.partitionBy("file_record_id").orderBy("chunk_index", "id")
    return hit.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("file_record_id", F.col("seed").cast("long").alias("seed"), "chunk_index", F.col("id").alias("chunk_id"))


_DEF_SQL = "(?m)(?:^|\\s)(?:" + "|".join(C.DEFINITION_KEYWORDS) + ")\\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\\.|::))*' || sy.symbol || '(?:\\s|[<({:\\[]|$)"


@query(
    f"""WITH {CHUNKS_SQL}, sy AS (SELECT DISTINCT project_key, trim(query_text) AS symbol FROM search_results WHERE regexp_matches(trim(query_text), '^[A-Za-z_][A-Za-z0-9_]*$') AND regexp_matches(trim(query_text), '{C.SYMBOL_QUERY}')),
  w AS (SELECT DISTINCT id, project_key, chunk_text, unnest(regexp_extract_all(chunk_text, '[A-Za-z_][A-Za-z0-9_]*')) AS symbol FROM chunks)
  SELECT sy.project_key, sy.symbol, count(*) AS mentions, count(*) FILTER (WHERE regexp_matches(chunk_text, '{_DEF_SQL}')) AS definitions FROM sy JOIN w ON w.project_key = sy.project_key AND w.symbol = sy.symbol GROUP BY 1, 2"""
)
def symbol_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each logged symbol query: chunks of its project that mention the symbol, and those that define it (an equi-join on the words, then the definition test)."""
    chunks = current_chunks(table(spark, sf_dir, "indexed_chunks"))
    q = F.trim("query_text")
    symbols = table(spark, sf_dir, "search_results").where(T.is_symbol_query(q) & q.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")).select("project_key", q.alias("symbol")).distinct()
    words = chunks.select("id", "project_key", F.explode(F.array_distinct(T.raw_words(F.col("chunk_text")))).alias("symbol"))
    # Words meet the symbols without their texts; only the texts of hits are fetched.
    hit = words.join(symbols, ["project_key", "symbol"]).join(chunks.select("id", "chunk_text"), "id")
    return hit.groupBy("project_key", "symbol").agg(F.count(F.lit(1)).alias("mentions"), F.count_if(fusion.defines(F.col("chunk_text"), F.col("symbol"))).alias("definitions"))


_NAMED_SQL = "CASE WHEN v = low OR replace(v, '_', '') = low OR regexp_replace(v, 's$', '') = low OR regexp_replace(replace(v, '_', ''), 's$', '') = low THEN 1 ELSE 0 END"


@query(
    f"""WITH {CHUNKS_SQL}, {_HITS_SQL}, j AS (SELECT h.*, c.chunk_text, trim(regexp_extract(trim(h.query_text), '(?s)^(?:.*(?:::|\\\\|->|\\.))?(.*)$', 1)) AS symbol, h.file_path AS p FROM hits h LEFT JOIN (SELECT file_record_id, chunk_index, min(chunk_text) AS chunk_text FROM chunks GROUP BY 1, 2) c ON c.file_record_id = 'file-record:' || h.project_key || ':' || h.file_path AND c.chunk_index = h.chunk_index),
  pv AS (SELECT *, lower(symbol) AS low, {STEM_SQL} AS st, lower(coalesce(list_extract(list_filter(string_split(p, '/'), lambda x: x <> ''), -2), '')) AS par FROM j),
  nm AS (SELECT *, list_sum(list_transform(list_filter(list_concat({split_sql("st")}, {split_sql("par")}), lambda x: x <> ''), lambda v: {_NAMED_SQL})) > 0 AS named FROM pv)
  SELECT query_text, project_key, file_path, chunk_index, round(score + CASE WHEN regexp_matches(trim(query_text), '{C.SYMBOL_QUERY}') AND coalesce(regexp_matches(chunk_text, '{_DEF_SQL.replace("sy.symbol", "symbol")}'), false) THEN max(score) OVER (PARTITION BY query_text) * 3.0::DOUBLE * CASE WHEN named THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 0 END, 6) AS score FROM nm"""
)
def definition_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged hits of symbol queries, the defining chunks first."""
    texts = current_chunks(table(spark, sf_dir, "indexed_chunks")).groupBy("file_record_id", "chunk_index").agg(F.min("chunk_text").alias("chunk_text"))
    hits = logged_hits(spark, sf_dir).withColumn("file_record_id", F.concat(F.lit("file-record:"), "project_key", F.lit(":"), "file_path"))
    held = hits.join(texts, ["file_record_id", "chunk_index"], "left")
    return fusion.definition_boost(held, _BY, "query_text", "file_path", "chunk_text", "score").select(*_OUT, F.round("score", 6).alias("score"))


@query(
    f"""WITH {CHUNKS_SQL}, {_HITS_SQL}, j AS (SELECT h.*, c.chunk_text, h.file_path AS p FROM hits h LEFT JOIN (SELECT file_record_id, chunk_index, min(chunk_text) AS chunk_text FROM chunks GROUP BY 1, 2) c ON c.file_record_id = 'file-record:' || h.project_key || ':' || h.file_path AND c.chunk_index = h.chunk_index),
  pv AS (SELECT *, {STEM_SQL} AS st, lower(coalesce(list_extract(list_filter(string_split(p, '/'), lambda x: x <> ''), -2), '')) AS par FROM j), vs AS (SELECT *, list_filter(list_concat({split_sql("st")}, {split_sql("par")}), lambda x: x <> '') AS v FROM pv),
  nm AS (SELECT query_text, project_key, file_path, chunk_index, chunk_text, v, unnest(list_distinct(regexp_extract_all(query_text, '{C.EMBEDDED_SYMBOL}'))) AS symbol FROM vs),
  hd AS (SELECT query_text, project_key, file_path, chunk_index, bool_or(coalesce(regexp_matches(chunk_text, '{_DEF_SQL.replace("sy.symbol", "symbol")}'), false)) AS def, bool_or(list_contains(v, lower(symbol))) AS named FROM nm GROUP BY ALL)
  SELECT j.query_text, j.project_key, j.file_path, j.chunk_index, round(score + CASE WHEN NOT regexp_matches(trim(j.query_text), '{C.SYMBOL_QUERY}') AND coalesce(def, false) THEN max(score) OVER (PARTITION BY j.query_text) * 3.0::DOUBLE * {C.EMBEDDED_BOOST_SCALE}::DOUBLE * CASE WHEN named THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 0 END, 6) AS score
  FROM j LEFT JOIN hd ON hd.query_text = j.query_text AND hd.project_key = j.project_key AND hd.file_path = j.file_path AND hd.chunk_index = j.chunk_index"""
)
def embedded_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged hits of questions that hold symbols, the chunks that define one of them first."""
    texts = current_chunks(table(spark, sf_dir, "indexed_chunks")).groupBy("file_record_id", "chunk_index").agg(F.min("chunk_text").alias("chunk_text"))
    hits = logged_hits(spark, sf_dir).withColumn("file_record_id", F.concat(F.lit("file-record:"), "project_key", F.lit(":"), "file_path"))
    held = hits.join(texts, ["file_record_id", "chunk_index"], "left")
    return fusion.embedded_boost(held, _BY, "query_text", "file_path", "chunk_text", "score").select(*_OUT, F.round("score", 6).alias("score"))


@query(
    f"""WITH {CHUNKS_SQL}, {_HITS_SQL}, sy AS (SELECT DISTINCT query_text, project_key, trim(regexp_extract(trim(query_text), '(?s)^(?:.*(?:::|\\\\|->|\\.))?(.*)$', 1)) AS symbol FROM hits WHERE regexp_matches(trim(query_text), '{C.SYMBOL_QUERY}')),
  w AS (SELECT DISTINCT id, project_key, {PATH_SQL} AS file_path, chunk_index, chunk_text, unnest(regexp_extract_all(chunk_text, '[A-Za-z_][A-Za-z0-9_]*')) AS symbol FROM chunks),
  d AS (SELECT DISTINCT sy.query_text, sy.project_key, w.file_path, w.chunk_index FROM sy JOIN w ON w.project_key = sy.project_key AND w.symbol = sy.symbol WHERE regexp_matches(chunk_text, '{_DEF_SQL}')),
  u AS (SELECT query_text, project_key, file_path, chunk_index, score FROM hits WHERE query_text IN (SELECT query_text FROM sy) UNION ALL SELECT d.*, 0.0::DOUBLE FROM d WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_text = d.query_text AND h.project_key = d.project_key AND h.file_path = d.file_path AND h.chunk_index = d.chunk_index))
  SELECT query_text, project_key, file_path, chunk_index, round(score, 6) AS score FROM u"""
)
def injected_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logged hits of symbol queries, and the chunks of the same project that define the symbol without having been hit."""
    hits = logged_hits(spark, sf_dir).where(T.is_symbol_query(F.col("query_text"))).select(*_OUT, "score")
    symbols = hits.select("query_text", "project_key", T.symbol_name(F.col("query_text")).alias("symbol")).distinct()
    chunks = current_chunks(table(spark, sf_dir, "indexed_chunks"))
    words = chunks.select("id", "project_key", F.explode(F.array_distinct(T.raw_words(F.col("chunk_text")))).alias("symbol"))
    texts = chunks.select("id", chunk_path("file_record_id").alias("file_path"), "chunk_index", "chunk_text")
    named = words.join(symbols, ["project_key", "symbol"]).join(texts, "id").select(*_OUT, "chunk_text").distinct()
    return fusion.with_definitions(hits, named, "query_text", "chunk_text", _OUT[1:], "score").select(*_OUT, F.round("score", 6).alias("score")).distinct()


@query(
    f"""WITH c AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS cs FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
  SELECT query_id, vec_id, round(cs, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(cs, 9) DESC, vec_id) AS rank FROM c QUALIFY rank <= 5"""
)
def find_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of the seed's own kind, the seed left out (seeds: every row whose id is divisible by 100)."""
    rows = table(spark, sf_dir, "embeddings")
    near = vectors.exact_neighbors(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5, by="label")
    return near.withColumn("cosine", F.round("cosine", 6))
