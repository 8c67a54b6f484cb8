"""Queries on text functions and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrecall.functions import constants as C
from loomrecall.functions import text as T
from loomrecall.functions import vectors as V
from loomrecall.operators import chunking
from loomrecall.operators.tables import CHUNKS_SQL, FILES_SQL, PATH_SQL, RECORDS_SQL, chunk_path, current_chunks, current_files, current_records, tokens_sql
from loomrecall.plans.registry import query
from loomrecall.session import table

_EXT_SQL = "lower(regexp_extract(parse_filename(replace(path, '\\', '/')), '.(\\.[^.]*)$', 1))"
_LANG_SQL = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LANGUAGES.items()) + " END"
_PENALTY_SQL = f"""(CASE WHEN regexp_matches(p, '{C.TEST_FILE}') OR regexp_matches(p, '{C.TEST_DIR}') THEN 0.3 ELSE 1.0 END)::DOUBLE * (CASE WHEN regexp_matches(p, '{C.REEXPORT_FILE}') THEN 0.5 ELSE 1.0 END)::DOUBLE
  * (CASE WHEN regexp_matches(p, '{C.COMPAT_DIR}') THEN 0.3 ELSE 1.0 END)::DOUBLE * (CASE WHEN regexp_matches(p, '{C.EXAMPLES_DIR}') THEN 0.3 ELSE 1.0 END)::DOUBLE * (CASE WHEN regexp_matches(p, '{C.TYPE_DEFS}') THEN 0.7 ELSE 1.0 END)::DOUBLE"""
STEM_SQL = "lower(regexp_replace(parse_filename(p), '\\.[^.]+$', ''))"


def split_sql(word: str) -> str:
    """The parts of a lower-case word, and the word itself."""
    parts = f"CASE WHEN contains({word}, '_') THEN list_filter(string_split({word}, '_'), lambda q: q <> '') ELSE regexp_extract_all({word}, '[a-z]+|[0-9]+') END"
    return f"list_concat([{word}], CASE WHEN len({parts}) >= 2 THEN {parts} ELSE [] END)"


@query(f"WITH src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {tokens_sql('src', 'doc_id', 'text')} SELECT tok AS token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM toks GROUP BY tok")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    per = toks.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(f"WITH {RECORDS_SQL}, w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+')) AS token FROM records WHERE text IS NOT NULL) SELECT token, count(*) AS n, count(DISTINCT id) AS records FROM w GROUP BY token")
def wide_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = current_records(table(spark, sf_dir, "memory_records")).select("id", F.explode(T.wide_tokens(F.col("text"))).alias("token"))
    per = toks.groupBy("token", "id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("records"))


@query(
    f"""WITH {CHUNKS_SQL}, words AS (SELECT DISTINCT unnest(regexp_extract_all(chunk_text, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM chunks),
  split AS (SELECT w, CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda p: p <> '') ELSE list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p)) END AS parts FROM words)
  SELECT w AS identifier, array_to_string(parts, ' ') AS parts FROM split WHERE len(parts) >= 2"""
)
def identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = current_chunks(table(spark, sf_dir, "indexed_chunks")).select(F.explode(F.array_distinct(T.raw_words(F.col("chunk_text")))).alias("identifier")).distinct()
    parts = T.split_identifier(F.col("identifier"))
    return words.where(F.size(parts) > 1).select("identifier", F.array_join(F.slice(parts, 2, 1000000), " ").alias("parts"))


@query(f"WITH {FILES_SQL}, e AS (SELECT {_EXT_SQL} AS ext, size_bytes FROM files) SELECT coalesce({_LANG_SQL}, 'text') AS language, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM e GROUP BY 1")
def language_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = current_files(table(spark, sf_dir, "file_records"))
    return files.groupBy(F.coalesce(T.language(F.col("path")), F.lit("text")).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


@query(
    f"""WITH {CHUNKS_SQL}, e AS (SELECT file_record_id, {_EXT_SQL.replace("path", "pth", 1)} AS ext FROM (SELECT file_record_id, {PATH_SQL} AS pth FROM chunks)),
  k AS (SELECT file_record_id, CASE WHEN ({_LANG_SQL}) IS NOT NULL THEN 'supported-code' WHEN ext = '' OR ext IN ({", ".join(repr(x) for x in C.PLAIN_EXTENSIONS)}) THEN 'plain-text' ELSE 'unsupported-language' END AS target FROM e)
  SELECT target, count(DISTINCT file_record_id) AS files, count(*) AS chunks FROM k GROUP BY target"""
)
def chunk_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = current_chunks(table(spark, sf_dir, "indexed_chunks")).groupBy("file_record_id").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(T.chunk_target(chunk_path("file_record_id")).alias("target")).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("chunks"))


@query(f"WITH {FILES_SQL}, q AS (SELECT id, replace(path, '\\', '/') AS p FROM files) SELECT id, round({_PENALTY_SQL}, 6) AS penalty FROM q")
def path_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_files(table(spark, sf_dir, "file_records")).select("id", F.round(T.path_penalty(F.col("path")), 6).alias("penalty"))


VARIANTS_SQL = f"""q AS (SELECT *, replace(path, '\\', '/') AS p FROM files), v AS (SELECT *, {STEM_SQL} AS st, lower(coalesce(nullif(list_extract(list_filter(string_split(p, '/'), lambda x: x <> ''), -2), NULL), '')) AS par FROM q),
  vars AS (SELECT *, list_filter(list_concat({split_sql("st")}, {split_sql("par")}), lambda x: x <> '') AS variants FROM v)"""


@query(f"WITH {FILES_SQL}, {VARIANTS_SQL} SELECT id, array_to_string(list_sort(list_distinct(variants)), ' ') AS variants FROM vars")
def path_stem_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_files(table(spark, sf_dir, "file_records")).select("id", F.array_join(F.array_sort(T.stem_variants(F.col("path"))), " ").alias("variants"))


KEYWORDS = ["vector", "search", "merge", "cache"]
_KW_SQL = " + ".join(f"(CASE WHEN list_contains(variants, '{k}') OR len(list_filter(variants, lambda x: (length(x) >= {len(k)} AND starts_with(x, '{k}')) OR (length(x) < {len(k)} AND length(x) >= 3 AND starts_with('{k}', x)))) > 0 THEN 1 ELSE 0 END)" for k in KEYWORDS)


@query(f"WITH {FILES_SQL}, {VARIANTS_SQL}, m AS (SELECT id, {_KW_SQL} AS hits FROM vars) SELECT id, hits::BIGINT AS hits, round(hits / {len(KEYWORDS)}.0::DOUBLE, 6) AS ratio FROM m WHERE hits > 0")
def keyword_match_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = T.keyword_matches(KEYWORDS, T.stem_variants(F.col("path")))
    return current_files(table(spark, sf_dir, "file_records")).select("id", hits.cast("long").alias("hits")).where("hits > 0").withColumn("ratio", F.round(F.col("hits") / F.lit(float(len(KEYWORDS))), 6))


FOLDER_SQL = "coalesce(nullif(regexp_replace(replace({}, '\\', '/'), '/?[^/]*$', ''), ''), '.')"


@query(f"WITH {FILES_SQL} SELECT {FOLDER_SQL.format('path')} AS folder, count(*) AS files FROM files GROUP BY 1")
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_files(table(spark, sf_dir, "file_records")).groupBy(T.folder(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


_KEY_SQL = "concat_ws(':', scope, lower(trim(namespace)), coalesce(nullif(lower(trim(parent_context)), ''), 'root'), regexp_replace(lower(trim(leaf_name)), '\\s+', '-', 'g'))"


@query(f"WITH {RECORDS_SQL} SELECT id, {_KEY_SQL} AS computed_key, coalesce(stable_key = {_KEY_SQL}, false) AS agrees FROM records")
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.stable_key(F.col("scope"), F.col("namespace"), F.col("parent_context"), F.col("leaf_name"))
    return current_records(table(spark, sf_dir, "memory_records")).select("id", key.alias("computed_key"), F.coalesce(F.col("stable_key") == key, F.lit(False)).alias("agrees"))


@query("SELECT project_key, 'project:' || lower(regexp_replace(list_extract(string_split(base_dir, '/'), -1), '[^A-Za-z0-9._-]+', '-', 'g')) || '-' || substr(sha256(base_dir), 1, 12) AS computed_key FROM file_search_projects")
def project_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.regexp_replace(F.element_at(F.split("base_dir", "/"), -1), r"[^A-Za-z0-9._-]+", "-"))
    return table(spark, sf_dir, "file_search_projects").select("project_key", F.concat(F.lit("project:"), name, F.lit("-"), F.substring(F.sha2("base_dir", 256), 1, 12)).alias("computed_key"))


@query(f"WITH {CHUNKS_SQL} SELECT id, sha256(chunk_text) AS sha256_hex, coalesce(chunk_hash = sha256(chunk_text), false) AS agrees FROM chunks WHERE chunk_text IS NOT NULL")
def chunk_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2("chunk_text", 256)
    return current_chunks(table(spark, sf_dir, "indexed_chunks")).where("chunk_text is not null").select("id", h.alias("sha256_hex"), F.coalesce(F.col("chunk_hash") == h, F.lit(False)).alias("agrees"))


@query(
    f"""WITH cut AS (SELECT doc_id, length(text) AS n, CASE WHEN length(text) <= {C.EMBEDDING_MAX_CHARS} THEN text ELSE substr(text, 1, {-(-(C.EMBEDDING_MAX_CHARS - len(C.EMBEDDING_MARKER)) * 7 // 10)}) || '{C.EMBEDDING_MARKER}' || right(text, {C.EMBEDDING_MAX_CHARS - len(C.EMBEDDING_MARKER) - (-(-(C.EMBEDDING_MAX_CHARS - len(C.EMBEDDING_MARKER)) * 7 // 10))}) END AS t FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, n > {C.EMBEDDING_MAX_CHARS} AS truncated, length(t)::BIGINT AS chars, sha256(t) AS text_hash FROM cut"""
)
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = T.truncate_middle(F.col("text"))
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", (F.length("text") > C.EMBEDDING_MAX_CHARS).alias("truncated"), F.length(cut).cast("long").alias("chars"), F.sha2(cut, 256).alias("text_hash"))


@query("WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, i::BIGINT AS dim, round(('0x' || substr(h, (1 + 2 * i)::INT, 2))::INT / 255.0::DOUBLE, 6) AS value FROM h, range(0, 8) t(i)")
def fallback_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(V.hash_vector(F.col("text"), 8)).alias("dim", "value")).select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


_SYMBOL_SQL = C.SYMBOL_QUERY


@query(
    f"""WITH q AS (SELECT DISTINCT query_text, trim(query_text) AS t FROM search_results) SELECT query_text, regexp_matches(t, '{_SYMBOL_SQL}') AS is_symbol, CASE WHEN regexp_matches(t, '{_SYMBOL_SQL}') THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS alpha,
  trim(regexp_extract(t, '(?s)^(?:.*(?:::|\\\\|->|\\.))?(.*)$', 1)) AS symbol FROM q"""
)
def symbol_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "search_results").select("query_text").distinct()
    sym = T.is_symbol_query(F.col("query_text"))
    return q.select("query_text", sym.alias("is_symbol"), F.when(sym, C.SYMBOL_ALPHA).otherwise(C.DEFAULT_ALPHA).alias("alpha"), T.symbol_name(F.col("query_text")).alias("symbol"))


@query(
    """WITH l AS (SELECT event_id, session_id, line_offset, content FROM transcript_lines GROUP BY ALL), lines AS (SELECT *, list_transform(string_split_regex(content, '\\r?\\n'), lambda x: CASE WHEN regexp_matches(x, '["'']?(tool_call|tool_result|toolCall|toolResult)["'']?\\s*:\\s*')
  THEN ltrim(rtrim(regexp_replace(x, '["'']?(tool_call|tool_result|toolCall|toolResult)["'']?\\s*:\\s*.*$', '')) || ' [REDACTED TOOL TRACE]') ELSE x END) AS xs FROM l)
  SELECT event_id, line_offset, md5(array_to_string(xs, chr(10))) AS clean_hash FROM lines WHERE content IS NOT NULL"""
)
def stripped_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "transcript_lines").select("event_id", "session_id", "line_offset", "content").distinct()
    return lines.where("content is not null").select("event_id", "line_offset", F.md5(T.strip_tool_traces(F.col("content"))).alias("clean_hash"))


_TRIM = "'^[ \\t\\r\\n\\f\\v]+|[ \\t\\r\\n\\f\\v]+$', '', 'g'"
_WINDOWS_SQL = f"""s AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS lines FROM documents WHERE text IS NOT NULL), n AS (SELECT *, len(lines) AS n FROM s),
  w AS (SELECT doc_id, lines, unnest(range(0, CASE WHEN n <= 50 THEN 1 ELSE ceil((n - 50) / 45.0)::BIGINT + 1 END)) AS win FROM n), c AS (SELECT doc_id, win, list_slice(lines, win * 45 + 1, win * 45 + 50) AS part FROM w),
  f AS (SELECT *, list_filter(range(1, len(part) + 1), lambda i: regexp_replace(part[i], {_TRIM}) <> '') AS fl FROM c),
  wins AS (SELECT doc_id, win, win * 45 + fl[1] AS start_line, win * 45 + fl[-1] AS end_line, sha256(regexp_replace(array_to_string(part, chr(10)), {_TRIM})) AS content_hash FROM f WHERE len(fl) > 0)"""


@query(
    f"""WITH {_WINDOWS_SQL}, g AS (SELECT doc_id, text, regexp_matches(text, '\\r?\\n[ \\t\\f]*\\r?\\n') AS gap FROM documents WHERE text IS NOT NULL),
  p AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS raw, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS line FROM g WHERE NOT gap), t AS (SELECT doc_id, line, regexp_replace(raw, {_TRIM}) AS content FROM p),
  b AS (SELECT doc_id, line, line AS nth, sha256(content) AS content_hash FROM t WHERE content <> '' UNION ALL SELECT doc_id, start_line, win, content_hash FROM wins JOIN g USING (doc_id) WHERE gap)
  SELECT doc_id, line::BIGINT AS line, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS chunk_index, content_hash FROM b"""
)
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line", "chunk_index", F.sha2("content", 256).alias("content_hash"))


@query(f'WITH {_WINDOWS_SQL} SELECT doc_id, win AS "window", start_line, end_line, content_hash FROM wins')
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.window_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "window", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


_FAMILY_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**{x: x for x in chunking.BOUNDARIES if x not in ("jvm", "other")}, "java": "jvm", "kotlin": "jvm", "scala": "jvm", "csharp": "jvm"}.items()) + " ELSE 'other' END"
_BOUNDARY_SQL = "CASE family " + " ".join(f"WHEN '{k}' THEN regexp_matches(x, '{v}')" for k, v in chunking.BOUNDARIES.items()) + " END"


@query(
    f"""WITH RECURSIVE {CHUNKS_SQL}, t AS (SELECT id, chunk_text, {PATH_SQL} AS path FROM chunks WHERE chunk_text IS NOT NULL), e AS (SELECT *, {_EXT_SQL} AS ext FROM t), l AS (SELECT id, string_split_regex(chunk_text, '\\r?\\n') AS lines, {_LANG_SQL} AS lang FROM e),
  u AS (SELECT id, {_FAMILY_SQL} AS family, unnest(list_transform(lines, lambda y: lower(regexp_replace(y, {_TRIM})))) AS x, generate_subscripts(lines, 1) AS i FROM l), pl AS (SELECT id, list(i) AS places FROM u WHERE x = '' OR {_BOUNDARY_SQL} GROUP BY id),
  b AS (SELECT l.id, lines, len(lines) AS n, coalesce(places, []) AS places FROM l LEFT JOIN pl USING (id)),
  w AS (SELECT id, 0 AS win, 0::BIGINT AS a, (CASE WHEN n <= 50 THEN n ELSE coalesce(list_max(list_filter(places, lambda p: p <= 50 AND p > 39)), 50) END)::BIGINT AS z FROM b
    UNION ALL SELECT id, win + 1, a, (CASE WHEN a + 50 >= n THEN n ELSE coalesce(list_max(list_filter(places, lambda p: p <= a + 50 AND p > greatest(a + 2, a + 39))), a + 50) END)::BIGINT FROM (SELECT w.id, w.win, greatest(w.a + 1, w.z - 5) AS a, b.n, b.places FROM w JOIN b USING (id) WHERE w.z < b.n)),
  c AS (SELECT w.id, win, a, list_slice(lines, a + 1, z) AS part FROM w JOIN b USING (id)), f AS (SELECT *, list_filter(range(1, len(part) + 1), lambda i: regexp_replace(part[i], {_TRIM}) <> '') AS fl FROM c)
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY win) - 1 AS chunk_index, a + fl[1] AS start_line, a + fl[-1] AS end_line, sha256(regexp_replace(array_to_string(part, chr(10)), {_TRIM})) AS content_hash FROM f WHERE len(fl) > 0"""
)
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary-aware windows over the text of every chunk."""
    chunks = current_chunks(table(spark, sf_dir, "indexed_chunks")).select("id", "chunk_text", T.language(chunk_path("file_record_id")).alias("lang"))
    return chunking.code_chunks(chunks, "id", "chunk_text", "lang").select("id", "chunk_index", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


_LEX_SQL = f"""x AS (SELECT *, replace({PATH_SQL}, '\\', '/') AS p FROM chunks), y AS (SELECT *, {STEM_SQL} AS st, list_slice(list_filter(string_split(p, '/'), lambda q: q <> '' AND q <> '.'), 1, len(list_filter(string_split(p, '/'), lambda q: q <> '' AND q <> '.')) - 1) AS dirs FROM x),
  z AS (SELECT *, trim(chunk_text || ' ' || st || ' ' || st || ' ' || lower(array_to_string(CASE WHEN len(dirs) > 3 THEN list_slice(dirs, -3, -1) ELSE dirs END, ' '))) AS fresh FROM y)"""


@query(f"WITH {CHUNKS_SQL}, {_LEX_SQL} SELECT id, sha256(fresh) AS fresh_hash, search_text IS NULL AS missing, coalesce(search_text <> fresh, true) OR start_line IS NULL OR end_line IS NULL AS needs_backfill FROM z WHERE chunk_text IS NOT NULL")
def chunk_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search text rebuilt from chunk and path, and which chunks need it (or their lines) filled in again."""
    chunks = current_chunks(table(spark, sf_dir, "indexed_chunks")).where("chunk_text is not null").withColumn("fresh", T.lexical_text(chunk_path("file_record_id"), F.col("chunk_text")))
    stale = F.coalesce(F.col("search_text") != F.col("fresh"), F.lit(True)) | F.col("start_line").isNull() | F.col("end_line").isNull()
    return chunks.select("id", F.sha2("fresh", 256).alias("fresh_hash"), F.col("search_text").isNull().alias("missing"), stale.alias("needs_backfill"))
