"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrecall.llm import conversations, credentials, encoding, handwritten, leaks, neighbors, personal, residue
from loomrecall.plans import catalog as core
from loomrecall.session import table
from loomrecall.sources.transcripts import BLANK_SQL, LINES_SQL

Query = Callable[[SparkSession, str], DataFrame]


def secret_key(spark: SparkSession) -> str:
    """The key of surrogates: ``spark.loomrecall.pii.key``, or a random one for this application, which nobody can look entities up with."""
    context = spark.sparkContext
    if not hasattr(context, "_loomrecall_key"):
        context._loomrecall_key = secrets.token_hex(32)
    return spark.conf.get("spark.loomrecall.pii.key", None) or context._loomrecall_key


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the surrogate operator replaced."""
    return personal.find_personal(table(spark, sf_dir, "memory_records"), table(spark, sf_dir, "session_turns"), secret_key(spark))


def p1_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact_personal(table(spark, sf_dir, "memory_records"), table(spark, sf_dir, "session_turns"), secret_key(spark), placeholders=True)


def p1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact_personal(table(spark, sf_dir, "memory_records"), table(spark, sf_dir, "session_turns"), secret_key(spark))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.similar_pairs(neighbors.similar_vectors(table(spark, sf_dir, "record_embeddings")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "file_records"), table(spark, sf_dir, "indexed_chunks"))


def p3_searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search results that lead to hand-written files."""
    return handwritten.handwritten_results(table(spark, sf_dir, "search_results"), table(spark, sf_dir, "file_records"), table(spark, sf_dir, "indexed_chunks")).select("result_id", "query_text", "project_key", "file_path", "chunk_index", "score")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(table(spark, sf_dir, "indexed_chunks"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redact_credentials(table(spark, sf_dir, "indexed_chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild_conversations(table(spark, sf_dir, "transcript_lines"), table(spark, sf_dir, "session_turns"))


def p5_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.channel_conversations(table(spark, sf_dir, "session_turns"))


def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.transcript_turns(table(spark, sf_dir, "transcript_lines"))


def transcript_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.transcript_tree(table(spark, sf_dir, "transcript_lines"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and sizes of the documents that stay after the leak removal."""
    docs = table(spark, sf_dir, "documents")
    return leaks.without_leaks(docs, leaks.find_leaks(docs, table(spark, sf_dir, "eval_items"))).select("doc_id", "lang", "source", F.length("text").alias("chars"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_placeholders, p1_surrogates, p2_found, p3_found, p3_searchable, p4_found, p4_redacted, p5_found, p5_channels, transcript_turns, transcript_tree, p6_ids, p7_found, p7_clean, p8_found)}
_SPOKEN_SQL = f"""{LINES_SQL}, ln AS (SELECT session_id, coalesce(event_id, chr(1) || coalesce(line_offset::VARCHAR, '') || coalesce(content, '')) AS event_id, line_offset AS pos, broken, parent, CASE WHEN role IN ('user', 'assistant') AND NOT {BLANK_SQL.format("body")} THEN role END AS speaker FROM lines_read WHERE session_id IS NOT NULL),
  said AS (SELECT session_id, event_id, min(pos) AS pos, min(speaker) AS speaker FROM ln WHERE speaker IS NOT NULL GROUP BY 1, 2),
  nx AS (SELECT *, row_number() OVER w - 1 AS msg_pos, lead(speaker) OVER w AS follows FROM said WINDOW w AS (PARTITION BY session_id ORDER BY pos NULLS FIRST, event_id)),
  bad AS (SELECT session_id FROM ln WHERE broken UNION SELECT session_id FROM said WHERE pos IS NULL UNION SELECT session_id FROM nx WHERE (msg_pos = 0 AND speaker <> 'user') OR (speaker = 'user' AND follows IS DISTINCT FROM 'assistant')
    UNION SELECT l.session_id FROM ln l WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ln e WHERE e.session_id = l.session_id AND e.event_id = l.parent)),
  tn AS (SELECT session_id, id AS event_id, min(turn_ts) AS pos, max({BLANK_SQL.format("user_text")} OR {BLANK_SQL.format("assistant_text")}) AS blank FROM session_turns WHERE session_id IS NOT NULL GROUP BY 1, 2),
  tk AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY pos NULLS FIRST, event_id) - 1 AS p FROM tn WHERE session_id NOT IN (SELECT session_id FROM tn WHERE blank))
  SELECT session_id, msg_pos, event_id, speaker FROM nx WHERE session_id NOT IN (SELECT session_id FROM bad) UNION ALL SELECT session_id, 2 * p, event_id, 'user' FROM tk UNION ALL SELECT session_id, 2 * p + 1, event_id, 'assistant' FROM tk"""
_WORDS = "list_filter(regexp_extract_all(lower(nfc_normalize(regexp_replace({}, '[\\p{{Cf}}\\x{{34f}}\\x{{115f}}\\x{{1160}}\\x{{17b4}}\\x{{17b5}}\\x{{180b}}-\\x{{180f}}\\x{{3164}}\\x{{fe00}}-\\x{{fe0f}}\\x{{ffa0}}]', '', 'g'))), '[\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_GRAMS = "SELECT DISTINCT {key}, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {key}, {words} AS w FROM {source} WHERE {column} IS NOT NULL))"
_LEAKS_SQL = f"dg AS ({_GRAMS.format(key='doc_id', words=_WORDS.format('text'), source='documents', column='text')}), ig AS ({_GRAMS.format(key='item_id', words=_WORDS.format('item_text'), source='eval_items', column='item_text')}), leaks AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))"
SQL: dict[str, str] = {
    "p5_found": f"WITH {_SPOKEN_SQL}",
    "p5_channels": f"""WITH r AS (SELECT id, any_value(session_id) AS session_id, any_value(turn_ts) AS ts, any_value(coalesce(agent, 'unknown') || '/' || coalesce(model, 'unknown')) AS channel, any_value(NOT {BLANK_SQL.format("user_text")} AND NOT {BLANK_SQL.format("assistant_text")}) AS replied FROM session_turns WHERE turn_ts IS NOT NULL GROUP BY id),
  ps AS (SELECT floor((epoch_us(lead(ts) OVER (PARTITION BY session_id ORDER BY ts)) - epoch_us(ts)) / 1000000) AS p FROM r WHERE session_id IS NOT NULL), gap AS (SELECT 3 * quantile_cont(p, 0.98) * 1000000 AS g FROM ps WHERE p IS NOT NULL),
  c AS (SELECT r.*, CASE WHEN epoch_us(lead(ts) OVER w) - epoch_us(ts) > coalesce(g, 1e300) THEN 1 ELSE 0 END AS cut, row_number() OVER w AS n FROM r, gap WINDOW w AS (PARTITION BY channel ORDER BY ts, id)),
  q AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY channel ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM c)
  SELECT channel, part, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_turns, count(DISTINCT session_id) AS n_sessions FROM q GROUP BY 1, 2 HAVING bool_or(replied)""",
    "p7_found": f"WITH {_LEAKS_SQL} SELECT doc_id, item_id FROM leaks",
    "p7_clean": f"WITH {_LEAKS_SQL} SELECT doc_id, lang, source, length(text) AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
    "transcript_turns": core.SQL["assembled_turns"],
    "transcript_tree": core.SQL["message_trees"],
}
