"""Transcript lines: pipe-separated events, message files, and the messages inside lines of JSON or plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pipe_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``session|event|offset|content`` with further bars in the content; lines of another form have a null session and stay in ``raw``."""
    parts = F.split(column, r"\|", 4)
    good = (F.size(parts) == 4) & F.get(parts, 2).try_cast("long").isNotNull() & (F.trim(F.get(parts, 0)) != "")
    pick = lambda i: F.when(good, F.trim(F.get(parts, i)))
    return lines.select(pick(0).alias("session_id"), pick(1).alias("event_id"), pick(2).try_cast("long").alias("line_offset"), F.when(good, F.get(parts, 3)).alias("content"), F.col(column).alias("raw"))


def read_pipe(spark: SparkSession, path: str) -> DataFrame:
    return pipe_lines(spark.read.text(path))


def stream_pipe(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: the checkpoint owns the offsets, so a half-written line is read when it is whole."""
    return pipe_lines(spark.readStream.text(path))


#: White space of any kind, with the blanks that Java's \s leaves out.
BLANK = r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{180e}]*$"


def is_blank(c: Column) -> Column:
    """True for null and for texts of white space only."""
    return c.isNull() | c.rlike(BLANK)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def parse_line(content: Column) -> dict[str, Column]:
    """Columns of one transcript line: ``broken``, ``role`` (lower case or null), ``body`` and ``parent`` (null if there is none)."""
    raw = F.ltrim(content)
    is_json = raw.startswith("{")
    doc = F.when(is_json, F.try_parse_json(raw))
    message, item = _get(doc, "$.message", "variant"), _get(doc, "$.item", "variant")
    payload = _get(doc, "$.payload", "variant")
    inner = _get(doc, "$.payload.message", "variant")

    def has_object(v: Column) -> Column:
        return _kind(v).startswith("OBJECT")

    def has_role(v: Column) -> Column:
        return has_object(v) & (_kind(_get(v, "$.role", "variant")) == "STRING")

    said = (
        F.when(has_object(message), message).when(has_role(item), item).when(has_object(inner), inner).when(has_role(payload), payload).when(has_role(doc), doc)
    )
    role_kind = _kind(_get(said, "$.role", "variant"))
    body = _get(said, "$.content", "variant")
    parts = F.filter(_get(said, "$.content", "array<variant>"), lambda x: (_get(x, "$.type", "string") == "text") & _get(x, "$.text", "string").isNotNull())
    text = F.when(_kind(body) == "STRING", _get(said, "$.content", "string")).when(
        _kind(body).startswith("ARRAY"), F.array_join(F.transform(parts, lambda x: _get(x, "$.text", "string")), " ")
    )
    plain = r"(?is)^\s*(user|assistant)\s*:(.*)$"
    parent = F.coalesce(_get(said, "$.parentId", "string"), _get(payload, "$.parentId", "string"), _get(doc, "$.parentId", "string"))
    role = F.when(is_json, F.when(role_kind == "STRING", F.lower(F.trim(_get(said, "$.role", "string"))))).otherwise(F.lower(F.nullif(F.regexp_extract(content, plain, 1), F.lit(""))))
    return {
        "broken": is_json & doc.isNull(),
        "role": role,
        "body": F.when(is_json, text).otherwise(F.regexp_extract(content, plain, 2)),
        "parent": parent,
    }


def line_messages(lines: DataFrame) -> DataFrame:
    """Every transcript line, plain or JSON, once per (session_id, event_id): its parent_id, smallest offset ``at`` and speaker (``other`` if it is no user's or assistant's message)."""
    cols = parse_line(F.col("content"))
    rows = lines.where("session_id is not null and event_id is not null").select("session_id", "event_id", "line_offset", *[c.alias(k) for k, c in cols.items()])
    speaker = F.when(F.col("role").isin("user", "assistant") & ~is_blank(F.col("body")), F.col("role"))
    return rows.groupBy("session_id", "event_id").agg(F.min("parent").alias("parent_id"), F.min("line_offset").alias("at"), F.coalesce(F.min(speaker), F.lit("other")).alias("speaker"))


_TYPE = "json_type(json_extract({}, '{}'))"
_SAID = "CASE " + " ".join(f"WHEN {_TYPE.format('d', p)} = 'OBJECT'" + (f" AND {_TYPE.format('d', p + '.role')} = 'VARCHAR'" if needs else "") + f" THEN json_extract(d, '{p}')" for p, needs in (("$.message", False), ("$.item", True), ("$.payload.message", False), ("$.payload", True), ("$", True))) + " END"
#: The same in SQL: ``lines_read`` with role, body and parent of each row of ``transcript_lines``.
LINES_SQL = f"""raw_lines AS (SELECT session_id, event_id, line_offset, content, starts_with(ltrim(content), '{{{{') AS is_json, CASE WHEN starts_with(ltrim(content), '{{{{') AND json_valid(content) THEN content::JSON END AS d FROM transcript_lines),
  said_lines AS (SELECT *, {_SAID} AS m FROM raw_lines),
  lines_read AS (SELECT session_id, event_id, line_offset, content, is_json AND d IS NULL AS broken,
    CASE WHEN is_json THEN CASE WHEN json_type(json_extract(m, '$.role')) = 'VARCHAR' THEN lower(trim(json_extract_string(m, '$.role'))) END ELSE lower(nullif(regexp_extract(content, '(?is)^\\s*(user|assistant)\\s*:', 1), '')) END AS role,
    CASE WHEN NOT is_json THEN regexp_extract(content, '(?is)^\\s*(?:user|assistant)\\s*:(.*)$', 1) WHEN json_type(json_extract(m, '$.content')) = 'VARCHAR' THEN json_extract_string(m, '$.content')
      WHEN json_type(json_extract(m, '$.content')) = 'ARRAY' THEN array_to_string(list_transform(list_filter(json_extract(m, '$.content[*]'), lambda x: json_extract_string(x, '$.type') = 'text' AND json_extract_string(x, '$.text') IS NOT NULL), lambda x: json_extract_string(x, '$.text')), ' ') END AS body,
    CASE WHEN is_json THEN coalesce(json_extract_string(m, '$.parentId'), json_extract_string(d, '$.payload.parentId'), json_extract_string(d, '$.parentId')) END AS parent FROM said_lines)""".replace("{{", "{")
BLANK_SQL = "NOT regexp_matches(coalesce({}, ''), '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{180e}}\\x{{0b}}]')"
