"""Queries on session capture, queues, polling and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrecall.functions import constants as C
from loomrecall.operators import sessions as S
from loomrecall.plans.registry import query
from loomrecall.session import materialize, table
from loomrecall.sources.transcripts import BLANK_SQL, LINES_SQL, line_messages

_TURNS_SQL = "turns AS (SELECT DISTINCT session_id, id, turn_ts, user_text, assistant_text FROM session_turns WHERE session_id IS NOT NULL AND NOT regexp_matches(user_text, '^[\\s\\p{Z}]*$') AND NOT regexp_matches(assistant_text, '^[\\s\\p{Z}]*$'))"


@query(
    f"""WITH {_TURNS_SQL}, g AS (SELECT session_id, count(*) AS pending, bool_or(length(user_text) + length(assistant_text) >= 1200) AS lg, max(turn_ts) AS last_ts FROM turns GROUP BY 1), m AS (SELECT max(turn_ts) AS top FROM turns), al AS (SELECT DISTINCT session_id FROM session_turns WHERE session_id IS NOT NULL)
  SELECT al.session_id, coalesce(pending, 0) AS pending, CASE WHEN coalesce(pending, 0) = 0 THEN 'no-pending-turns' WHEN last_ts < top - INTERVAL 30 DAY THEN 'idle' WHEN pending >= 3 THEN 'threshold' WHEN lg THEN 'large-turn' ELSE 'waiting' END AS reason FROM al LEFT JOIN g USING (session_id), m"""
)
def flush_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each session's pending turns would be written (with a large-turn size that these tables reach)."""
    turns = table(spark, sf_dir, "session_turns")
    done = S.complete_turns(turns)
    per = done.groupBy("session_id").agg(F.count(F.lit(1)).alias("pending"), F.max(F.length("user_text") + F.length("assistant_text") >= 1200).alias("large"), F.max("turn_ts").alias("last_ts"))
    top = done.agg(F.max("turn_ts").alias("top"))
    every = turns.where("session_id is not null").select("session_id").distinct().join(per, "session_id", "left").join(F.broadcast(top))
    n = F.coalesce("pending", F.lit(0))
    idle = F.col("last_ts") < F.col("top") - F.expr("INTERVAL 30 DAYS")
    return every.select("session_id", n.alias("pending"), F.coalesce(S.flush_reason(n, F.col("large"), idle), F.lit("waiting")).alias("reason"))


_TRACE = "[\"'']?(tool_call|tool_result|toolCall|toolResult)[\"'']?\\s*:\\s*"


@query(
    f"""WITH {_TURNS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_ts NULLS FIRST, id) - 1 AS pos FROM turns), b AS (SELECT session_id, pos // {C.FLUSH_TURNS} AS batch, pos, id, '- ' || (pos % {C.FLUSH_TURNS} + 1) || '. ' || user_text || ' => ' || assistant_text AS b FROM n),
  g AS (SELECT session_id, batch, count(*) AS turns, string_agg(b, chr(10) ORDER BY pos) AS t, string_agg(id, '|' ORDER BY pos) AS ids FROM b GROUP BY 1, 2),
  c AS (SELECT *, array_to_string(list_transform(string_split_regex(t, '\\r?\\n'), lambda x: CASE WHEN regexp_matches(x, '{_TRACE}') THEN ltrim(rtrim(regexp_replace(x, '{_TRACE}.*$', '')) || ' [REDACTED TOOL TRACE]') ELSE x END), chr(10)) AS clean FROM g)
  SELECT session_id, batch::BIGINT AS batch, turns, left(sha256(session_id || ':' || batch || ':' || ids), 12) AS rollup_key, md5(left(clean, {C.ROLLUP_MAX_CHARS})) AS text_hash FROM c"""
)
def session_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rollups(table(spark, sf_dir, "session_turns")).select("session_id", "batch", "turns", "rollup_key", F.md5("rollup_text").alias("text_hash"))


@query("WITH e AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) SELECT event_id, min(ts) AS ts, min(user_id) AS user_id, count(*) AS deliveries FROM e GROUP BY event_id")
def queue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with replays, each once."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return S.first_deliveries(e.unionByName(e.where("event_id % 3 = 0")), "event_id", ["ts", "user_id"])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS queued, count(*) FILTER (WHERE event_type = 'purchase') AS flushed, count(*) FILTER (WHERE event_type = 'error') AS failed, count(DISTINCT user_id) AS sessions FROM events")
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("total"), n("click").alias("queued"), n("purchase").alias("flushed"), n("error").alias("failed"), F.count_distinct("user_id").alias("sessions"))


@query("SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query(
    """WITH o AS (SELECT user_id, event_type = 'view' AS quiet, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY ts, event_id) AS q FROM events),
  r AS (SELECT user_id, p - q AS run, count(*) AS n FROM o WHERE quiet GROUP BY 1, 2) SELECT user_id, max(n) AS longest_idle_run, count(*) AS idle_runs, max(n) >= 3 AS disabled FROM r GROUP BY user_id"""
)
def polling_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive polls without change per source; three in a row disable it."""
    runs = S.idle_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "view", "polling")
    return runs.groupBy("user_id").agg(F.max("n").alias("longest_idle_run"), F.count(F.lit(1)).alias("idle_runs"), (F.max("n") >= 3).alias("disabled"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS st FROM events), s AS (SELECT user_id, ts, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
  SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 6 HOUR AS end_ts, count(*) AS n FROM s GROUP BY user_id, k"""
)
def debounce_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.debounced(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "6 hours").select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type (an extension: windows for running the flush and polling policies at scale)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start, user_id FROM events) SELECT window_start, count(*) AS n, count(DISTINCT user_id) AS users FROM w GROUP BY 1")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "users")


@query(
    f"""WITH {LINES_SQL}, t AS (SELECT session_id, event_id, min(line_offset) AS pos, min(CASE WHEN role IN ('user', 'assistant') AND NOT {BLANK_SQL.format('body')} THEN role END) AS speaker FROM lines_read WHERE session_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2),
  o AS (SELECT *, sum(CASE WHEN speaker = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) - 1 AS turn FROM t WHERE pos IS NOT NULL AND speaker IS NOT NULL)
  SELECT session_id, turn::BIGINT AS turn, min(event_id) FILTER (WHERE speaker = 'user') AS user_event, (count(*) - 1)::BIGINT AS replies FROM o WHERE turn >= 0 GROUP BY 1, 2"""
)
def assembled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns from all transcript lines, plain and JSON: each user message with the number of replies up to the next one."""
    said = line_messages(table(spark, sf_dir, "transcript_lines")).where("at is not null and speaker <> 'other'")
    return S.assembled_turns(materialize(said.select("session_id", "event_id", "at", "speaker"), "turn-messages"))


@query(
    f"""WITH {LINES_SQL}, t AS (SELECT session_id, event_id, min(line_offset) AS line_offset, min(parent) AS parent_id, coalesce(min(CASE WHEN role IN ('user', 'assistant') AND NOT {BLANK_SQL.format('body')} THEN role END), 'other') AS speaker FROM lines_read WHERE session_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2)
  SELECT session_id, event_id, line_offset AS "at", parent_id, speaker FROM t"""
)
def transcript_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of every transcript with its speaker, place and parent."""
    return line_messages(table(spark, sf_dir, "transcript_lines")).select("session_id", "event_id", "at", "parent_id", "speaker")


@query(
    f"""WITH RECURSIVE {LINES_SQL}, t AS (SELECT session_id, event_id, min(parent) AS parent_id, coalesce(min(CASE WHEN role IN ('user', 'assistant') AND NOT {BLANK_SQL.format('body')} THEN role END), 'other') AS speaker FROM lines_read WHERE session_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2),
  up AS (SELECT session_id, event_id, event_id AS start, parent_id, 0 AS n FROM t WHERE speaker = 'assistant' UNION SELECT p.session_id, p.event_id, up.start, p.parent_id, up.n + 1 FROM up JOIN t p ON p.session_id = up.session_id AND p.event_id = up.parent_id WHERE p.speaker <> 'user' AND up.n < 100),
  top AS (SELECT up.session_id, up.start, p.event_id AS user_event FROM up JOIN t p ON p.session_id = up.session_id AND p.event_id = up.parent_id WHERE p.speaker = 'user')
  SELECT t.session_id, t.event_id AS user_event, count(top.start) AS replies FROM t LEFT JOIN top ON top.session_id = t.session_id AND top.user_event = t.event_id WHERE t.speaker = 'user' GROUP BY 1, 2"""
)
def message_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns from the parent links of all transcript lines."""
    return S.message_tree(line_messages(table(spark, sf_dir, "transcript_lines")), "message-trees")


@query(
    """SELECT user_id, CASE arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('signup', 'error')) WHEN 'signup' THEN 'enabled' WHEN 'error' THEN 'disabled' ELSE 'seen' END AS state, count(*) FILTER (WHERE event_type = 'error') AS failures, max(ts) FILTER (WHERE event_type <> 'error') AS last_success, max(ts) AS last_seen FROM events GROUP BY 1"""
)
def registry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's state per source: the last transition decides, by a mergeable maximum instead of a fold over ordered rows."""
    e = table(spark, sf_dir, "events")
    turn = F.col("event_type").isin("signup", "error")
    last = F.max_by(F.when(turn, F.col("event_type")), F.when(turn, F.struct("ts", "event_id")))
    state = F.when(last == "signup", "enabled").when(last == "error", "disabled").otherwise("seen")
    return e.groupBy("user_id").agg(state.alias("state"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_success"), F.max("ts").alias("last_seen"))


@query("WITH m AS (SELECT max(last_seen_at) AS top FROM file_search_projects) SELECT project_key, CASE WHEN state = 'disabled' THEN 'idle' WHEN last_seen_at IS NULL THEN 'never' WHEN last_seen_at < top - INTERVAL 180 DAY THEN 'abandoned' ELSE 'running' END AS scan_state, coalesce(poll_seconds, 60)::BIGINT AS poll_seconds FROM file_search_projects, m")
def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans by the age of their last sign of life against the newest one."""
    p = table(spark, sf_dir, "file_search_projects")
    top = p.agg(F.max("last_seen_at").alias("top"))
    state = F.when(F.col("state") == "disabled", "idle").when(F.col("last_seen_at").isNull(), "never").when(F.col("last_seen_at") < F.col("top") - F.expr("INTERVAL 180 DAYS"), "abandoned").otherwise("running")
    return p.join(F.broadcast(top)).select("project_key", state.alias("scan_state"), F.coalesce("poll_seconds", F.lit(60)).cast("long").alias("poll_seconds"))
