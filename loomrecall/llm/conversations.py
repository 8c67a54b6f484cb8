"""Ordered conversations from message rows.

Rows are sessionized by channel, sorted, split at calibrated inactivity gaps where the channel carries no session of its own, given
speaker roles, and sessions without reciprocal replies are dropped. Positions come from ``split_ordered``, so one channel may hold
a third of all rows without ending up in one task.

Defined cases: rows without a channel are ignored; exact copies and replays count once; an empty table gives an empty table; other
columns of the input are never looked at; ties in the order are broken by event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrecall.operators.ordered import POS, split_ordered
from loomrecall.operators.sessions import assembled_turns, message_tree
from loomrecall.session import materialize
from loomrecall.sources.transcripts import is_blank, line_messages, parse_line

def calibrated_gap(rows: DataFrame, channel: str, ts: str, share: float = 0.98, factor: float = 3.0) -> float:
    """Seconds of silence that end a conversation: ``factor`` times the ``share`` quantile of the pauses between neighbouring rows of a channel.

    Read over all rows, exactly: pauses are counted by length before they are ordered. Without any pause the gap is infinite.
    """
    usable = rows.where(F.col(channel).isNotNull() & F.col(ts).isNotNull()).select(channel, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).withColumn("_i", F.monotonically_increasing_id())
    pauses = split_ordered(usable, [channel], ["_t", "_i"], "pauses", around={"_after": "_t"}).select((F.col("_after") - F.col("_t")).alias("p")).where("p is not null")
    counts = pauses.groupBy((F.floor(F.col("p") / 1_000_000) * 1_000_000).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    got = counts.agg(F.percentile("p", share, F.col("n")).alias("q")).first()["q"]
    return float("inf") if got is None else factor * got / 1e6


def sessionize(rows: DataFrame, channel: list[str], order: list[str], label: str, ts: str | None = None, gap_s: float = float("inf"), around: dict[str, str] | None = None) -> DataFrame:
    """Order the rows of each channel and split them at silences: adds ``pos`` within the channel, ``part`` (grows by one after a silence of more than ``gap_s`` seconds), and ``around`` as in ``split_ordered``.

    A channel that is a session of its own has no such silence: without ``ts``, or with an infinite gap, it is one part. The channel may be
    hot: slices of it are numbered apart and joined by their sums. Where silences count, rows without channel or time are left out.
    """
    around = around or {}
    if ts is None or gap_s == float("inf"):
        return split_ordered(rows, channel, order, label, around=around).withColumn("part", F.lit(0).cast("long"))
    rows = rows.where(" and ".join(f"`{c}` is not null" for c in (*channel, ts)))
    placed = split_ordered(rows, channel, order, label, around={**around, "_next_ts": ts})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # A row that ends a part adds to the number of all later ones: per block of positions first, then within the block.
    marked = placed.withColumn("_cut", F.coalesce((micros("_next_ts") - micros(ts)) > F.lit(gap_s * 1e6), F.lit(False)).cast("long")).withColumn("_block", F.floor(F.col(POS) / F.lit(4096)))
    per = marked.groupBy(*channel, "_block").agg(F.sum("_cut").alias("_cuts"))
    before = per.withColumn("_base", F.coalesce(F.sum("_cuts").over(Window.partitionBy(*channel).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_cuts")
    inside = Window.partitionBy(*channel, "_block").orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    numbered = marked.withColumn("_in", F.coalesce(F.sum("_cut").over(inside), F.lit(0))).join(before, [*channel, "_block"])
    return numbered.withColumn("part", F.col("_base") + F.col("_in")).drop("_block", "_cut", "_in", "_base", "_next_ts")


def reciprocal_sessions(messages: DataFrame, label: str) -> DataFrame:
    """Positions for messages (session_id, event_id, speaker, at), and only the sessions whose first message is the user's and where each user message is directly followed by an assistant's."""
    placed = sessionize(messages, ["session_id"], ["at", "event_id"], label, around={"_next": "speaker"})
    wrong = ((F.col(POS) == 0) & (F.col("speaker") != "user")) | ((F.col("speaker") == "user") & ~F.coalesce(F.col("_next") == "assistant", F.lit(False)))
    bad = placed.where(wrong).select("session_id").distinct()
    return placed.join(bad, "session_id", "left_anti").select("session_id", F.col(POS).cast("long").alias("msg_pos"), "event_id", "speaker")


def transcript_turns(lines: DataFrame) -> DataFrame:
    """Turns of all messages by offset; messages without offset have no place and are left out."""
    said = line_messages(lines).where("at is not null and speaker <> 'other'")
    return assembled_turns(materialize(said.select("session_id", "event_id", "at", "speaker"), "transcript-messages"), "transcript-turns")


def transcript_tree(lines: DataFrame) -> DataFrame:
    """Turns of all messages by parent link; lines that are no message only pass the link on."""
    return message_tree(line_messages(lines), "transcript-tree")


def transcript_conversations(lines: DataFrame) -> DataFrame:
    """Conversations of transcript lines (session_id, event_id, line_offset, content).

    Rows of one (session_id, event_id) are one line at its smallest offset. Dropped: sessions with a cut-off JSON line, with a message
    without offset, with a parent that the session does not hold, or failing the reply rule. Null event ids never merge with each other.
    """
    cols = parse_line(F.col("content"))
    rows = lines.where(F.col("session_id").isNotNull()).select(
        "session_id", F.coalesce("event_id", F.concat(F.lit("\0"), F.coalesce(F.col("line_offset").cast("string"), F.lit("")), F.coalesce("content", F.lit("")))).alias("event_id"), F.col("line_offset").alias("at"), *[c.alias(k) for k, c in cols.items()]
    )
    speaks = F.col("role").isin("user", "assistant") & ~is_blank(F.col("body"))
    parsed = materialize(rows.select("session_id", "event_id", "at", "broken", "parent", F.when(speaks, F.col("role")).alias("speaker")), "transcript")
    lost = parsed.where(F.col("parent").isNotNull()).select("session_id", F.col("parent").alias("event_id")).distinct().join(parsed.select("session_id", "event_id").distinct(), ["session_id", "event_id"], "left_anti").select("session_id")
    messages = parsed.where(F.col("speaker").isNotNull()).groupBy("session_id", "event_id").agg(F.min("at").alias("at"), F.min("speaker").alias("speaker"))
    bad = parsed.where("broken").select("session_id").unionByName(lost).unionByName(messages.where("at is null").select("session_id")).distinct()
    return reciprocal_sessions(messages.join(bad, "session_id", "left_anti"), "transcript-order")


def turn_conversations(turns: DataFrame) -> DataFrame:
    """Conversations of session turns (id, session_id, turn_ts, user_text, assistant_text): each turn id is a user and an assistant message.

    Sessions with a null or blank side are dropped. Turns without time come first.
    """
    rows = turns.where(F.col("session_id").isNotNull()).select("session_id", F.col("id").alias("event_id"), F.col("turn_ts").alias("at"), (is_blank(F.col("user_text")) | is_blank(F.col("assistant_text"))).alias("blank"))
    once = rows.groupBy("session_id", "event_id").agg(F.min("at").alias("at"), F.max("blank").alias("blank"))
    bad = once.where("blank").select("session_id").distinct()
    placed = sessionize(once.join(bad, "session_id", "left_anti").drop("blank"), ["session_id"], ["at", "event_id"], "turns")
    both = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("user").alias("speaker")), F.struct(F.lit(1).alias("o"), F.lit("assistant").alias("speaker"))))
    return placed.select("session_id", "event_id", POS, both.alias("m")).select("session_id", (F.col(POS) * 2 + F.col("m.o")).cast("long").alias("msg_pos"), "event_id", F.col("m.speaker").alias("speaker"))


def rebuild_conversations(lines: DataFrame, turns: DataFrame) -> DataFrame:
    """Every kept conversation of both tables: session_id, msg_pos, event_id, speaker."""
    return transcript_conversations(lines).unionByName(turn_conversations(turns))


def channel_conversations(turns: DataFrame) -> DataFrame:
    """Conversations where no session is given: turns of one channel (agent and model) are split at the calibrated gap.

    Columns: channel, part, first_ts, last_ts, n_turns, n_sessions; only parts with a reply of the assistant to some user text stay.
    """
    channel = F.concat_ws("/", F.coalesce("agent", F.lit("unknown")), F.coalesce("model", F.lit("unknown")))
    rows = turns.where(F.col("turn_ts").isNotNull()).select(channel.alias("channel"), "id", "session_id", "turn_ts", (~is_blank(F.col("user_text")) & ~is_blank(F.col("assistant_text"))).alias("replied")).dropDuplicates(["id"])
    gap = calibrated_gap(rows.where(F.col("session_id").isNotNull()), "session_id", "turn_ts")
    parts = sessionize(rows, ["channel"], ["turn_ts", "id"], "channels", "turn_ts", gap)
    return (
        parts.groupBy("channel", "part")
        .agg(F.min("turn_ts").alias("first_ts"), F.max("turn_ts").alias("last_ts"), F.count(F.lit(1)).alias("n_turns"), F.count_distinct("session_id").alias("n_sessions"), F.max("replied").alias("replied"))
        .where("replied")
        .drop("replied")
    )
