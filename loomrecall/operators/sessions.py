"""Session capture, queues and polling as batch operators; their streaming twins are in ``loomrecall.streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrecall.functions import constants as C
from loomrecall.functions import text as T
from loomrecall.operators.ordered import split_ordered


def complete_turns(turns: DataFrame) -> DataFrame:
    """One row per turn id with both sides said: session_id, id, turn_ts, user_text, assistant_text."""
    said = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(r"^[\s\p{Z}]*$")
    rows = turns.where(F.col("session_id").isNotNull() & said("user_text") & said("assistant_text"))
    return rows.select("session_id", "id", "turn_ts", "user_text", "assistant_text").dropDuplicates(["id"])


def flush_reason(n: Column, large: Column, idle: Column, final: Column | None = None) -> Column:
    """Why pending turns are written, in order of priority; null while they wait."""
    out = F.when(n == 0, "no-pending-turns")
    if final is not None:
        out = out.when(final, "final")
    return out.when(idle, "idle").when(n >= C.FLUSH_TURNS, "threshold").when(large, "large-turn")


def rollups(turns: DataFrame, label: str = "rollups") -> DataFrame:
    """Turns of a session written in batches of the flush threshold: batch, turns, key and the bulleted text.

    Positions come from ``split_ordered`` and a batch has at most three turns, so a session of any length is never collected.
    """
    done = complete_turns(turns)
    placed = split_ordered(done, ["session_id"], ["turn_ts", "id"], label)
    batch = F.floor(F.col("pos") / C.FLUSH_TURNS).cast("long")
    bullet = F.concat(F.lit("- "), (F.col("pos") % C.FLUSH_TURNS + 1).cast("string"), F.lit(". "), F.col("user_text"), F.lit(" => "), F.col("assistant_text"))
    grouped = placed.select("session_id", batch.alias("batch"), "pos", "id", bullet.alias("b")).groupBy("session_id", "batch").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("pos", "id", "b"))).alias("xs"))
    text = F.substring(T.strip_tool_traces(F.array_join(F.transform("xs", lambda x: x["b"]), "\n")), 1, C.ROLLUP_MAX_CHARS)
    ids = F.array_join(F.transform("xs", lambda x: x["id"]), "|")
    key = F.substring(F.sha2(F.concat_ws(":", "session_id", F.col("batch").cast("string"), ids), 256), 1, 12)
    return grouped.select("session_id", "batch", "turns", key.alias("rollup_key"), text.alias("rollup_text"))


def idle_runs(events: DataFrame, key: str, order: list[str], quiet: Column, label: str) -> DataFrame:
    """Runs of consecutive quiet events per key: key, run, n (longest runs disable polling).

    The difference between an event's position among all events of its key and among the quiet ones is the same along a run. Both
    positions are skew-proof, and the runs are counted by a mergeable aggregate.
    """
    rows = events.select(key, *order, F.coalesce(quiet, F.lit(False)).alias("_quiet"))
    everything = split_ordered(rows, [key], order, f"{label}-all").where("_quiet").withColumnRenamed("pos", "_p")
    only = split_ordered(rows.where("_quiet"), [key], order, f"{label}-quiet").withColumnRenamed("pos", "_q").drop("_quiet")
    both = everything.join(only, [key, *order])
    return both.groupBy(key, (F.col("_p") - F.col("_q")).alias("run")).agg(F.count(F.lit(1)).alias("n"))


def assembled_turns(messages: DataFrame, label: str = "turns-from-messages") -> DataFrame:
    """User messages with the assistant messages that follow them up to the next user message.

    Input: session_id, event_id, speaker, at. Output per turn: session_id, turn, user_event, replies. The running number of the user
    messages is the difference of two skew-proof positions.
    """
    placed = split_ordered(messages, ["session_id"], ["at", "event_id"], f"{label}-all").withColumnRenamed("pos", "_p")
    users = split_ordered(messages.where("speaker = 'user'"), ["session_id"], ["at", "event_id"], f"{label}-users").select("session_id", "event_id", F.col("pos").alias("turn"))
    at = placed.join(users, ["session_id", "event_id"]).select("session_id", "turn", F.col("_p").alias("begins"), F.col("event_id").alias("user_event"))
    nxt = at.select("session_id", (F.col("turn") - 1).alias("turn"), F.col("begins").alias("ends"))
    size = placed.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    out = at.join(nxt, ["session_id", "turn"], "left").join(size, "session_id")
    return out.select("session_id", F.col("turn").cast("long").alias("turn"), "user_event", (F.coalesce("ends", "_n") - F.col("begins") - 1).cast("long").alias("replies"))


def debounced(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Bursts per key with pauses of less than ``gap``: key, start, end, n."""
    w = F.session_window(F.col(ts), gap)
    return events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def first_deliveries(events: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """Each event once: its first delivery and the number of deliveries."""
    return events.groupBy(ident).agg(F.min(F.struct(*order)).alias("f"), F.count(F.lit(1)).alias("deliveries")).select(ident, "f.*", "deliveries")


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def message_tree(messages: DataFrame, label: str = "tree", max_rounds: int = 40) -> DataFrame:
    """Turns from parent links: each user message with the number of assistant messages below it, up to the next user messages.

    Input: session_id, event_id, parent_id, speaker. Every message that is no user's points to its parent; each round doubles the
    pointers (an equi-join on session and event), so the number of rounds grows with the logarithm of the longest chain. Messages that
    hang below no user message, or in a circle, count nowhere.
    """
    from loomrecall.session import materialize

    rows = materialize(messages.where("session_id is not null and event_id is not null").dropDuplicates(["session_id", "event_id"]), f"{label}-messages")
    hop = materialize(rows.where("speaker <> 'user'").select("session_id", "event_id", F.col("parent_id").alias("up")), f"{label}-hops")
    state = None
    for _ in range(max_rounds):
        nxt = hop.select("session_id", F.col("event_id").alias("up"), F.col("up").alias("_next"))
        hop = materialize(hop.join(nxt, ["session_id", "up"], "left").select("session_id", "event_id", F.coalesce("_next", "up").alias("up")), f"{label}-hops")
        now = hop.agg(F.sum(F.xxhash64("session_id", "event_id", "up").cast("decimal(38,0)"))).first()[0]
        if now == state:
            break
        state = now
    users = rows.where("speaker = 'user'").select("session_id", F.col("event_id").alias("user_event"))
    replies = hop.join(rows.where("speaker = 'assistant'").select("session_id", "event_id"), ["session_id", "event_id"]).groupBy("session_id", F.col("up").alias("user_event")).agg(F.count(F.lit(1)).alias("replies"))
    return users.join(replies, ["session_id", "user_event"], "left").select("session_id", "user_event", F.coalesce("replies", F.lit(0)).alias("replies"))
