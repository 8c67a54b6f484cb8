"""Session capture as a stateful stream: pending turns per session, written at a threshold, for a large turn, or after silence."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomrecall.functions import constants as C
from loomrecall.streaming.events import timed

OUT = "session_id string, reason string, turns int, first_id string, last_id string, chars long"
STATE = "ids array<string>, chars long, seen long, large boolean"


def flush_stream(turns: DataFrame, ts: str = "turn_ts", delay: str = "10 minutes", idle_s: int = 1800, flush_turns: int = C.FLUSH_TURNS, large_chars: int = C.LARGE_TURN_CHARS) -> DataFrame:
    """One row per flush of pending turns (session_id, id, turn_ts, user_text, assistant_text).

    The state of a session holds at most the ids of the turns below the threshold. Silence is measured in event time: the timer fires
    when the watermark passes the last turn by ``idle_s`` seconds. Turns without session or time are left out; repeated ids should be
    removed before by ``first_deliveries``.
    """

    def advance(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, chars, seen, large = state.get if state.exists else ([], 0, 0, False)
        ids = list(ids)
        out: list[tuple] = []

        def flush(reason: str) -> None:
            nonlocal ids, chars, large
            out.append((key[0], reason, len(ids), ids[0], ids[-1], int(chars)))
            ids, chars, large = [], 0, False

        if state.hasTimedOut:
            if ids:
                flush("idle")
            state.remove()
        else:
            for pdf in batches:
                for row in pdf.sort_values([ts, "id"]).itertuples():
                    size = len(row.user_text or "") + len(row.assistant_text or "")
                    ids.append(row.id)
                    chars += size
                    large = large or size >= large_chars
                    seen = max(seen, int(getattr(row, ts).timestamp() * 1000))
                    if len(ids) >= flush_turns:
                        flush("threshold")
                    elif large:
                        flush("large-turn")
            state.update((ids, chars, seen, large))
            state.setTimeoutTimestamp(max(seen + idle_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "reason", "turns", "first_id", "last_id", "chars"])

    usable = timed(turns.where("session_id is not null and turn_ts is not null and id is not null"), ts, delay)
    return usable.groupBy("session_id").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
