"""Conversations against hand-made sessions, and on edge cases."""

import json

from loomrecall.llm import conversations as V

LINES = "session_id string, event_id string, line_offset long, content string, captured_at timestamp_ntz, role string, pos int"
TURNS = "id string, session_id string, turn_ts timestamp_ntz, user_text string, assistant_text string, agent string, model string, speaker string"


def msg(role, text, **kw):
    return json.dumps({"message": {"role": role, "content": text}, **kw})


def lines(spark, rows):
    return spark.createDataFrame([(*r, None, "x", 1) for r in rows], LINES)


def test_transcripts(spark):
    part = json.dumps({"item": {"role": "Assistant", "content": [{"type": "thinking", "name": "x"}, {"type": "text", "text": "ok"}]}})
    rows = [
        ("s1", "h", 0, '{"type":"session","id":"h"}'), ("s1", "a", 9, msg("USER", "hi", parentId="h")), ("s1", "b", 5, part), ("s1", "a", 1, msg("USER", "hi", parentId="h")), ("s1", "b", 20, part), ("s1", "c", 30, "noise"), ("s1", "d", 31, None),
        ("s2", "a", 0, msg("assistant", "hi")), ("s2", "b", 1, msg("user", "x")), ("s3", "a", 0, msg("user", "hi")), ("s3", "b", 1, msg("user", "x")), ("s3", "c", 2, msg("assistant", "x")),
        ("s4", "a", 0, msg("user", "hi")), ("s4", "b", 1, msg("assistant", "x")), ("s4", "c", 2, '{"message": {"role": "user", "con'), ("s5", "a", 0, msg("user", "hi", parentId="gone")), ("s5", "b", 1, msg("assistant", "x")),
        ("s6", "a", 0, msg("user", "hi")), ("s6", "b", None, msg("assistant", "x")), ("s7", "a", 0, "User:  hello"), ("s7", "b", 1, "ASSISTANT: there"), ("s7", "c", 2, "user:   "), ("s8", "a", 0, msg("system", "x")), (None, "a", 0, msg("user", "x")),
        ("s9", "a", 0, json.dumps({"payload": {"message": {"role": "user", "content": "q"}, "parentId": None}})), ("s9", "b", 1, json.dumps({"payload": {"role": "assistant", "content": "a"}})), ("s9", "c", 2, json.dumps({"role": "assistant", "content": "more"})),
    ]
    got = sorted(tuple(r) for r in V.transcript_conversations(lines(spark, rows)).collect())
    assert got == [("s1", 0, "a", "user"), ("s1", 1, "b", "assistant"), ("s7", 0, "a", "user"), ("s7", 1, "b", "assistant"), ("s9", 0, "a", "user"), ("s9", 1, "b", "assistant"), ("s9", 2, "c", "assistant")]
    assert V.transcript_conversations(lines(spark, [("z", "a", 0, "noise")]).limit(0)).count() == 0


def test_turns(spark, ts):
    rows = [("t2", "x", ts(5), "q2", "a2"), ("t1", "x", ts(1), "q1", "a1"), ("t1", "x", ts(1), "q1", "a1"), ("t3", "y", ts(1), "q", " \t"), ("t4", "y", ts(2), "q", "a"), ("t5", "z", None, "q" * 300_000, "a"), ("t6", None, ts(1), "q", "a"), ("t7", "w", ts(1), None, "a")]
    df = spark.createDataFrame([(*r, None, None, "clash") for r in rows], TURNS)
    got = sorted(tuple(r) for r in V.turn_conversations(df).collect())
    assert got == [("x", 0, "t1", "user"), ("x", 1, "t1", "assistant"), ("x", 2, "t2", "user"), ("x", 3, "t2", "assistant"), ("z", 0, "t5", "user"), ("z", 1, "t5", "assistant")]


def test_gap_split(spark, ts):
    rows = [("c", ts(m), f"i{m:04d}") for m in [0, 1, 2, 100, 101, 400]] + [("d", ts(0), "k"), (None, ts(0), "n"), ("c", None, "m")]
    df = spark.createDataFrame(rows, "ch string, t timestamp_ntz, i string")
    got = {r.i: r.part for r in V.sessionize(df, ["ch"], ["t", "i"], "gaps", "t", 600.0).collect()}
    assert got == {"i0000": 0, "i0001": 0, "i0002": 0, "i0100": 1, "i0101": 1, "i0400": 2, "k": 0}
    assert V.calibrated_gap(df.limit(0), "ch", "t") == float("inf")
    assert V.calibrated_gap(df, "ch", "t", 0.5, 2.0) == 120.0
