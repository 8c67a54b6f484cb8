"""Turns of plain and JSON lines, by offset and by parent link, against brute force."""

import pyarrow.parquet as pq

from loomrecall.llm import queries


def test_turns_of_all_lines(spark, tables):
    lines = spark.read.parquet(f"{tables}/transcript_lines.parquet")
    messages = [r.asDict() for r in queries.conversations.line_messages(lines).collect()]
    offsets = {}
    for r in pq.read_table(f"{tables}/transcript_lines.parquet").to_pylist():
        if r["session_id"] is not None and r["event_id"] is not None and r["line_offset"] is not None:
            k = (r["session_id"], r["event_id"])
            offsets[k] = min(offsets.get(k, r["line_offset"]), r["line_offset"])
    placed = sorted((m["session_id"], offsets[m["session_id"], m["event_id"]], m["event_id"], m["speaker"]) for m in messages if m["speaker"] != "other" and (m["session_id"], m["event_id"]) in offsets)
    want, last = {}, None
    for s, _, e, speaker in placed:
        if speaker == "user":
            last = (s, e)
            want[last] = 0
        elif last and last[0] == s:
            want[last] += 1
    got = {(r.session_id, r.user_event): r.replies for r in queries.transcript_turns(spark, tables).collect()}
    assert got == want and len(got) > 20

    up = {(m["session_id"], m["event_id"]): m for m in messages}
    tree = {k: 0 for k, m in up.items() if m["speaker"] == "user"}
    for k, m in up.items():
        seen = set()
        at = k
        while at in up and at not in tree and at not in seen:
            seen.add(at)
            at = (k[0], up[at]["parent_id"])
        if m["speaker"] == "assistant" and at in tree:
            tree[at] += 1
    assert {(r.session_id, r.user_event): r.replies for r in queries.transcript_tree(spark, tables).collect()} == tree and sum(tree.values()) > 0


def test_json_messages_count(spark):
    rows = [("s", "u", 0, "user: hi"), ("s", "a", 1, '{"parentId":"u","message":{"role":"assistant","content":"yes"}}'), ("s", "t", 2, '{"parentId":"a","message":{"role":"tool","content":"x"}}'), ("s", "b", 3, '{"parentId":"t","message":{"role":"ASSISTANT","content":[{"type":"text","text":"more"}]}}')]
    lines = spark.createDataFrame(rows, "session_id string, event_id string, line_offset long, content string")
    assert [tuple(r) for r in queries.conversations.transcript_turns(lines).collect()] == [("s", 0, "u", 2)]
    assert [tuple(r) for r in queries.conversations.transcript_tree(lines).collect()] == [("s", "u", 2)]
