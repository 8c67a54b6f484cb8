"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from loomrecall.api import Engine
from loomrecall.operators.records import upsert
from loomrecall.sources import corpus, graphs, processes, transcripts, trees
from loomrecall.streaming import events as SE
from loomrecall.streaming import sessions as SS


def test_scan_tree(spark, tmp_path):
    (tmp_path / "src" / "gen").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    for name, body in {"src/a.ts": b"let a", "src/gen/b.ts": b"x", "src/gen/keep.ts": b"y", "node_modules/c.js": b"z", "d.bin": b"\0\1", "e.log": b"t", "f.json": b'{"encrypted_content": "q"}'}.items():
        (tmp_path / name).write_bytes(body)
    rules = trees.ignore_rules("# rules\n*.log\n/src/gen/\n!src/gen/keep.ts\n")
    got = {r.path: (r.skip_reason, r.language) for r in trees.scan_tree(spark, str(tmp_path), rules).collect()}
    assert got == {"src/a.ts": (None, "typescript"), "src/gen/b.ts": ("ignored", "typescript"), "src/gen/keep.ts": (None, "typescript"), "node_modules/c.js": ("ignored", "javascript"), "d.bin": ("binary", None), "e.log": ("ignored", None), "f.json": ("sensitive", None)}


def test_corpus_roundtrip(spark, tmp_path):
    lines = [{"id": "a", "content": "one"}, {"id": "a", "content": {"text": "two", "structured": {"k": 1}}, "scope": "user"}, {"id": "a", "content": "gone", "lifecycle": "deleted"}, {"id": "b", "content": {"text": None}}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    (tmp_path / "bad.jsonl").write_text(json.dumps(lines[0]) + "\n{broken\n[1]\n")
    assert sorted(r.value for r in corpus.broken_lines(spark, str(tmp_path / "bad.jsonl")).collect()) == ["[1]", "{broken"]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        corpus.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    got = {r.id: (r.text, r.scope, r.structured) for r in corpus.read_jsonl(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got == {"a": ("two", "user", '{"k":1}'), "b": (None, "project", None)}
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "records": lines[:1]}))
    assert [(r.id, r.text) for r in corpus.read_snapshot(spark, str(tmp_path / "s.json")).collect()] == [("a", "one")]
    corpus.write_jsonl(spark.createDataFrame([("a", "x")], "id string, content string"), str(tmp_path / "out"))
    assert corpus.read_jsonl(spark, str(tmp_path / "out")).first().text == "x"
    corpus.bucketed_store(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"), str(tmp_path / "store"), 64)
    corpus.bucketed_store(spark.createDataFrame([("a", 2)], "id string, v int"), str(tmp_path / "store"), 64)
    corpus.bucketed_store(spark.createDataFrame([(f"x{i}", i) for i in range(9)], "id string, v int"), str(tmp_path / "few"), 1)
    corpus.bucketed_store(spark.createDataFrame([("x3", 33), ("y", 1)], "id string, v int"), str(tmp_path / "few"), 1)
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "few")).collect()} == {(f"x{i}", 33 if i == 3 else i) for i in range(9)} | {("y", 1)}
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "store")).collect()} == {("a", 2), ("b", 1)}


def test_pipe_lines(spark):
    df = spark.createDataFrame([("s|e|7|a|b",), ("bad",), ("s|e|x|c",), (None,)], "value string")
    got = transcripts.pipe_lines(df).collect()
    assert (got[0].session_id, got[0].line_offset, got[0].content) == ("s", 7, "a|b")
    assert [r.session_id for r in got[1:]] == [None, None, None]


def test_graph_sources(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "label": "A", "source_file": "/r/x.ts", "source_location": "L12"}, {"id": None, "label": "B"}], "links": [{"_src": "a", "_tgt": "b", "relation": "calls"}, {"source": "a", "relation": "calls"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    n, e = graphs.read_export(spark, str(tmp_path / "g.json"), "/r")
    assert [(r.id, r.source_file, r.line) for r in n.collect()] == [("a", "x.ts", 12)]
    assert [(r.source, r.target, r.confidence, r.weight) for r in e.collect()] == [("a", "b", "EXTRACTED", 1.0)]
    (tmp_path / "r.md").write_text('# Report\n### Community 3 - "Search"\nCohesion: 0.25\nNodes (4): a, b\n### Community 4 - "Graph"\n')
    assert [(r.community, r.name, r.cohesion, r.nodes) for r in graphs.read_report(spark, str(tmp_path / "r.md")).orderBy("community").collect()] == [(3, "Search", 0.25, 4), (4, "Graph", None, None)]


def test_processes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "role": "r", "pid": 1, "lastHeartbeatAt": "2025-01-01T00:00:00Z"}))
    (tmp_path / "b.json").write_text("{nope")
    ok, bad = processes.read_processes(spark, str(tmp_path))
    assert [r.id for r in ok.collect()] == ["a"] and bad.count() == 1
    now = F.timestamp_millis(F.lit(1735689600000 + 61_000))
    assert [r.s for r in ok.select(processes.process_state(F.lit(True), F.col("lastHeartbeatAt"), now).alias("s")).collect()] == ["heartbeat-stale"]


def _stream(spark, rows, schema, tmp_path):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_dedupe_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = [(i % 7, f"2025-01-01 00:0{i % 6}:00") for i in range(20)]
    stream = _stream(spark, [rows[:10], rows[10:]], "event_id long, ts string", tmp_path).withColumn("ts", F.col("ts").cast("timestamp"))
    _run(SE.first_deliveries(stream, "event_id", "ts", "1 hour"), tmp_path, "dd")
    assert sorted(r.event_id for r in spark.table("dd").collect()) == list(range(7))


def test_stream_windows(spark, tmp_path):
    rows = [[(1, "2025-01-01 00:10:00"), (1, "2025-01-01 00:20:00"), (2, "2025-01-01 01:10:00")], [(1, "2025-01-01 05:00:00")], [(3, "2025-01-01 00:30:00"), (3, "2025-01-01 09:00:00")]]
    stream = _stream(spark, rows, "k long, ts string", tmp_path).withColumn("ts", F.col("ts").cast("timestamp"))
    _run(SE.window_counts(stream, "ts", "1 hour", "30 minutes", ["k"]), tmp_path, "win")
    got = {(str(r.window_start), r.k): r.n for r in spark.table("win").collect()}
    assert got[("2025-01-01 00:00:00", 1)] == 2 and got[("2025-01-01 01:00:00", 2)] == 1


def test_flush_stream(spark, tmp_path):
    turn = lambda s, i, t, n=5: (s, f"{s}{i}", t, "u" * n, "a")
    rows = [[turn("s", i, f"2025-01-01 00:0{i}:00") for i in range(4)] + [turn("big", 0, "2025-01-01 00:00:00", 5000)], [turn("z", 0, "2025-01-01 06:00:00")], [turn("z", 1, "2025-01-01 09:00:00")]]
    stream = _stream(spark, rows, "session_id string, id string, turn_ts string, user_text string, assistant_text string", tmp_path).withColumn("turn_ts", F.col("turn_ts").cast("timestamp"))
    _run(SS.flush_stream(stream), tmp_path, "flush")
    got = {(r.session_id, r.reason, r.turns) for r in spark.table("flush").collect()}
    assert {("s", "threshold", 3), ("big", "large-turn", 1), ("s", "idle", 1)} <= got


def test_keyed_sink_replays(spark, tmp_path):
    write = SE.keyed_sink(str(tmp_path / "kv"), "id", ["text"], "created", "updated")
    s = "id string, text string, created string, updated string"
    a, b = spark.createDataFrame([("a", "x", "1", "1")], s), spark.createDataFrame([("a", "y", "2", "2"), ("b", "z", "2", "2")], s)
    for frame, n in ((a, 0), (b, 1), (b, 1)):
        write(frame, n)
    write(a.limit(0), 2)
    assert sorted(p.name for p in (tmp_path / "kv").iterdir()) == ["version=1", "version=2"]
    assert {(r.id, r.text, r.created) for r in spark.read.parquet(str(tmp_path / "kv" / "version=1")).collect()} == {("a", "y", "1"), ("b", "z", "2")}
    assert upsert(a, b, "id", ["text"], "created", "updated").count() == 2


def test_engine(spark, tables):
    e = Engine(spark, tables)
    found = e.search_files("cached query", 5, languages=["typescript"]).collect()
    assert 1 <= len(found) <= 5 and all(r.file_path.endswith(".ts") for r in found)
    assert e.search_memory("stale chunk", 4).count() == 4
    assert e.status().count() == 220
    best = e.graph_query("chunk", 3)
    assert best.count() == 3
    rid = spark.read.parquet(f"{tables}/record_embeddings.parquet").where("status = 'ready'").orderBy("record_id").first().record_id
    assert e.related(rid, 3).count() <= 3


def test_engine_modes(spark, tables):
    e = Engine(spark, tables)
    chunks = spark.read.parquet(f"{tables}/indexed_chunks.parquet").dropDuplicates(["id"])
    pos = F.pmod(F.xxhash64("id"), F.lit(97)).cast("double")
    vectors = chunks.select("id", F.array(pos, F.lit(7.0), F.lit(1.0)).alias("embedding"))
    near = e.search_files("cached query", 5, mode="semantic", vectors=vectors, query_vector=[0.0, 7.0, 1.0]).collect()
    both = e.search_files("cached query", 5, mode="hybrid", vectors=vectors, query_vector=[0.0, 7.0, 1.0], alpha=0.5).collect()
    assert len(near) == len(both) == 5 and [r["rank"] for r in both] == [1, 2, 3, 4, 5]
    symbol = e.search_files("HotScope", 5).collect()
    assert all(r.score >= 0 for r in symbol)
    for wrong in ({"mode": "semantic"}, {"mode": "other"}, {"mode": "hybrid", "vectors": vectors}):
        with pytest.raises(ValueError):
            e.search_files("x", **wrong)
    one = chunks.where("start_line is not null and end_line is not null").orderBy("id").first()
    path = one.file_record_id.split(":", 3)[3] if one.file_record_id.startswith("file-record:project:") else one.file_record_id.split(":", 2)[2]
    assert e.related_chunks(one.project_key, path, one.start_line, vectors, 3).count() <= 3


def test_tables_of_a_version_are_kept(spark, tables):
    from loomrecall import session

    version = session.table_version(spark, tables, ("indexed_chunks", "file_records"))
    made = []
    build = lambda: made.append(1) or (spark.range(1),)
    assert session.kept(spark, "t", version, build) is session.kept(spark, "t", version, build) and len(made) == 1
    session.kept(spark, "t", (*version, "newer"), build)
    assert len(made) == 2
