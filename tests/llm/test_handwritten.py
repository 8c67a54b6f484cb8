"""File classes on small files and edge cases."""

from loomrecall.llm import handwritten as H

HAND = "import os\n\ndef load(path):\n    \"\"\"Read it.\"\"\"\n    out = []\n    for x in path:\n        if x.size > 3:\n            out.append(x)\n    return out\n"
CASES = {
    "src/a.py": (HAND, None),
    "src/b.py": ("# Code generated by protogen v3. DO NOT EDIT.\n" + HAND, "generated"),
    "src/c.py": ("# ids are generated by loadIt and must not be edited by callers\n" + HAND, None),
    "src/d.py": ("emit('# DO NOT EDIT, generated by ' + tool)\n" + HAND, None),
    "src/e.js": ("function a(b){return b?c(b-1):[]}var d=1;for(e=0;e<9;e++)f.push(e);if(d)throw Error('x');" * 20, "minified"),
    "lib/vendor/tinylib/f.py": (HAND, "vendored"),
    "src/vendors/g.py": (HAND, None),
    "src/h.py": ("# tinylib v1.2 | (c) tinylib authors | released under the MIT license\n" + HAND, "vendored"),
    "src/i.py": ("# (c) the index team\n" + HAND, None),
    "src/j.js": ("const BLOB = [\n" + "  0x23, 0x16, 0x24, 0xd3, 0x12, 0x9f, 0xe1,\n" * 40 + "];\n", "data"),
    "src/k.js": ("".join(f"A.prototype.getX{i} = function () {{ return this.f_[{i}]; }};\n" for i in range(30)), "generated"),
    "src/l.py": (HAND + "# end of generated section, 9 symbols emitted\n", "generated"),
    "cfg/lock-a.yaml": ("lock: 2\n" + "".join(f"lib{i}@1.2.{i}:\n  resolved: \"https://x/{i}.tgz\"\n  integrity: sha512-abc==\n" for i in range(9)), "generated"),
    "cfg/m.env": ("A_B=1\nC_D=2\n" * 20, None),
    "cfg/n.json": ('{\n  "a": 1,\n  "b": 2\n}\n' * 5, None),
}
FILES = "id string, path string, project_key string, updated_at timestamp_ntz, kind string"
CHUNKS = "id string, file_record_id string, chunk_index int, chunk_text string, updated_at timestamp_ntz, chars long, path string"


def frames(spark, ts):
    files = [(f"file-record:p:{p}", p, "p", ts(0), "x") for p in CASES] + [("file-record:p:node_modules/q/z.js", "node_modules/q/z.js", "p", None, None), (None, None, None, None, None)]
    chunks = []
    for p, (t, _) in CASES.items():
        half = len(t) // 2
        cut = t.find("\n", half) + 1 or len(t)
        for i, part in enumerate([t[:cut], t[cut:]]):
            chunks.append((f"c:{p}:{i}", f"file-record:p:{p}", i, part.rstrip("\n"), ts(1), 5, "clash"))
    chunks += [chunks[0], ("c:src/a.py:0", "file-record:p:src/a.py", 0, "# autogenerated by x\n", ts(0), 5, "old"), ("n", "file-record:p:src/a.py", 9, None, None, None, None), ("o", None, 0, "x", None, None, None)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS)


def test_classes(spark, ts):
    got = {r.path: r.kind for r in H.classify_files(*frames(spark, ts)).collect()}
    assert got == {**{p: k for p, (_, k) in CASES.items()}, "node_modules/q/z.js": "vendored"}


def test_results_and_empty(spark, ts):
    files, chunks = frames(spark, ts)
    results = spark.createDataFrame([(1, "p", ".\\src\\b.py"), (2, "p", "./src/a.py"), (2, "p", "./src/a.py"), (3, "q", "src/b.py"), (4, "p", None)], "result_id long, project_key string, file_path string")
    assert sorted(r.result_id for r in H.handwritten_results(results, files, chunks).collect()) == [2, 3, 4]
    assert H.not_handwritten(files.limit(0), chunks.limit(0)).count() == 0


def test_lexer():
    assert H.measure("") == ((0,) * 9, {})
    (chars, lines, canonical, top, *_), shapes = H.measure("a;b;c;\n" * 10)
    assert (lines, canonical) == (10, 30) and top == 10 and list(shapes.values()) == [10]
    assert H.measure("x" * 300000)[0][1] == 1
    tokens = [(m.lastgroup, m.group()) for m in H._TOKEN.finditer("if(a){b(1;2);c}")]
    assert H.canonical(tokens) == ["if ( a ) {", "b ( 1 ; 2 ) ;", "c }"]


def test_classes_do_not_depend_on_the_cut(spark, ts):
    varied = "".join(f"{'ab' * (i % 5 + 1)} = {'f(' * (i % 7)}x{i}{')' * (i % 7)}{' + y' * (i % 3)}\n" for i in range(60))
    notice = "".join(f"# line {i} of our notes\n" for i in range(12)) + "# Code generated by protogen v3. DO NOT EDIT.\n" + HAND
    texts = {p: (t, k) for p, (t, k) in CASES.items() if "lock" not in p} | {"src/p.py": (varied, None), "src/q.py": (notice, "generated"), "src/r.py": ("a = 1\nb = 2\n# notes\n\nc = 3\n# @generated by x (rev 9)\n" + HAND, "generated"), "src/s.py": ("a = 1\n" * 7 + "# @generated by x (rev 9)\n" + HAND, None)}
    for size in (3, 300):
        rows = []
        for p, (t, _) in texts.items():
            ls = t.rstrip("\n").split("\n")
            rows += [(f"c:{p}:{i}", f"file-record:p:{p}", i, "\n".join(ls[a : a + size]), ts(1), 5, "clash") for i, a in enumerate(range(0, len(ls), size))]
        got = H.classify_files(spark.createDataFrame([], FILES), spark.createDataFrame(rows, CHUNKS)).collect()
        assert {r.path: r.kind for r in got} == {p: k for p, (_, k) in texts.items()}, size
