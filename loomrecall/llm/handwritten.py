"""Files that no person of the project wrote: generated, minified, third-party copies, and data saved as code.

Each chunk is lexed once. The lexer re-emits the code in canonical layout (one statement per line) and measures the original against it:
how many lines the canonical form has per original line (extreme expansion marks minified text), how few line shapes make up the text
(perfect uniformity marks generated text), and which share of the characters are literals (dominance marks data). Where the layout tells
nothing, the comments at the head and the end of a file tell of tools and of other authors, and its path of third-party folders. All
measures are sums over the file: line shapes are counted per file before the four commonest are taken, and a comment run at a file's
head or end may reach over any number of chunks. So a file gets the same class however it is cut, and none is ever assembled in one place.

Defined cases: of rows with one chunk id the latest counts; null texts add nothing; chunks without a file are ignored; files without
chunks are judged by their path alone; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrecall.session import materialize, spread

#: Canonical lines per original line from which on a text is minified, and the line length it must have.
EXPANSION = 5.0
MIN_LINE = 110.0
#: Share of the lines that the four commonest shapes make up in a uniform text; less is enough where lines have ``DENSE`` tokens or more.
UNIFORM = 0.9
UNIFORM_DENSE = 0.85
DENSE = 12
TOP = 4
#: Lines that are not blank at a file's head and end in which a comment counts even behind code.
HEAD = 7
TAIL = 4
#: Share of literal characters in data.
LITERAL = 0.8
CODE = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "kt", "c", "h", "cc", "cpp", "hpp", "cs", "rb", "php", "swift", "scala", "sh", "sql", "css", "scss", "lua", "pl", "r", "dart", "vue")

_TOKEN = re.compile(
    r"(?P<n>\n)|(?P<w>[ \t\r\f]+)|(?P<c>//[^\n]*|(?<![\w.])/\*.*?(?:\*/|\Z)|(?:^|(?<=[\s;]))\#[^\n]*|--[ \t][^\n]*)"
    r"|(?P<s>\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|`(?:[^`\\]|\\.)*(?:`|\Z))"
    r"|(?P<d>\d[\w.]*)|(?P<i>[A-Za-z_$\u0080-￿][\w$]*)|(?P<o>.)",
    re.S,
)
_TOOL = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated\b|automatically generated|code generated by|\bgenerated (?:by|from|with|using) [\w./-]+(?:\s|$|[.;,(])|do not (?:edit|modify)|machine[- ](?:written|generated)|(?:changes|edits|modifications?|any change) (?:will |get |are )?(?:be )?(?:lost|overwritten|overwrit\b|overwri)|built from the model|(?:emitted|produced) by|output of [\w-]+, rev|edit the (?:schema|source|template|model) instead"
    r"|(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|nicht (?:ändern|bearbeiten)|(?:fichier )?(?:produit|généré|engendré) (?:par|automatiquement)|ne pas (?:modifier|éditer)|generado (?:por|automáticamente)|no (?:editar|modificar)|end of generated (?:section|code|file)|generato (?:da|automaticamente)"
)
#: Comments in which generation is only the subject.
_ABOUT = re.compile(r"(?i)\b(?:ids?|keys?|names?|tokens?|values?|they|these|which|that|callers?|users?|must not be edited by|are generated|is generated)\b.*\bgenerated\b|\bgenerated\b.{0,60}\bby callers|\b(?:should|could|would|can|see|like|unlike|never|whether|how|why|if)\b")
_OTHERS = re.compile(
    r"(?i)released under|originally part of|copied (?:from|verbatim)|imported unmodified|maintained elsewhere|do not patch|vendored|third[- ]party (?:code|copy|library)|\bupstream\b|licen[cs]ed under|distributed under|\(c\).{0,60}\b(?:authors|contributors|foundation)\b|copyright.{0,60}\b(?:authors|contributors|foundation|inc\.?|ltd\.?|gmbh)\b|all rights reserved|permission is hereby granted"
)
_OWN = re.compile(r"(?i)\(c\) the [\w-]+ team|copyright \(c\) the [\w-]+ team")
_LOCK_LINE = re.compile(r"^\s*\"?(?:resolved|integrity|checksum|resolution|dependencies|lockfileVersion|tarball)\"?:? |^\"?@?[\w./-]+@[\w.^~:*-]+\"?:?\s*$|^(?:name|version|source|checksum) = \"|^[\w./-]+ v\d[\w.-]* h1:", re.M)
_LOCK_NAME = r"(?i)(^|/)([\w.-]*[-_.]lock\b[\w.-]*|lock[-_.][\w.-]+|[\w.-]*\.lock[\w.-]*|go[-_.]sum[\w.-]*|shrinkwrap[\w.-]*|pipfile[\w.-]*lock[\w.-]*)$"
_THIRD = r"(^|/)(vendor|node_modules|bower_components|third_party|third-party|thirdparty|external|extern|deps|_workspace|jspm_packages|Pods|Carthage|site-packages)/[^/]+/"
_LINE_COMMENT = re.compile(r"^\s*(?://+|#+|--|/?\*+!?|;+|<!--|\"\"\"|''')\s?(.*)$")


#: What may stand among the comments at the head of a file, and what may close it.
_PREAMBLE = re.compile(r"^\s*(?:#!|<\?\w*|[\"']use strict[\"']|import\b|from\s+\S+\s+import\b|package\b|use\s|using\s|#\s*(?:include|pragma|ifndef|define)\b|require\b|module\b|namespace\b|@charset|(?:const|let|var)\b.*\brequire\()")
_CLOSING = re.compile(r"^\s*[)\]}>;,]+\s*$")


def canonical(tokens: list[tuple[str, str]]) -> list[str]:
    """The code again with one statement, and one bracket of a block, on a line."""
    lines: list[str] = []
    line: list[str] = []
    depth = 0
    for kind, text in tokens:
        if kind == "w":
            continue
        if kind == "n":
            if line:
                lines.append(" ".join(line))
                line = []
            continue
        line.append(text)
        if kind == "o":
            if text in "([":
                depth += 1
            elif text in ")]":
                depth = max(0, depth - 1)
            if (text == ";" and depth == 0) or text in "{}":
                lines.append(" ".join(line))
                line = []
    if line:
        lines.append(" ".join(line))
    return lines


def measure(text: str) -> tuple[tuple[int, ...], Counter]:
    """(chars, lines, canonical lines, lines of the four commonest shapes, tokens, literal characters, structural characters, comment characters, lock-file lines), and how often each line shape comes."""
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text)]
    chars = lit = punct = comment = count = 0
    shapes: Counter[str] = Counter()
    shape: list[str] = []
    for kind, t in [*tokens, ("n", "\n")]:
        if kind == "n":
            if shape:
                shapes["".join(shape)] += 1
                shape = []
            continue
        if kind == "w":
            continue
        n = len(t)
        chars += n
        if kind == "c":
            comment += n
            shape.append("c")
            continue
        count += 1
        if kind in "sd":
            lit += n
            shape.append("s" if kind == "s" else "d")
        elif kind == "i":
            shape.append("i")
        else:
            if t in ",[]{}:;+()|":
                punct += n
            shape.append(t)
    top = sum(n for _, n in shapes.most_common(TOP))
    return (chars, sum(shapes.values()), len(canonical(tokens)), top, count, lit, punct, comment, len(_LOCK_LINE.findall(text))), shapes


def told(text: str, head: bool) -> tuple[bool, bool, bool]:
    """Whether the run of comments at the head (or the end) says that a tool, or that somebody else, wrote the file; and whether the run fills the text.

    At the head, imports and the like may stand in the run; at the end, closing brackets.
    """
    tool = others = False
    closed = ""
    lines = text.replace("\r", "").split("\n")
    for line in lines if head else reversed(lines):
        if not line.strip():
            continue
        m = _LINE_COMMENT.match(line)
        if closed:
            body = line.strip()
            closed = "" if closed in line else closed
        elif m:
            body = m.group(1).strip()
            if head and (block := re.match(r"\s*(/\*|<!--)", line)):
                end = "*/" if block.group(1) == "/*" else "-->"
                closed = "" if end in line else end
        elif (_PREAMBLE if head else _CLOSING).match(line):
            continue
        else:
            return tool, others, False
        if _TOOL.search(body) and not _ABOUT.search(body):
            tool = True
        elif head and _OTHERS.search(body) and not _OWN.search(body) and not re.match(r"[a-z]+[A-Z]\w* |`", body):
            others = True
    return tool, others, True


def near_ends(text: str) -> tuple[int, int | None, int | None, int | None]:
    """Lines that are not blank; which of the first ``HEAD`` of them tells of a tool and which of somebody else; which of the last ``TAIL``, counted from the end, tells of a tool."""
    lines = [x for x in text.replace("\r", "").split("\n") if x.strip()]
    at: list[int | None] = [None, None, None]
    for k, line in enumerate(lines[:HEAD]):
        tool, others, _ = told(line, True)
        if tool and at[0] is None:
            at[0] = k
        if others and at[1] is None:
            at[1] = k
    for k, line in enumerate(lines[: -TAIL - 1 : -1]):
        if at[2] is None and told(line, False)[0]:
            at[2] = k
    return len(lines), *at


SUMS = ("chars", "lines", "canonical", "top", "tokens", "literal", "punct", "comment", "lock")
FEATURES = ", ".join(f"{c} long" for c in SUMS) + ", tool_head boolean, others_head boolean, head_only boolean, tool_tail boolean, tail_only boolean, filled int, tool_at int, others_at int, end_at int, shapes array<long>, counts array<int>"


def chunk_features(chunks: DataFrame) -> DataFrame:
    """Measures of every chunk row, with its file, index and time."""
    from pyspark.sql import types as T

    names = [c.split()[0] for c in FEATURES.split(", ")]
    source = spread(chunks.where(F.col("file_record_id").isNotNull()).select("id", "file_record_id", "chunk_index", "updated_at", "chunk_text"))
    schema = T.StructType([*source.schema.fields[:4], *T._parse_datatype_string(FEATURES).fields])

    columns = [*source.columns[:4], *names]
    kinds = [*[pa.int64()] * 9, *[pa.bool_()] * 5, *[pa.int32()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32())]
    nothing = (*[0] * 9, False, False, True, False, True, 0, None, None, None, [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for text in batch.column(4).to_pylist():
                if not text:
                    rows.append(nothing)
                    continue
                sums, shapes = measure(text)
                tool, others, only = told(text, True)
                tail, _, last = told(text, False)
                rows.append((*sums, tool, others, only, tail, last, *near_ends(text), [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in shapes], list(shapes.values())))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=columns)

    return source.mapInArrow(run, schema)


def classify(path: Column) -> Column:
    """The class of a file from its summed measures and path, null for hand-written ones."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    code = ext.isin(*CODE)
    c = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("chars", "lines", "canonical", "top", "tokens", "literal", "punct", "comment", "lock")}
    body = F.greatest(c["chars"] - c["comment"], F.lit(1))
    lines = F.greatest(c["lines"], F.lit(1))
    third = path.rlike(_THIRD)
    minified = code & (c["canonical"] / lines >= EXPANSION) & (c["chars"] / lines >= MIN_LINE) & (c["chars"] >= 200)
    literal = code & (c["tokens"] > 20) & (c["literal"] / body >= 0.35) & ((c["literal"] + c["punct"]) / body >= LITERAL)
    uniform = code & (c["lines"] >= 10) & (c["top"] / lines >= F.when(c["tokens"] / lines >= DENSE, F.lit(UNIFORM_DENSE)).otherwise(F.lit(UNIFORM))) & (c["tokens"] / lines >= F.when(ext == "sql", F.lit(9)).otherwise(F.lit(5))) & ~ext.isin("css", "scss", "sh")
    lock = (c["lock"] / lines >= 0.5) | (path.rlike(_LOCK_NAME) & (c["lock"] / lines >= 0.2))
    return (
        F.when(lock, "generated")
        .when(minified, "minified")
        .when(literal, "data")
        .when(uniform, "generated")
        .when(F.coalesce(F.col("tool_head"), F.lit(False)) | F.coalesce(F.col("tool_tail"), F.lit(False)) | F.coalesce(F.col("tool_near") | F.col("end_near"), F.lit(False)), "generated")
        .when(F.coalesce(F.col("others_head"), F.lit(False)) | F.coalesce(F.col("others_near"), F.lit(False)) | third, "vendored")
    )


def _told_in_file() -> list[Column]:
    """Flags of a file from its chunks: a head run counts up to the first chunk that holds code, a run at the end from the last one on."""
    at = F.coalesce(F.col("chunk_index"), F.lit(0))
    code, last = F.coalesce(F.min(F.when(~F.col("head_only"), at)), F.lit(2**31 - 1)), F.coalesce(F.max(F.when(~F.col("tail_only"), at)), F.lit(-1))
    return [*[(F.min(F.when(F.col(c), at)) <= code).alias(c) for c in ("tool_head", "others_head")], (F.max(F.when(F.col("tool_tail"), at)) >= last).alias("tool_tail")]


def near_in_file(per_chunk: DataFrame) -> DataFrame:
    """(file_record_id, tool_near, others_near, end_near): markers in the first and last lines of each file, over as many chunks as these lines take.

    Only the first chunks of a file are numbered: a line that is not blank stands in each, so ``HEAD`` chunks hold the first ``HEAD`` lines.
    """
    slim = per_chunk.where("filled > 0").select("file_record_id", F.coalesce("chunk_index", F.lit(0)).alias("at"), "filled", "tool_at", "others_at", "end_at")
    marked = slim.where("tool_at is not null or others_at is not null or end_at is not null").select("file_record_id").distinct()
    slim = slim.join(marked, "file_record_id", "left_semi")

    def first(order: Column, most: int) -> DataFrame:
        by = Window.partitionBy("file_record_id").orderBy(order, "filled")
        few = slim.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= most)
        return few.withColumn("before", F.coalesce(F.sum("filled").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    flag = lambda at, most: F.coalesce(F.max(F.col("before") + F.col(at) < most), F.lit(False))
    head = first(F.asc("at"), HEAD).groupBy("file_record_id").agg(flag("tool_at", HEAD).alias("tool_near"), flag("others_at", HEAD).alias("others_near"))
    tail = first(F.desc("at"), TAIL).groupBy("file_record_id").agg(flag("end_at", TAIL).alias("end_near"))
    return head.join(tail, "file_record_id")


def shape_lines(per_chunk: DataFrame, sums: DataFrame) -> DataFrame:
    """(file_record_id, top): lines of the ``TOP`` commonest shapes of each file, counted over the whole file.

    The sum of the chunks' own commonest is an upper bound, so only files that it leaves in question are counted.
    """
    open_ = sums.where(F.col("top") >= F.lit(UNIFORM_DENSE) * F.greatest("lines", F.lit(1))).select("file_record_id")
    each = per_chunk.select("file_record_id", F.explode(F.arrays_zip("shapes", "counts")).alias("s")).join(open_, "file_record_id", "left_semi")
    counts = each.groupBy("file_record_id", F.col("s.shapes").alias("shape")).agg(F.sum("s.counts").alias("n"))
    most = Window.partitionBy("file_record_id").orderBy(F.desc("n"), "shape")
    return counts.withColumn("rn", F.row_number().over(most)).where(F.col("rn") <= TOP).groupBy("file_record_id").agg(F.sum("n").alias("top"))


def classify_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per file id of either table: ``file_record_id``, ``path``, ``kind`` (null for hand-written) and the measures."""
    names = [c.split()[0] for c in FEATURES.split(", ")]
    latest = chunk_features(chunks).groupBy("file_record_id", "chunk_index", "id").agg(F.max_by(F.struct(*names), F.struct("updated_at", *names)).alias("m")).select("file_record_id", "chunk_index", "m.*")
    # Another id at the same place of a file is no repeated row and adds up as it is.
    per_chunk = materialize(latest, "file-chunks")
    sums = per_chunk.groupBy("file_record_id").agg(*[F.sum(n).alias(n) for n in SUMS], *_told_in_file())
    sums = materialize(sums, "file-sums")
    whole = sums.drop("top").join(shape_lines(per_chunk, sums), "file_record_id", "left").join(near_in_file(per_chunk), "file_record_id", "left")
    ids = files.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("file_record_id")).agg(F.max("path").alias("path"))
    both = ids.join(whole, "file_record_id", "full_outer")
    path = F.coalesce(F.col("path"), F.regexp_replace("file_record_id", r"^file-record:(?:project:)?[^:]*:", ""))
    return both.withColumn("path", path).withColumn("kind", classify(F.col("path")))


def not_handwritten(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct ``file_record_id`` of the files that are not hand-written."""
    return classify_files(files, chunks).where("kind is not null").select("file_record_id").distinct()


def normalized_path(c: Column) -> Column:
    """One spelling of a path: forward slashes, no leading or inner dot segments, no doubled slashes, no outer blanks."""
    p = F.trim(F.regexp_replace(c, r"\\", "/"))
    p = F.regexp_replace(p, r"^(?:file://)?(?:\./)+|(?<=/)(?:\./)+", "")
    return F.regexp_replace(F.regexp_replace(p, r"/{2,}", "/"), r"^/", "")


def handwritten_results(results: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Search results (distinct rows by result_id) without those whose file is not hand-written, with the path in its one spelling."""
    kinds = classify_files(files, chunks)
    key = files.groupBy("id").agg(F.max("project_key").alias("project_key"), F.max("path").alias("p")).select("project_key", F.lower(normalized_path(F.col("p"))).alias("key_path"), F.col("id").alias("file_record_id"))
    flagged = key.join(kinds.where("kind is not null").select("file_record_id", "kind"), "file_record_id").select("project_key", "key_path").distinct()
    rows = results.dropDuplicates(["result_id"]).withColumn("file_path", normalized_path(F.col("file_path"))).withColumn("key_path", F.lower("file_path"))
    return rows.join(flagged, ["project_key", "key_path"], "left_anti").drop("key_path")
