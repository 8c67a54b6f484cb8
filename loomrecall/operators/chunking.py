"""Chunks of texts: one per line, windows of lines, and windows that end at code boundaries."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrecall.functions import constants as C
from loomrecall.session import spread

_BLANKS = r"^[ \t\r\n\f\x{0b}]+|[ \t\r\n\f\x{0b}]+$"


#: A blank line inside a text.
GAP = r"\r?\n[ \t\f]*\r?\n"


def line_chunks(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Plain text: without a blank line one chunk per line that is not blank, else windows of lines. Columns: ident, chunk_index, line, content. Null texts give no rows."""
    known = df.where(F.col(text).isNotNull())
    gap = F.col(text).rlike(GAP)
    lines = known.where(~gap).select(ident, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "raw"))
    single = lines.select(ident, (F.col("pos") + 1).cast("long").alias("line"), F.regexp_replace("raw", _BLANKS, "").alias("content")).where("content <> ''")
    windows = window_chunks(known.where(gap), ident, text).select(ident, F.col("start_line").alias("line"), "content", "window")
    both = single.withColumn("window", F.col("line")).unionByName(windows)
    return both.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(ident).orderBy("window")) - 1).cast("long")).drop("window")


def window_chunks(df: DataFrame, ident: str, text: str, size: int = C.CHUNK_LINES, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` lines that overlap by ``overlap``; blank lines at a window's borders are cut off, blank windows fall away.

    Columns: ident, window, start_line, end_line (from 1), content. Null texts give no rows. A row carries its own window only: the lines
    of a text are cut before they are exploded.
    """
    step = size - overlap
    n = F.size("lines")
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    base = df.where(F.col(text).isNotNull()).select(ident, F.split(text, r"\r?\n").alias("lines"))
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda w: F.slice("lines", w * step + 1, size))
    cut = base.select(ident, F.posexplode(parts).alias("window", "part"))
    full = F.filter(F.transform("part", lambda x, i: F.when(F.regexp_replace(x, _BLANKS, "") != "", i)), lambda i: i.isNotNull())
    marked = cut.withColumn("full", full).where(F.size("full") > 0)
    return marked.select(
        ident, F.col("window").cast("long").alias("window"), (F.col("window") * step + F.element_at("full", 1) + 1).cast("long").alias("start_line"), (F.col("window") * step + F.element_at("full", -1) + 1).cast("long").alias("end_line"), F.regexp_replace(F.array_join("part", "\n"), _BLANKS, "").alias("content"),
    )


#: The words that begin a declaration, by language.
BOUNDARIES = {
    "python": r"^(class|def|async def|from |import )\b",
    "go": r"^(func|type|const|var|package)\b",
    "rust": r"^(pub\s+)?(fn|struct|enum|trait|mod|impl)\b",
    "jvm": r"^(?:public|private|protected|internal|abstract|final|sealed|static|async|export)?\s*(?:class|interface|enum|record|fun|def|object|package|namespace)\b",
    "php": r"^(?:class|interface|trait|function|namespace|use)\b",
    "ruby": r"^(class|module|def)\b",
    "sql": r"^(create\s+(table|view|procedure|function)|alter\s+(table|view)|insert\s+into)\b",
    "other": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|enum|struct|trait|impl|def|module|namespace|object|fun|fn|import|from)\b",
}
_BOUNDARY = {k: re.compile(v) for k, v in BOUNDARIES.items()}
_FAMILY = {"java": "jvm", "kotlin": "jvm", "scala": "jvm", "csharp": "jvm"}


_SPACE = " \t\r\n\f\v"


def code_windows(lines: list[str], language: str) -> Iterator[tuple[int, int]]:
    """(first, behind the last) line of each window. All places where a window may end are found first; each window then looks its own up."""
    pattern = _BOUNDARY[_FAMILY.get(language, language if language in _BOUNDARY else "other")]
    bare = [x.strip(_SPACE).lower() for x in lines]
    places = [i + 1 for i, x in enumerate(bare) if not x or pattern.search(x)]
    at, n = 0, len(lines)
    while True:
        full = at + C.CHUNK_LINES
        if full >= n:
            yield at, n
            return
        nearest = places[k - 1] if (k := bisect_right(places, full)) else 0
        stop = nearest if nearest > max(at + 2, full - C.BOUNDARY_LOOKBACK + 1) else full
        yield at, stop
        at = max(at + 1, stop - C.CHUNK_OVERLAP)


def code_chunks(df: DataFrame, ident: str, text: str, lang: str) -> DataFrame:
    """Windows of code that end behind the last declaration or blank line among their last lines; the next window starts with an overlap.

    Where a window ends decides where the next one starts, so this runs over the lines of one text at a time. Columns: ident, chunk_index,
    start_line, end_line, content. Null texts give no rows.
    """
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, body, language in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                lines = re.split(r"\r?\n", body)
                index = 0
                for a, b in code_windows(lines, language):
                    held = [i for i in range(a, b) if lines[i].strip(_SPACE)]
                    if held:
                        rows.append((key, index, held[0] + 1, held[-1] + 1, "\n".join(lines[a:b]).strip(_SPACE)))
                        index += 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *[pa.array(c, pa.int64()) for c in cols[1:4]], pa.array(cols[4], pa.string())], names=[ident, "chunk_index", "start_line", "end_line", "content"])

    source = spread(df.where(F.col(text).isNotNull()).select(ident, text, F.coalesce(F.col(lang), F.lit("other")).alias("lang")))
    return source.mapInArrow(run, f"{ident} {kind}, chunk_index long, start_line long, end_line long, content string")
