"""Index maintenance: why files are skipped, what changed between two scans, and what has to go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecall.functions import constants as C
from loomrecall.functions import text as T


def skip_reason(path: Column, size: Column, sensitive: Column, text_only: bool = True, max_bytes: int = C.MAX_FILE_BYTES) -> Column:
    """Why a file is not indexed, null if it is: ignored folder, size, extension, no language, sensitive content, in this order."""
    folders = F.slice(T.path_parts(path), 1, F.greatest(F.size(T.path_parts(path)) - 1, F.lit(0)))
    out = F.when(F.exists(folders, lambda d: d.isin(*C.IGNORED_DIRS)) | path.rlike(r"-(?:wal|shm)$"), "ignored").when(size > max_bytes, "oversized")
    out = out.when(F.lower(path).rlike("(?:" + "|".join(x.replace(".", r"\.") for x in C.EXCLUDED_EXTENSIONS) + ")$"), "extension")
    if not text_only:
        out = out.when(T.language(path).isNull(), "text")
    return out.when(F.coalesce(sensitive, F.lit(False)), "sensitive")


def is_binary(content: Column) -> Column:
    """Whether the first bytes hold a NUL, or more than a third control characters. ``content`` is binary; null is no binary file."""
    head = F.hex(F.substring(content, 1, C.BINARY_SAMPLE))
    n = F.length(head) / 2
    even = F.regexp_replace(head, "(..)", "$1 ")
    control = F.length(even) - F.length(F.regexp_replace(even, r"\b(?:0[1-8BEF]|1[0-9A-F]) ", ""))
    return F.coalesce((n > 0) & (even.rlike(r"\b00 ") | (control / 3 / n > C.BINARY_RATIO)), F.lit(False))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per file id of two scans (id, content_hash, mtime_ms, size_bytes): new, changed, touched, unchanged or deleted.

    ``changed`` is another content; ``touched`` the same content with another time or size, which is chunked again all the same.
    """
    b = before.select("id", F.col("content_hash").alias("h0"), F.col("mtime_ms").alias("m0"), F.col("size_bytes").alias("s0"), F.lit(True).alias("was"))
    a = after.select("id", F.col("content_hash").alias("h1"), F.col("mtime_ms").alias("m1"), F.col("size_bytes").alias("s1"), F.lit(True).alias("is"))
    same = F.col("h0").eqNullSafe(F.col("h1"))
    state = (
        F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(~same, "changed")
        .when(~F.col("m0").eqNullSafe(F.col("m1")) | ~F.col("s0").eqNullSafe(F.col("s1")), "touched").otherwise("unchanged")
    )
    return b.join(a, "id", "full_outer").select("id", state.alias("state"), F.when(state == "new", "confirmed-by-hash").when(state == "changed", "changed").when(state == "deleted", "deleted").alias("audit"))
