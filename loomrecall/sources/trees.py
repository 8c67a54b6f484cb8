"""Source trees as tables: files with content and hash, and the ignore rules of a project."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrecall.functions import text as T
from loomrecall.operators.scan import is_binary, skip_reason


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, bool]]:
    """(pattern, negated) of an ignore file that lies in ``folder``: ``*`` within a name, ``**/`` over folders, ``!`` negates, a slash anchors.

    ``?`` and character classes are taken literally. Comments and blank lines give no rule.
    """
    out = []
    base = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only_dir = line.endswith("/")
        anchored = "/" in line.rstrip("/")
        body = re.escape(line.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*")
        out.append((f"^{base}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if only_dir else '(?:/.*)?'}$", negated))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches a path ignores it. The rules are a bounded list of a project's ignore files."""
    out = F.lit(False)
    for pattern, negated in rules:
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def scan_tree(spark: SparkSession, root: str, rules: list[tuple[str, bool]] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Every file below ``root``: path, size_bytes, mtime_ms, content_hash, text and the reason for which it is left out (null if it isn't).

    Listing and reading are Spark's own; an empty or missing pattern of rules ignores nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = "file:" + root.rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"
    path = F.replace(F.replace("path", F.lit("file:///"), F.lit("file:/")), F.lit(prefix), F.lit(""))
    rows = files.select(path.alias("path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    body = F.try_to_binary(F.lit(""), F.lit("utf-8"))
    text = F.when(~is_binary(F.col("content")), F.decode(F.coalesce("content", body), "UTF-8"))
    limit = {} if max_bytes is None else {"max_bytes": max_bytes}
    reason = F.when(ignored(F.col("path"), rules or []), "ignored").otherwise(F.coalesce(skip_reason(F.col("path"), F.col("size_bytes"), T.sensitive(text), **limit), F.when(is_binary(F.col("content")), "binary")))
    return rows.select("path", "size_bytes", "mtime_ms", F.sha2("content", 256).alias("content_hash"), text.alias("text"), T.language(F.col("path")).alias("language"), reason.alias("skip_reason"))
