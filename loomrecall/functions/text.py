"""Text functions as Column expressions: they stay inside code generation and compose inside higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomrecall.functions import constants as C


def split_identifier(token: Column) -> Column:
    """The lower-cased identifier, followed by its parts if it has two or more (underscores first, else case humps and digits)."""
    low = F.lower(token)
    parts = F.when(token.contains("_"), F.filter(F.split(low, "_"), lambda p: p != "")).otherwise(F.transform(F.regexp_extract_all(token, F.lit(C.HUMP), F.lit(0)), lambda p: F.lower(p)))
    return F.when(F.size(parts) >= 2, F.concat(F.array(low), parts)).otherwise(F.array(low))


def raw_words(text: Column) -> Column:
    """ASCII identifiers of a text, in order."""
    return F.regexp_extract_all(text, F.lit(C.WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Search tokens of a text: each identifier and its parts, repeats kept."""
    return F.flatten(F.transform(raw_words(text), split_identifier))


def wide_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits, underscores and hyphens of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(C.WIDE_WORD), F.lit(0))


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension, lower-cased."""
    return F.lower(F.regexp_replace(base_name(path), r"\.[^.]+$", ""))


def extension(path: Column) -> Column:
    """Last extension with its dot, lower-cased; empty for none (a leading dot alone starts no extension)."""
    return F.lower(F.regexp_extract(base_name(path), r"[^/](\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """Language of a path by its extension, null for others."""
    table = F.create_map(*[F.lit(x) for kv in C.LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))


def chunk_target(path: Column) -> Column:
    """How a file is cut: supported-code, plain-text or unsupported-language."""
    return F.when(language(path).isNotNull(), "supported-code").when(extension(path).isin("", *C.PLAIN_EXTENSIONS), "plain-text").otherwise("unsupported-language")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(slashed(path), "/"), lambda p: (p != "") & (p != "."))


def stem_variants(path: Column) -> Column:
    """Distinct words of a file's stem and parent folder, whole and split."""
    parts = F.filter(F.split(slashed(path), "/"), lambda p: p != "")
    parent = F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -2))).otherwise("")
    s = stem(path)
    both = F.concat(F.array(s), split_identifier(s), F.array(parent), split_identifier(parent))
    return F.array_distinct(F.filter(both, lambda v: v != ""))


def keyword_matches(keywords: list[str], parts: Column) -> Column:
    """How many keywords occur among the parts, whole or as a common prefix of at least three letters."""

    def shared(k: str) -> Column:
        return F.exists(parts, lambda p: F.when(F.length(p) >= len(k), p.startswith(k) & F.lit(len(k) >= 3)).otherwise((F.length(p) >= 3) & F.lit(k).startswith(p)))

    hits = [F.when(F.array_contains(parts, k) | shared(k), 1).otherwise(0) for k in keywords]
    return sum(hits[1:], hits[0])


def path_penalty(path: Column) -> Column:
    """Product of the factors for tests, re-exports, compatibility code, examples and type declarations."""
    p = slashed(path)
    factor = lambda cond, f: F.when(cond, F.lit(f)).otherwise(F.lit(1.0))
    return (
        factor(p.rlike(C.TEST_FILE) | p.rlike(C.TEST_DIR), 0.3) * factor(p.rlike(C.REEXPORT_FILE), 0.5) * factor(p.rlike(C.COMPAT_DIR), 0.3)
        * factor(p.rlike(C.EXAMPLES_DIR), 0.3) * factor(p.rlike(C.TYPE_DEFS), 0.7)
    )


def lexical_text(path: Column, content: Column) -> Column:
    """A chunk's text followed by its stem twice and the last three folders."""
    folders = F.slice(path_parts(path), 1, F.greatest(F.size(path_parts(path)) - 1, F.lit(0)))
    last = F.when(F.size(folders) > 3, F.slice(folders, -3, 3)).otherwise(folders)
    return F.trim(F.concat(content, F.lit(" "), stem(path), F.lit(" "), stem(path), F.lit(" "), F.lower(F.array_join(last, " "))))


def slug(c: Column) -> Column:
    """Trimmed, lower-cased, runs of white space as one hyphen."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "-")


def stable_key(scope: Column, namespace: Column, parent: Column, leaf: Column) -> Column:
    """scope:namespace:parent:leaf in normal form; a missing or blank parent is ``root``."""
    up = F.nullif(F.lower(F.trim(parent)), F.lit(""))
    return F.concat_ws(":", scope, F.lower(F.trim(namespace)), F.coalesce(up, F.lit("root")), slug(leaf))


def is_symbol_query(query: Column) -> Column:
    return F.trim(query).rlike(C.SYMBOL_QUERY)


def symbol_name(query: Column) -> Column:
    """What follows the last namespace separator."""
    return F.trim(F.regexp_extract(F.trim(query), r"(?s)^(?:.*(?:::|\\|->|\.))?(.*)$", 1))


def truncate_middle(text: Column, limit: int = C.EMBEDDING_MAX_CHARS, marker: str = C.EMBEDDING_MARKER) -> Column:
    """A text longer than ``limit`` as its first 70 %, a marker and its end."""
    budget = max(0, limit - len(marker))
    head = -(-budget * 7 // 10)
    tail = budget - head
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail))))


def sensitive(text: Column) -> Column:
    """Whether a JSON field with provider-internal content is part of the text."""
    fields = "|".join(C.SENSITIVE_FIELDS)
    return text.rlike(rf"(?:^|[{{\[,])\s*[\"'](?:{fields})[\"']\s*:\s*(?:[\"']|[{{\[]|true\b|false\b|null\b|-?\d)")


def strip_tool_traces(text: Column) -> Column:
    """Each line cut where a tool call or result begins, with a note in its place."""
    line = lambda x: F.when(x.rlike(r"[\"']?(?:tool_call|tool_result|toolCall|toolResult)[\"']?\s*:\s*"), F.ltrim(F.concat(F.rtrim(F.regexp_replace(x, r"[\"']?(?:tool_call|tool_result|toolCall|toolResult)[\"']?\s*:\s*.*$", "")), F.lit(" [REDACTED TOOL TRACE]")))).otherwise(x)
    return F.array_join(F.transform(F.split(text, r"\r?\n"), line), "\n")


def folder(path: Column) -> Column:
    """The folder of a path, ``.`` at the root and for null."""
    return F.coalesce(F.nullif(F.regexp_replace(slashed(path), r"/?[^/]*$", ""), F.lit("")), F.lit("."))


def escape_html(c: Column) -> Column:
    """The five reserved characters as entities, and inline event handlers made harmless."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return F.regexp_replace(c, r"(?i)\bon(\w+)\s*=", "data-on$1=")


def display_name(c: Column, limit: int = 60) -> Column:
    """Control characters and runs of blanks as one blank, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"[\s\x{00}-\x{1f}\x{7f}]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("…"))).otherwise(flat)
