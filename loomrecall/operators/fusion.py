"""Fusion and reranking of candidate lists: reciprocal ranks, coherence and stem boosts, path penalties, and decay per file.

Candidates come as one table with a query key, so many searches are reranked at once; every window is per query (and per file in it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrecall.functions import constants as C
from loomrecall.functions import text as T


def rrf(rank: Column) -> Column:
    """Reciprocal rank, from 1."""
    return F.lit(1.0) / (F.lit(float(C.RRF_K)) + rank)


def ranked(df: DataFrame, by: list[str], score: str, ties: list[str], name: str) -> DataFrame:
    """``name`` is the rank from 1 by falling score within ``by``."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), *ties)
    return df.withColumn(name, F.row_number().over(w))


def coherence_boost(df: DataFrame, by: list[str], file: str, score: str, ties: list[str]) -> DataFrame:
    """The best chunk of each file gains a fifth of the best score, weighted by the file's sum against the greatest sum."""
    all_, own = Window.partitionBy(*by), Window.partitionBy(*by, file)
    first = Window.partitionBy(*by, file).orderBy(F.col(score).desc(), *ties)
    sums = df.withColumn("_sum", F.sum(score).over(own)).withColumn("_first", F.row_number().over(first)).withColumn("_top", F.max(score).over(all_))
    sums = sums.withColumn("_topsum", F.max("_sum").over(all_))
    gain = F.when((F.col("_first") == 1) & (F.col("_top") != 0) & (F.col("_topsum") != 0), F.col("_top") * C.COHERENCE_BOOST * F.col("_sum") / F.col("_topsum")).otherwise(0.0)
    return sums.withColumn(score, F.col(score) + gain).drop("_sum", "_first", "_top", "_topsum")


def query_keywords(query: Column) -> Column:
    """Distinct words of a question that carry weight: no stop words, no embedded symbols, longer than one letter."""
    symbols = F.regexp_extract_all(query, F.lit(C.EMBEDDED_SYMBOL), F.lit(0))
    plain = F.filter(T.raw_words(query), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*C.STOPWORDS) & ~F.array_contains(symbols, w))
    parts = F.flatten(F.transform(plain, T.split_identifier))
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(*C.STOPWORDS)))


def stem_ratio(keywords: Column, variants: Column) -> Column:
    """Share of the keywords that a path's words match, whole or by a common prefix of at least three letters."""
    near = lambda k, p: (k == p) | (F.when(F.length(k) <= F.length(p), (F.length(k) >= 3) & p.startswith(k)).otherwise((F.length(p) >= 3) & k.startswith(p)))
    hits = F.size(F.filter(keywords, lambda k: F.exists(variants, lambda p: near(k, p))))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(0.0)


def stem_boost(df: DataFrame, by: list[str], query: str, path: str, score: str) -> DataFrame:
    """Questions (not symbol queries) gain the best score times the share of keywords in the path, from a tenth on."""
    top = F.max(score).over(Window.partitionBy(*by))
    ratio = stem_ratio(query_keywords(F.col(query)), T.stem_variants(F.col(path)))
    held = df.withColumn("_top", top).withColumn("_ratio", ratio)
    gain = F.when(~T.is_symbol_query(F.col(query)) & (F.col("_ratio") >= C.STEM_MIN_RATIO), F.col("_top") * C.STEM_BOOST * F.col("_ratio")).otherwise(0.0)
    return held.withColumn(score, F.col(score) + gain).drop("_top", "_ratio")


def saturated(df: DataFrame, by: list[str], file: str, score: str, ties: list[str], k: int, penalise: bool = True) -> DataFrame:
    """Path penalties, then half the score for each better chunk of the same file, then the ``k`` best: adds ``rank``."""
    if penalise:
        df = df.withColumn(score, F.col(score) * T.path_penalty(F.col(file)))
    inside = Window.partitionBy(*by, file).orderBy(F.col(score).desc(), *ties)
    df = df.withColumn(score, F.col(score) * F.pow(F.lit(C.SATURATION_DECAY), F.row_number().over(inside) - 1))
    best = Window.partitionBy(*by).orderBy(F.col(score).desc(), file, *ties)
    return df.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def defines(text: Column, name: Column) -> Column:
    """Whether a text introduces the symbol ``name`` (a definition keyword, or an SQL definition in any case)."""
    esc = F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    space = r"(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*"
    after = r"(?:\s|[<({:\[]|$)"
    general = F.concat(F.lit(r"(?m)(?:^|(?<=\s))(?:" + "|".join(C.DEFINITION_KEYWORDS) + r")\s+" + space), esc, F.lit(after))
    sql = F.concat(F.lit(r"(?mi)(?:^|(?<=\s))(?:" + "|".join(C.SQL_DEFINITION_KEYWORDS) + r")\s+" + space), esc, F.lit(after))
    return F.regexp_like(text, general) | F.regexp_like(text, sql)


def definition_boost(df: DataFrame, by: list[str], query: str, path: str, text: str, score: str) -> DataFrame:
    """Symbol queries: chunks that define the symbol gain three times the best score, half as much again if the file is named after it."""
    name = T.symbol_name(F.col(query))
    low = F.lower(name)
    bare = lambda v: F.regexp_replace(v, "_", "")
    plural = lambda v: F.regexp_replace(v, "s$", "")
    named = F.exists(T.stem_variants(F.col(path)), lambda v: (v == low) | (bare(v) == low) | (plural(v) == low) | (plural(bare(v)) == low))
    top = F.max(score).over(Window.partitionBy(*by))
    held = df.withColumn("_top", top)
    gain = F.when(T.is_symbol_query(F.col(query)) & F.coalesce(defines(F.col(text), name), F.lit(False)), F.col("_top") * C.DEFINITION_BOOST * F.when(named, 1.5).otherwise(1.0)).otherwise(0.0)
    return held.withColumn(score, F.col(score) + gain).drop("_top")


def with_definitions(cands: DataFrame, rows: DataFrame, query: str, text: str, key: list[str], score: str) -> DataFrame:
    """``cands``, and with score 0 the ``rows`` that define the symbol of a symbol query but are no candidates. Both have ``query`` and the ``key`` columns."""
    new = rows.where(T.is_symbol_query(F.col(query)) & F.coalesce(defines(F.col(text), T.symbol_name(F.col(query))), F.lit(False))).join(cands.select(query, *key), [query, *key], "left_anti")
    return cands.unionByName(new.withColumn(score, F.lit(0.0)).select(*cands.columns))


def embedded_boost(df: DataFrame, by: list[str], query: str, path: str, text: str, score: str) -> DataFrame:
    """Questions that hold symbols: chunks that define one of them gain one and a half times the best score, half as much again if the file is named after one."""
    names = F.array_distinct(F.regexp_extract_all(F.col(query), F.lit(C.EMBEDDED_SYMBOL), F.lit(0)))
    held = df.withColumn("_top", F.max(score).over(Window.partitionBy(*by))).withColumn("_names", names)
    named = F.exists("_names", lambda n: F.exists(T.stem_variants(F.col(path)), lambda v: v == F.lower(n)))
    hit = F.exists("_names", lambda n: F.coalesce(defines(F.col(text), n), F.lit(False)))
    gain = F.when(~T.is_symbol_query(F.col(query)) & hit, F.col("_top") * C.DEFINITION_BOOST * C.EMBEDDED_BOOST_SCALE * F.when(named, 1.5).otherwise(1.0)).otherwise(0.0)
    return held.withColumn(score, F.col(score) + gain).drop("_top", "_names")
