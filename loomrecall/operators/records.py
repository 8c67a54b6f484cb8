"""Keyed records: upsert, comparison of snapshots, diffs, ranking by signals and lookup by identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecall.functions import text as T


def upsert(old: DataFrame, new: DataFrame, key: str, payload: list[str], created: str, updated: str) -> DataFrame:
    """One row per key: the payload of the newest write (the later table wins ties), the earliest creation time.

    Both sides are pre-aggregated per key by mergeable aggregates, so a hot key costs no sort of its rows.
    """
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    # Null times and payloads order first, in one way, for a repeatable pick.
    order = F.struct(F.coalesce(F.col(updated), F.lit("")), F.col("_side"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload])
    picked = both.groupBy(key).agg(F.max_by(F.struct(*payload, updated), order).alias("r"), F.min(created).alias(created), F.count(F.lit(1)).alias("writes"))
    return picked.select(key, "r.*", created, "writes")


def compare(left: DataFrame, right: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Per key of two snapshots: identical, differing, left-only or right-only."""
    mark = lambda df, n: df.select(F.col(key), F.to_json(F.struct(*payload)).alias(n))
    both = mark(left, "_l").join(mark(right, "_r"), key, "full_outer")
    state = F.when(F.col("_r").isNull(), "left-only").when(F.col("_l").isNull(), "right-only").when(F.col("_l") == F.col("_r"), "identical").otherwise("differing")
    return both.select(key, state.alias("state"))


def changed_fields(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key of both tables: the names of the fields that differ (nulls compare equal), joined by commas."""
    r = right.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    diff = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_r_{f}")), F.lit(f)) for f in fields]))
    return left.join(r, F.col(key) == F.col("_k")).select(key, F.array_join(diff, ",").alias("changed"))


def lexical_signal(haystack: Column, query: str) -> Column:
    """1 for the whole text, 0.8 if it holds the query, else the share of the query's words that it holds."""
    needle = query.strip().lower()
    words = needle.split()
    if not needle:
        return F.lit(0.0)
    share = sum((F.when(haystack.contains(w), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / F.lit(float(len(words)))
    return F.when(haystack == needle, 1.0).when(haystack.contains(needle), 0.8).otherwise(share)


def semantic_signal(fingerprint: Column, query: str) -> Column:
    """0.5 if the fingerprint holds the query, else half the share of its ASCII words that it holds."""
    import re

    needle = query.strip().lower()
    words = [w for w in re.split(r"[^a-z0-9]+", needle) if w]
    if not words:
        return F.lit(0.0)
    share = sum((F.when(fingerprint.contains(w), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / F.lit(float(len(words)))
    return F.when(fingerprint.contains(needle), 0.5).otherwise(share * 0.5)


def ranked_signals(records: DataFrame, query: str, mode: str) -> DataFrame:
    """(id, lexical, semantic, score) of records with a relevant signal, by the weights of ``mode``."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    hay = F.lower(F.concat_ws(" ", F.col("id"), e("namespace"), e("leaf_name"), e("parent_context"), e("text")))
    finger = F.lower(F.concat(F.lit('{"source":"'), e("source"), F.lit('","structured":'), F.coalesce(F.col("structured"), F.lit("{}")), F.lit(',"text":"'), e("text"), F.lit('"}')))
    needle = query.strip().lower()
    # The signals' sizes and the modes' weights.
    signals = records.select(
        "id", lexical_signal(hay, query).alias("lexical"), semantic_signal(finger, query).alias("semantic"),
        F.when(F.col("scope") == "project", 0.2).when(F.col("scope") == "dir", 0.15).when(F.col("scope") == "user", 0.1).otherwise(0.05).alias("sc"),
        F.when(e("origin") != "", 0.1).otherwise(0.04).alias("pv"), F.when((e("parent_context") != "") & F.lower(e("parent_context")).contains(needle), 0.08).otherwise(0.0).alias("cx"), F.when(e("updated_at") != "", 0.05).otherwise(0.0).alias("rc"),
    )
    if mode == "hybrid":
        score = F.col("lexical") * 0.4 + F.col("semantic") * 0.5 + F.col("sc") * 0.05 + F.col("pv") * 0.03 + F.col("cx") * 0.015 + F.col("rc") * 0.005 + F.when(F.col("semantic") > 0, 0.35).otherwise(0.0)
    else:
        score = F.col(mode) + F.col("sc") + F.col("cx") + F.col("pv") + F.col("rc")
    kept = signals.where((F.col("lexical") > 0) | (F.col("semantic") > 0))
    return kept.select("id", F.round("lexical", 6).alias("lexical"), F.round("semantic", 6).alias("semantic"), F.round(score, 6).alias("score"))


def lookup(records: DataFrame, scope: str | None = None, ident: str | None = None, namespace: str | None = None, leaf: str | None = None, parent: str | None = None) -> DataFrame:
    """Records by identity with the reason of the match; an id settles the match alone."""
    if scope:
        records = records.where(F.col("scope") == scope)
    if ident:
        return records.where(F.col("id") == ident).withColumn("reason", F.lit("identity"))
    if namespace:
        records = records.where(F.lower(F.trim("namespace")) == namespace.strip().lower())
    if leaf:
        records = records.where(T.slug(F.col("leaf_name")) == "-".join(leaf.strip().lower().split()))
    if parent:
        records = records.where(F.coalesce(F.lower(F.trim("parent_context")), F.lit("root")) == parent.strip().lower())
    return records.withColumn("reason", F.lit("scope-filtered" if scope else "baseline"))
