"""Inverted index and BM25 over any table of texts, for one query or for a table of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomrecall.functions import constants as C
from loomrecall.functions import text as T
from loomrecall.session import materialize, ship

#: Texts, tokens and queries of a block in ``bm25_many``, on average.
BLOCK_TEXTS, BLOCK_TOKENS, BLOCK_QUERIES = 1 << 15, 1 << 22, 1 << 16


def postings(df: DataFrame, key: list[str], tokens: Column) -> DataFrame:
    """(key..., token, tf): each token's count in each text."""
    return df.select(*key, F.explode(tokens).alias("token")).groupBy(*key, "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(post: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., token, df, n): texts and occurrences of each token."""
    return post.groupBy(*(by or []), "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


def bm25_idf(df: Column, n: Column) -> Column:
    """How rare a term is among ``n`` texts."""
    return F.log1p((n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25_term(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    """One term's share of the score."""
    return bm25_idf(df, n) * tf * F.lit(C.BM25_K1 + 1) / (tf + F.lit(C.BM25_K1) * (F.lit(1 - C.BM25_B) + F.lit(C.BM25_B) * length / average))


def bm25(df: DataFrame, key: list[str], tokens: Column, terms: list[str], length: Column | None = None) -> DataFrame:
    """(key..., score) of the texts that hold one of ``terms``; the statistics are those of ``df`` as it is filtered.

    Only tokens of the query are exploded, so the shuffle carries the matching postings and not the corpus.
    """
    wanted = sorted(set(terms))
    # Two projections: the tokens of a text are made once. The slim result is written, so the texts are read once for all that follows.
    once = df.select(*key, tokens.alias("_toks"), *([] if length is None else [length.alias("_len")]))
    size = F.size("_toks").alias("_len") if length is None else F.col("_len")
    base = materialize(once.select(*key, size, F.filter("_toks", lambda t: t.isin(wanted)).alias("_hits")), "bm25")
    stats = base.agg(F.count(F.lit(1)).alias("_n"), F.sum("_len").alias("_total"))
    hits = base.where(F.size("_hits") > 0)
    post = hits.select(*key, "_len", F.explode("_hits").alias("token")).groupBy(*key, "_len", "token").agg(F.count(F.lit(1)).alias("tf"))
    freq = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # One row of statistics and at most one row per query term: both are bounded by the query.
    joined = post.join(F.broadcast(freq), "token").join(F.broadcast(stats))
    average = F.when(F.col("_total") > 0, F.col("_total") / F.col("_n")).otherwise(F.lit(1.0))
    return joined.groupBy(*key).agg(F.sum(bm25_term(F.col("tf"), F.col("df"), F.col("_n"), F.col("_len"), average)).alias("score"))


def bm25_many(df: DataFrame, queries: DataFrame, group: list[str], key: list[str], tokens: Column, limit: int) -> DataFrame:
    """(query_text, group..., key..., score) for a table of queries (query_text, group...), each against the texts of its own group.

    Holds each query's ``limit`` best texts by score rounded to six places, then by key, and those of each block of texts that could have been among them.
    A group's texts lie in blocks by their number and tokens; a block meets the group's queries in one task, which adds up their scores in arrays,
    so no row is made for a text that shares a token with a query but is not among the best of its block.
    """
    spark = df.sparkSession
    ship(spark)
    # The tokens of a text are made once and written with their number; the texts themselves are not carried on.
    sized = materialize(df.select(*group, *key, tokens.alias("_toks")).select(*group, *key, F.size("_toks").alias("_len"), "_toks"), "bm25-tokens")
    asked = queries.select(*group, "query_text").distinct()
    stats = sized.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum("_len").alias("_total"))
    average = F.when(F.col("_total") > 0, F.col("_total") / F.col("_n")).otherwise(F.lit(1.0))
    blocks = F.ceil(F.greatest(F.col("_n") / BLOCK_TEXTS, F.col("_total") / BLOCK_TOKENS, F.lit(1.0)))
    # Written, so that its size is known before the tokens are joined with it.
    sizes = materialize(stats.join(asked.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("_parts")), group).select(*group, "_n", average.alias("_average"), blocks.alias("_blocks"), "_parts"), "bm25-groups")
    terms = asked.select(*group, "query_text", F.explode(F.array_distinct(T.tokens(F.col("query_text")))).alias("token"))
    freq = sized.select(*group, F.explode(F.array_distinct("_toks")).alias("token")).groupBy(*group, "token").agg(F.count(F.lit(1)).alias("df"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.col(n))
    cell = [*group, "_block", "_part"]
    texts = sized.where("_len > 0").join(sizes, group).select(*group, *key, "_len", "_toks", "_average", own("_blocks", *key).alias("_block"), every("_parts").alias("_part"))
    weighed = terms.join(freq, [*group, "token"]).join(sizes, group)
    asks = weighed.select(*group, "query_text", "token", bm25_idf(F.col("df"), F.col("_n")).alias("_idf"), own("_parts", "query_text").alias("_part"), every("_blocks").alias("_block"))
    schema = StructType([queries.schema["query_text"], *[df.schema[c] for c in (*group, *key)], StructField("score", DoubleType())])
    return texts.groupBy(*cell).cogroup(asks.groupBy(*cell)).applyInArrow(_best_of_block(key, schema, limit), schema)


def _best_of_block(key: list[str], schema: StructType, limit: int):
    """The function that scores a block of texts for a block of queries."""
    columns = schema.names

    def run(texts: pa.Table, asks: pa.Table) -> pa.Table:
        if not texts.num_rows or not asks.num_rows:
            return texts.slice(0, 0).append_column("query_text", pa.nulls(0, pa.string())).append_column("score", pa.nulls(0, pa.float64())).select(columns)
        # Texts are numbered in the order of their keys, so the first of equal scores come first.
        order = pc.sort_indices(texts.select(key), sort_keys=[(k, "ascending") for k in key], null_placement="at_start").to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        word, query = (asks[c].combine_chunks().dictionary_encode() for c in ("token", "query_text"))
        toks = texts["_toks"].combine_chunks()
        at = pc.fill_null(pc.index_in(toks.flatten(), value_set=word.dictionary), -1).to_numpy()
        hit = np.flatnonzero(at >= 0)
        text = number[pc.list_parent_indices(toks).to_numpy()[hit]]
        pair, tf = np.unique(at[hit] * np.int64(len(order)) + text, return_counts=True)
        token, text = np.divmod(pair, len(order))
        idf = np.zeros(len(word.dictionary))
        idf[word.indices.to_numpy()] = asks["_idf"].to_numpy()
        length = texts["_len"].to_numpy()[order][text] / texts["_average"][0].as_py()
        share = idf[token] * tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * ((1 - C.BM25_B) + C.BM25_B * length))
        ends = np.searchsorted(token, np.arange(len(idf) + 1))
        words, of = word.indices.to_numpy(), query.indices.to_numpy()
        by_query = np.lexsort((words, of))
        words, firsts = words[by_query], np.searchsorted(of[by_query], np.arange(len(query.dictionary) + 1))
        score, found = np.zeros(len(order)), []
        for q in range(len(query.dictionary)):
            score.fill(0)
            for w in words[firsts[q] : firsts[q + 1]]:
                score[text[ends[w] : ends[w + 1]]] += share[ends[w] : ends[w + 1]]
            best = _leading(score, limit)
            found.append((np.full(len(best), q), best, score[best]))
        q, best, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        out = texts.drop_columns(["_toks"]).take(order[best]).append_column("query_text", query.dictionary.take(q)).append_column("score", pa.array(scores))
        return out.select(columns)

    return run


def _leading(score: np.ndarray, limit: int) -> np.ndarray:
    """Places of the positive scores that can be among the ``limit`` greatest once rounded to six places, of equal ones the first ``limit``."""
    at = np.flatnonzero(score)
    if len(at) <= limit:
        return at
    own = score[at]
    near = own >= np.partition(own, len(own) - limit)[len(own) - limit] - 2e-6
    at, own = at[near], own[near]
    if len(at) <= limit:
        return at
    order = np.argsort(-own, kind="stable")
    own = own[order]
    place = np.arange(len(own))
    return at[order][place - np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], place, 0)) < limit]
