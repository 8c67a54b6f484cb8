"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecall.session import materialize

MAX_ROUNDS = 60


def _pairs(df: DataFrame) -> DataFrame:
    return df.where(F.col("u") != F.col("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _pairs(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _pairs(down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``vertex`` and ``component`` (the least vertex reached) for each vertex with an edge to another one.

    Each round exchanges edges by vertex with partial minima, never a whole component; the rounds' results are written to the shared
    folder, and their number grows with the logarithm of the longest path. Null ends and loops are left out; an empty table gives an
    empty table. The join of a hot vertex's edges with its one minimum is a skew join that adaptive execution can split.
    """
    now = materialize(_pairs(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")), "cc")
    state = _print(now)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        now = materialize(_small_star(_large_star(now)), "cc")
        new = _print(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"the components did not settle within {MAX_ROUNDS} rounds")
    leaves = now.select(F.greatest("u", "v").alias("vertex"), F.least("u", "v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("vertex"), "component").distinct())
