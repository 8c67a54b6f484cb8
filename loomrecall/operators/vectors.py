"""Exact cosine search: a bounded set of query vectors against all rows, in matrix blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomrecall.session import materialize, spread

#: Query vectors of one block; more queries are run in several blocks.
QUERY_BLOCK = 2048


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def exact_neighbors(df: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, floor: float | None = None, by: str | None = None) -> DataFrame:
    """(query_id, ident, cosine, rank): the ``k`` most similar rows of ``df`` for each query row, the row itself left out; with ``by`` among the rows of the same value of that column.

    Queries are broadcast in blocks of ``QUERY_BLOCK`` rows, one block after another, so their number may grow; each task keeps only the
    ``k`` best of its rows. Rows of another length than the query, and null or empty vectors, are no candidates. Ties go to the smaller id.
    """
    spark = df.sparkSession
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0)
    group = (F.col(by).cast("string") if by else F.lit("")).alias("_by")
    rows = df.where(usable).select(ident, vector, group)
    kind = df.schema[ident].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField(ident, kind), T.StructField("cosine", T.DoubleType())])
    asked = queries.where(usable).select(ident, vector, group)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def block(b: int) -> DataFrame:
        by_kind: dict[tuple, tuple[list, list]] = {}
        for q, v, g in asked.where(F.pmod(F.xxhash64(ident), F.lit(blocks)) == b).toLocalIterator():
            ids, vs = by_kind.setdefault((g, len(v)), ([], []))
            ids.append(q)
            vs.append(v)
        held = spark.sparkContext.broadcast({key: (ids, np.array(vs, np.float64)) for key, (ids, vs) in by_kind.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = {key: (np.array(ids, object), _unit(x)) for key, (ids, x) in held.value.items()}
            for batch in batches:
                sizes = np.asarray(pa.compute.list_value_length(batch.column(1)))
                groups = np.array(batch.column(2).to_pylist(), object)
                for (g, dim), (q_ids, q) in ready.items():
                    at = np.flatnonzero((sizes == dim) & (groups == g))
                    if not len(at):
                        continue
                    own = batch.take(pa.array(at))
                    ids = np.array(own.column(0).to_pylist(), object)
                    by_id = np.argsort(ids, kind="stable")
                    ids = ids[by_id]
                    sims = q @ _unit(_matrix(own.column(1), dim)).T[:, by_id]
                    sims[q_ids[:, None] == ids[None, :]] = -np.inf
                    who, near = _best(np.round(sims, 9), k)
                    keep = sims[who, near] >= (-2.0 if floor is None else floor)
                    who, near = who[keep], near[keep]
                    t = batch.schema.field(0).type
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[who], t), pa.array(ids[near], t), pa.array(sims[who, near], pa.float64())], names=["query_id", ident, "cosine"])

        return spread(rows).mapInArrow(run, schema)

    out = block(0)
    if blocks > 1:
        out = materialize(out, "neighbors")
        for b in range(1, blocks):
            out = out.unionByName(materialize(block(b), "neighbors"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), ident)
    return out.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of at least the ``k`` greatest of each row: all that tie with the k-th stay, for the ids to decide."""
    if sims.shape[1] <= k:
        return np.nonzero(sims > -np.inf)
    least = np.partition(sims, -k, axis=1)[:, -k]
    return np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
