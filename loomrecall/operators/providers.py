"""Embedding refresh with a pluggable provider, and a deterministic one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecall.functions import text as T

#: Texts to vectors, one call per Arrow batch; a model is loaded by the callable itself, once per worker.
Provider = Callable[[list[str]], list[list[float]]]


def hash_provider(dim: int) -> Provider:
    """Bytes of the text's SHA-256 over 255, repeated up to ``dim``: no model, always the same."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[b / 255 for b in (hashlib.sha256(t.encode()).digest() * (-(-dim // 32)))[:dim]] for t in texts]

    return embed


def refresh(rows: DataFrame, ready: DataFrame, ident: str, text: str, provider: Provider, dim: int) -> DataFrame:
    """(ident, text_hash, embedding, status, error) for the rows without a usable vector of their present text.

    ``ready`` is (ident, text_hash, embedding). A vector of the same text under another id is taken over instead of asking again; a
    failing batch becomes failed rows, a vector of another length too. Null texts are left out.
    """
    cut = T.truncate_middle(F.col(text))
    want = rows.where(F.col(text).isNotNull()).select(ident, cut.alias("_t"), F.sha2(cut, 256).alias("text_hash"))
    lacking = want.join(ready.select(ident, "text_hash"), [ident, "text_hash"], "left_anti")
    known = ready.groupBy("text_hash").agg(F.max("embedding").alias("embedding"))
    found = lacking.join(known, "text_hash", "left")
    taken = found.where("embedding is not null").select(ident, "text_hash", "embedding", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("error"))
    asked = found.where("embedding is null").select("text_hash", "_t").dropDuplicates(["text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(1).to_pylist(), batch.num_rows
            try:
                got, error = provider(texts), None
            except Exception as e:  # the provider is foreign code: its failure is data
                got, error = [None] * n, str(e)[:500]
            good = [v is not None and len(v) == dim for v in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v if ok else None for v, ok in zip(got, good, strict=True)], pa.list_(pa.float32())), pa.array(["ready" if ok else "failed" for ok in good]), pa.array([None if ok else (error or "another length") for ok in good], pa.string())], names=["text_hash", "embedding", "status", "error"]
            )

    made = asked.mapInArrow(run, "text_hash string, embedding array<float>, status string, error string")
    fresh = found.where("embedding is null").select(ident, "text_hash").join(made, "text_hash").select(ident, "text_hash", "embedding", "status", "error")
    return taken.unionByName(fresh)
