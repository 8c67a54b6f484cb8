"""Most similar vectors for every vector: an inverted file of coarse centroids with product-quantised residuals.

Per group of comparable vectors: spherical k-means gives the coarse centroids, a second one the codebooks of the residuals' subspaces.
Every vector is indexed in the list of its nearest centroid and searches the lists of its ``probes`` nearest ones. Lists lie in cells of
neighbouring centroids, so a query travels once to each cell it probes, not to each list. In a cell, asymmetric distance tables give
each pair's approximate cosine with a bound on its error (the norm of the residual's rounding); every pair whose upper bound can still
reach the threshold and the k-th best lower bound is reranked with exact cosines in double precision. Only the k best of a query leave a cell.

Lists grow with the root of the group's size. Hot cells are cut into blocks of at most ``BLOCK`` rows and ``BLOCK_BYTES``; a task holds one block and streams the queries past it, a batch at a time, and more tasks share
a cell's queries where there are many or the cluster has more slots than cells. Vectors that are equal bit for bit are searched once and expanded with
the first k + 1 ids of their class, which is all that any top k can use; the rows of a hot class are spread by salts.

Bounds: training reads a hash sample of a group, on average at most ``TRAIN_ROWS`` rows, or eight to a list, and at most ``TRAIN_BYTES``;
models pass through the driver and are broadcast in batches of at most ``MODEL_BYTES``, a model being no larger.

Defined cases: unusable rows (not ready, wrong length, null, empty, non-finite or all-zero) and superseded rows take no part; repeated
rows count once; of rows with one id and time, the greatest vector counts; ties in cosine go to the smaller id; empty tables give an
empty table; groups of one row give no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomrecall.session import materialize, slots, spread

K = 5
MIN_COSINE = 0.8
PROBES = 16
TRAIN_ROWS = 40_000
TRAIN_BYTES = 64_000_000
MODEL_BYTES = 64_000_000
#: Index rows and bytes that one task holds at a time, and query rows that one task streams past them.
BLOCK = 65_536
BLOCK_BYTES = 64_000_000
QUERY_BLOCK = 262_144
ROUNDS = 8
#: Rows of a class of equal vectors that share one salt, and cells of a matrix of products.
HOT = 100_000
CELLS = 1 << 25
GROUP = ["provider_key", "model", "dimension"]


def usable_vectors(rows: DataFrame) -> DataFrame:
    """Of each record_id the latest row, if its vector can be compared: GROUP columns, record_id, embedding."""
    latest = rows.where(F.col("record_id").isNotNull()).groupBy("record_id").agg(
        F.max_by(F.struct(*GROUP, "embedding", "status", "configured_dimension"), F.struct(F.col("updated_at"), F.col("status"), F.col("embedding"))).alias("r")
    )
    flat = latest.select("record_id", "r.*")
    good = (
        (F.col("status") == "ready") & (F.size("embedding") == F.col("dimension")) & (F.col("dimension") == F.col("configured_dimension")) & (F.col("dimension") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    )
    return flat.where(good).select(*GROUP, "record_id", "embedding")


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(x: np.ndarray, c: np.ndarray, half: np.ndarray | int = 0) -> np.ndarray:
    step = max(1, CELLS // len(c))
    return np.concatenate([(x[i : i + step] @ c.T - half).argmax(1) for i in range(0, len(x), step)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, c, 0 if spherical else (c * c).sum(1) / 2)
        order = np.argsort(near, kind="stable")
        found, start = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], start, axis=0)
        c[found] = _unit(sums) if spherical else sums / np.diff(np.append(start, len(x)))[:, None]
    return c


def list_count(n: int, dim: int) -> int:
    """Inverted lists of a group of ``n`` vectors: they grow with its root, as far as a model's bytes allow."""
    return int(max(1, min(4 * round(np.sqrt(n)), MODEL_BYTES // (8 * dim))))


def block_rows(dim: int) -> int:
    """Index rows of one block."""
    return int(max(1024, min(BLOCK, BLOCK_BYTES // (8 * dim))))


def train(x: np.ndarray, n: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Coarse centroids, their cells and residual codebooks of unit vectors ``x``, a sample of ``n``."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    lists = min(list_count(n, x.shape[1]), len(x))
    coarse = _kmeans(x, lists, rng, True)
    cells = max(1, min(lists, -(-n // block_rows(x.shape[1]))))
    middle = _kmeans(coarse, cells, rng, True)
    sub = max(4, -(-x.shape[1] // 32))
    parts = _split(x - coarse[_nearest(x, coarse)], sub)
    books = np.stack([_pad(_kmeans(p, min(256, len(p)), rng, False), 256) for p in parts])
    return {"coarse": coarse, "cell": _nearest(coarse, middle).astype(np.int32), "books": books}


def _pad(c: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([c, np.repeat(c[:1], n - len(c), axis=0)]) if len(c) < n else c


def _split(x: np.ndarray, sub: int) -> list[np.ndarray]:
    short = -x.shape[1] % sub
    x = np.pad(x, ((0, 0), (0, short)))
    return [np.ascontiguousarray(x[:, i : i + sub]) for i in range(0, x.shape[1], sub)]


def encode(x: np.ndarray, near: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Residual codes of ``x`` in lists ``near``, and the norm of what the codes leave out."""
    books = model["books"]
    parts = _split(x - model["coarse"][near], books.shape[2])
    codes = np.stack([(p @ b.T - (b * b).sum(1) / 2).argmax(1) for p, b in zip(parts, books, strict=True)], axis=1).astype(np.uint8)
    left = sum(((p - b[codes[:, m]]) ** 2).sum(1) for m, (p, b) in enumerate(zip(parts, books, strict=True)))
    return codes, np.sqrt(left)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def train_models(vectors: DataFrame) -> DataFrame:
    """One trained model per group, each trained in one task over a bounded sample: GROUP columns, gid, coarse, cell, books, parts."""
    counts = vectors.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"))
    size = F.col("dimension").cast("double")
    lists = F.least(F.lit(4.0) * F.sqrt("_n"), F.lit(MODEL_BYTES) / (8 * size))
    wanted = F.least(F.greatest(F.lit(float(TRAIN_ROWS)), 8 * lists), F.greatest(F.lit(256.0), F.lit(TRAIN_BYTES) / (4 * size)))
    sizes = counts.select(*[F.col(g).alias(f"_{g}") for g in GROUP], "_n", wanted.alias("_rows"))
    place = F.pmod(F.xxhash64("record_id"), F.lit(1 << 31)).cast("double") / F.lit(float(1 << 31))
    # No rows are numbered: each is in the sample by its own hash, so a hot group is thinned out where it is read.
    sample = vectors.join(sizes, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in GROUP]).where(place * F.col("_n") < F.col("_rows")).select(*GROUP, "embedding", "_n")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
        m = train(x, int(pdf["_n"].iloc[0]))
        return pd.DataFrame([{**{g: pdf[g].iloc[0] for g in GROUP}, "coarse": m["coarse"].tobytes(), "cell": m["cell"].tobytes(), "books": m["books"].astype(np.float32).tobytes(), "parts": len(m["books"])}])

    fields = [vectors.schema[g] for g in GROUP] + [T.StructField(c, T.BinaryType()) for c in ("coarse", "cell", "books")] + [T.StructField("parts", T.IntegerType())]
    return materialize(sample.groupBy(*GROUP).applyInPandas(fit, T.StructType(fields)), "ivf-models")


def model_batches(fitted: DataFrame) -> Iterator[list[dict]]:
    """The models as lists of at most ``MODEL_BYTES`` (or of one model), read one after another."""
    held: list[dict] = []
    size = 0
    for gid, r in enumerate(fitted.toLocalIterator()):
        own = len(r["coarse"]) + len(r["books"])
        if held and size + own > MODEL_BYTES:
            yield held
            held, size = [], 0
        held.append(r.asDict() | {"gid": gid})
        size += own
    if held:
        yield held


def _as_arrays(row: dict) -> dict[str, np.ndarray]:
    books = np.frombuffer(row["books"], np.float32).reshape(row["parts"], 256, -1)
    return {"coarse": np.frombuffer(row["coarse"], np.float32).reshape(-1, row["dimension"]), "cell": np.frombuffer(row["cell"], np.int32), "books": books}


PLACED = "gid int, cell int, part int, is_query boolean, record_id string, vec binary, lists binary, code binary, err float"


def cell_sizes(reps: DataFrame, models: list[dict], probes: int) -> DataFrame:
    """(gid, cell, is_query, n): how many rows ``place`` makes for each cell. Assigning twice is cheaper than writing the placed rows."""
    placed = place(reps, models, probes, counts=True)
    return placed.groupBy("gid", "cell", "is_query").agg(F.sum("part").alias("n"))


def place(reps: DataFrame, models: list[dict], probes: int, counts: bool = False) -> DataFrame:
    """Rows for the cells: one index row per vector, and one query row per cell that it probes. With ``counts`` only their numbers (in ``part``)."""
    held = reps.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {tuple(m[g] for g in GROUP): (m["gid"], _as_arrays(m)) for m in held.value}
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True))
            index = pd.Series(range(len(keys))).groupby(pd.Series(keys).map({k: i for i, k in enumerate(known)}), sort=True)
            for g, rows in index:
                gid, model = list(known.values())[int(g)]
                rows = rows.to_numpy()
                dim = model["coarse"].shape[1]
                raw = _vectors(batch.column(4).take(pa.array(rows)), dim).astype(np.float32)
                ids = np.array(batch.column(3).take(pa.array(rows)).to_pylist(), object)
                step = max(16, min(4096, CELLS // len(model["coarse"])))
                for a in range(0, len(rows), step):
                    part = raw[a : a + step]
                    x = _unit(part.astype(np.float64)).astype(np.float32)
                    dots = x @ model["coarse"].T
                    p = min(probes, dots.shape[1])
                    near = np.argpartition(-dots, p - 1, axis=1)[:, :p].astype(np.int32)
                    own = dots.argmax(1)
                    if counts:
                        probed = np.zeros((len(part), int(model["cell"].max()) + 1), bool)
                        probed[np.arange(len(part))[:, None], model["cell"][near]] = True
                        for is_query, sums in ((False, np.bincount(model["cell"][own], minlength=probed.shape[1])), (True, probed.sum(0))):
                            m = len(sums)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, gid, np.int32)), pa.array(np.arange(m, dtype=np.int32)), pa.array(sums.astype(np.int32)), pa.array(np.full(m, is_query)), pa.nulls(m, pa.string()), *[pa.nulls(m, pa.binary())] * 3, pa.nulls(m, pa.float32())], names=names)
                        continue
                    codes, err = encode(x, own, model)
                    vec = [v.tobytes() for v in part]
                    name = ids[a : a + step]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gid, np.int32)), pa.array(model["cell"][own]), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, bool)), pa.array(name, pa.string()), pa.array(vec, pa.binary()), pa.array([o.tobytes() for o in own.astype(np.int32)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err.astype(np.float32))], names=names)
                    cells = model["cell"][near]
                    order = np.argsort(cells, axis=1, kind="stable")
                    near, cells = np.take_along_axis(near, order, 1), np.take_along_axis(cells, order, 1)
                    cut = np.ones_like(cells, bool)
                    cut[:, 1:] = cells[:, 1:] != cells[:, :-1]
                    who, at = np.nonzero(cut)
                    ends = np.append(np.flatnonzero(cut.ravel())[1:], cells.size)
                    begins = np.flatnonzero(cut.ravel())
                    flat = np.ascontiguousarray(near.ravel())
                    n = len(who)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gid, np.int32)), pa.array(cells[who, at]), pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, bool)), pa.array(name[who], pa.string()), pa.array([vec[i] for i in who], pa.binary()), pa.array([flat[b:e].tobytes() for b, e in zip(begins, ends, strict=True)], pa.binary()), pa.array([b""] * n, pa.binary()), pa.array(np.zeros(n, np.float32))], names=names)

    names = [c.split()[0] for c in PLACED.split(", ")]
    return reps.select(*GROUP, "record_id", "embedding").mapInArrow(run, PLACED)


class Cell:
    """A block of index rows, ready for queries."""

    def __init__(self, base: pa.Table, model: dict[str, np.ndarray]):
        self.model, self.dim = model, model["coarse"].shape[1]
        self.vectors = _unit(_bytes(base, "vec", np.float32).reshape(-1, self.dim).astype(np.float64))
        self.ids = np.array(base.column("record_id").to_pylist(), object)
        self.rank = np.argsort(np.argsort(self.ids, kind="stable"))
        lists = _bytes(base, "lists", np.int32)
        self.codes, self.err = _bytes(base, "code", np.uint8).reshape(len(self.ids), -1), base.column("err").to_numpy()
        self.order = np.argsort(lists, kind="stable")
        self.lists, self.begins = np.unique(lists[self.order], return_index=True)
        self.ends = np.append(self.begins[1:], len(lists))

    def search(self, ask: pa.Table, k: int, floor: float) -> tuple[list, list, list]:
        """The ``k`` best index rows of at least ``floor`` for each query row, among the lists that it probes."""
        qv = _unit(_bytes(ask, "vec", np.float32).reshape(-1, self.dim).astype(np.float64))
        q_id = np.array(ask.column("record_id").to_pylist(), object)
        wanted = ask.column("lists").to_pylist()
        q_list, q_row = np.frombuffer(b"".join(wanted), np.int32), np.repeat(np.arange(len(q_id)), [len(w) // 4 for w in wanted])
        by_q = np.argsort(q_list, kind="stable")
        books = self.model["books"]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lo, hi = np.searchsorted(q_list[by_q], self.lists), np.searchsorted(q_list[by_q], self.lists, "right")
        for one, b0, b1, q0, q1 in zip(self.lists, self.begins, self.ends, lo, hi, strict=True):
            bs, qs = self.order[b0:b1], q_row[by_q[q0:q1]]
            for a in range(0, len(qs), 1024):
                rows = qs[a : a + 1024]
                q32 = qv[rows].astype(np.float32)
                tables = [p @ book.T for p, book in zip(_split(q32, books.shape[2]), books, strict=True)]
                own = (q32 @ self.model["coarse"][one])[:, None]
                for c in range(0, len(bs), 4096):
                    cols = bs[c : c + 4096]
                    near = np.repeat(own, len(cols), axis=1)
                    for m, table in enumerate(tables):
                        near += table[:, self.codes[cols, m]]
                    slack = self.err[cols] + 1e-4
                    least = np.full(len(rows), floor)
                    if len(cols) > k:  # the query itself may be one of the k + 1 best
                        low = near - slack
                        least = np.maximum(least, np.partition(low, -(k + 1), axis=1)[:, -(k + 1)])
                    r, s = np.nonzero(near + slack >= least[:, None])
                    r, s = rows[r], cols[s]
                    exact = np.concatenate([np.einsum("ij,ij->i", qv[r[i : i + 65536]], self.vectors[s[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0)])
                    keep = (exact >= floor) & (q_id[r] != self.ids[s])
                    if keep.any():
                        found.append(_best(r[keep], s[keep], exact[keep], self.rank, k))
        if not found:
            return [], [], []
        r, s, score = _best(*[np.concatenate(x) for x in zip(*found, strict=True)], self.rank, k)
        return list(q_id[r]), list(self.ids[s]), list(score)


def _bytes(t: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), kind)


def _best(r: np.ndarray, s: np.ndarray, score: np.ndarray, b_rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b_rank[s], -score, r))
    r, s, score = r[order], s[order], score[order]
    start = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    at = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
    return r[at < k], s[at < k], score[at < k]


def search(reps: DataFrame, models: list[dict], k: int, floor: float, probes: int) -> DataFrame:
    """(qid, rid, cosine): the ``k`` best of each query, exactly reranked."""
    spark = reps.sparkSession
    held = spark.sparkContext.broadcast(models)
    sizes = materialize(cell_sizes(reps, models, probes).where("n > 0"), "ivf-sizes")
    share = max(1, -(-slots(spark) // max(1, sizes.where("is_query").count())))
    rows_of = lambda q: F.coalesce(F.max(F.when(F.col("is_query") == q, F.col("n"))), F.lit(0))
    held_rows = spark.createDataFrame([(m["gid"], block_rows(m["dimension"])) for m in models], "gid int, block int")
    blocks = sizes.join(held_rows, "gid").groupBy("gid", "cell").agg(
        F.greatest(F.lit(1), F.ceil(rows_of(False) / F.first("block"))).cast("int").alias("nb"), F.greatest(F.lit(share), F.ceil(rows_of(True) / F.lit(QUERY_BLOCK))).cast("int").alias("nq")
    )
    cut = place(reps, models, probes).drop("part").join(blocks, ["gid", "cell"])
    h = F.pmod(F.xxhash64("record_id"), F.lit(2**31 - 1))
    mine = F.when(F.col("is_query"), F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: b * F.col("nq") + (h % F.col("nq")).cast("int"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: (h % F.col("nb")).cast("int") * F.col("nq") + q))
    cut = cut.withColumn("part", F.explode(mine)).drop("nb", "nq")
    order = ["gid", "cell", "part", "is_query"]  # a block's index rows come before its queries
    ready = cut.repartition("gid", "cell", "part").sortWithinPartitions(*order).select(*order, "record_id", "vec", "lists", "code", "err")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models_by = {m["gid"]: m for m in held.value}
        key, base, model = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if key != tuple(keys[a, :3]):
                    key, base, model = tuple(keys[a, :3]), [], _as_arrays(models_by[int(keys[a, 0])])
                if not keys[a, 3]:
                    base.append(part)
                    continue
                if not base:
                    continue
                if isinstance(base, list):
                    base = Cell(pa.concat_tables(base), model)
                q, r, score = base.search(part, k, floor)
                if q:
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(r, pa.string()), pa.array(score, pa.float64())], names=["qid", "rid", "cosine"])

    hits = ready.mapInArrow(run, "qid string, rid string, cosine double")
    best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "rid")
    return hits.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k).drop("_rn")


def class_members(vectors: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, record_id, n_same) of every record whose vector occurs more than once.

    Classes meet their records by the hash of the vector and a salt, so that a class of a third of all rows is spread. The salted hashes
    that are broadcast are at most one for every ``HOT`` rows.
    """
    repeated = reps.where("n_same > 1").select(F.col("record_id").alias("rep"), *[F.col(g).alias(f"_{g}") for g in GROUP], F.col("embedding").alias("_e"), "n_same", F.xxhash64("embedding").alias("h"))
    hot = repeated.where(F.col("n_same") > HOT).groupBy("h").agg(F.max(F.ceil(F.col("n_same") / F.lit(HOT))).cast("int").alias("salts"))
    hot = F.broadcast(materialize(hot, "vector-hot"))
    salts = F.coalesce("salts", F.lit(1))
    left = vectors.withColumn("h", F.xxhash64("embedding")).join(hot, "h", "left").withColumn("salt", F.pmod(F.xxhash64("record_id"), salts.cast("long")).cast("int")).drop("salts")
    right = repeated.join(hot, "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts").withColumnRenamed("h", "_h").withColumnRenamed("salt", "_salt")
    same = [F.col("h") == F.col("_h"), F.col("salt") == F.col("_salt"), *[F.col(g).eqNullSafe(F.col(f"_{g}")) for g in GROUP], F.col("embedding") == F.col("_e")]
    return left.join(right, same).select("rep", "record_id", "n_same")


def similar_vectors(rows: DataFrame, k: int = K, min_cosine: float = MIN_COSINE, probes: int = PROBES) -> DataFrame:
    """The ``k`` most similar records of every usable record with at least ``min_cosine``: record_id, neighbor_id, cosine, rank (1 is best)."""
    vectors = materialize(usable_vectors(rows), "vectors")
    reps = vectors.groupBy(*GROUP, "embedding").agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("n_same"))
    reps = materialize(reps, "vector-classes")
    fitted = train_models(reps)
    groups = fitted.count()
    hits = reps.sparkSession.createDataFrame([], "qid string, rid string, cosine double")
    for some in model_batches(fitted):
        own = spread(reps)
        if len(some) < groups:
            keys = reps.sparkSession.createDataFrame([tuple(m[g] for g in GROUP) for m in some], T.StructType([T.StructField(f"_{g}", reps.schema[g].dataType) for g in GROUP]))
            own = reps.join(keys, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in GROUP], "left_semi")
        hits = hits.unionByName(materialize(search(own, some, k, min_cosine, probes), "ivf-hits"))
    # Back from classes of equal vectors to records: the first k + 1 ids of a class are all that a top k can use.
    members = class_members(vectors, reps)
    lead = members.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("record_id"))).where(F.col("at") <= k + 1)
    pairs = hits.select(F.col("qid").alias("q"), F.col("rid").alias("r"), "cosine")
    targets = pairs.join(lead.where(F.col("at") <= k).select(F.col("rep").alias("r"), F.col("record_id").alias("r2")), "r", "left").select("q", F.coalesce("r2", "r").alias("neighbor_id"), "cosine")
    # A class of more than k + 1 members fills every top k of its own, so only members of smaller ones look further.
    small = members.where(F.col("n_same") <= k).select(F.col("rep").alias("q"), F.col("record_id").alias("q2"))
    large = members.where(F.col("n_same") > k).select(F.col("rep").alias("q")).distinct()
    outer = targets.join(large, "q", "left_anti").join(small, "q", "left").select(F.coalesce("q2", "q").alias("record_id"), "neighbor_id", "cosine")
    salts = F.ceil(F.col("n_same") / F.lit(HOT)).cast("int")
    firsts = lead.select("rep", F.col("record_id").alias("neighbor_id"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    spread_out = members.select("rep", "record_id", F.pmod(F.xxhash64("record_id"), salts.cast("long")).cast("int").alias("salt"))
    inner = spread_out.join(firsts, ["rep", "salt"]).where("record_id != neighbor_id").select("record_id", "neighbor_id", F.lit(1.0).alias("cosine"))
    rank = Window.partitionBy("record_id").orderBy(F.desc("cosine"), "neighbor_id")
    return outer.unionByName(inner).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def similar_pairs(neighbors: DataFrame) -> DataFrame:
    """Distinct unordered pairs of a result of ``similar_vectors``."""
    return neighbors.select(F.least("record_id", "neighbor_id").alias("record_id_a"), F.greatest("record_id", "neighbor_id").alias("record_id_b")).distinct()
