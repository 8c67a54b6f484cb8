"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int = 8, app: str = "loomrecall", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_loomrecall_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)) / "loomrecall.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._loomrecall_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session. Only a local session may leave it unset and gets a fresh folder (tests)."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if not hasattr(context, "_loomrecall_dir"):  # the setting can't be changed in a running session
        context._loomrecall_dir = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return context._loomrecall_dir


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomrecall/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete the tables that this application has written into the shared folder; call it when no result of it is needed any more."""
    spark.sparkContext.__dict__.pop("_loomrecall_kept", None)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a parquet table into the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing the whole chain, and later reads are column-pruned.
    The tables of one application lie in one folder, which ``sweep`` deletes.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def table_version(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """What changes when one of the tables is written: files, bytes and times below each."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(conf)
        size = fs.getContentSummary(path)
        newest = max([f.getModificationTime() for f in fs.listStatus(path)], default=0)
        out.append((name, size.getFileCount(), size.getLength(), newest))
    return (sf_dir, *out)


def kept(spark: SparkSession, label: str, version: tuple, build: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """Written tables that ``build`` makes once per application and version of its sources."""
    held = spark.sparkContext.__dict__.setdefault("_loomrecall_kept", {})
    if (label, version) not in held:
        held[label, version] = build()
    return held[label, version]


def slots(spark: SparkSession) -> int:
    """Task slots of the cluster as Spark reports them."""
    return max(1, spark.sparkContext.defaultParallelism)


def source_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` is read from, as Spark's statistics give them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)  # rows that the driver holds have no size


def env_int(name: str, default: int) -> int:
    """Integer from the environment, or ``default``."""
    return int(os.environ.get(name, default))


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """``df`` over at least ``factor`` partitions per task slot: rows move only when the source has fewer splits than that.

    For plain reads only: counting the partitions of a frame with a shuffle would run that shuffle.
    """
    ship(df.sparkSession)
    want = factor * slots(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
