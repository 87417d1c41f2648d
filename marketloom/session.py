"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "marketloom") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # Generated methods above 8000 bytes are never compiled by the JVM; wide rule projections
        # run faster as separate, compiled projections.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # One machine reads small files: their rows are dealt to all cores before heavy work.
        .config("spark.marketloom.rawPartitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def compiled(spark: SparkSession) -> None:
    """Lets wide projections run as separate, compiled methods: one generated method above 8000 bytes is only interpreted by the JVM.

    A session that names a smaller limit keeps it.
    """
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535")) > 8000:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def few_listings(spark: SparkSession) -> None:
    """Folders are listed by few tasks with many paths each. By default every path is a task of its own, of which a stream over a lake of
    thousands of small folders starts thousands for each batch and each restart.

    A session that names a smaller limit keeps it.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if int(spark.conf.get(name)) > 64:
        spark.conf.set(name, "64")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of frames that are gone; they lie on disk until then."""
    # The session holds on to its last query; a tiny one takes that place.
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def light_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most 4 MB, so a task holds little of a table of long texts at a time.

    A session that names a smaller limit keeps it.
    """
    name, limit = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    if _bytes(spark.conf.get(name)) > limit:
        spark.conf.set(name, str(limit))


def _bytes(size: str) -> int:
    """Bytes of a setting like 64MB or 65536."""
    number = size.strip().lower().removesuffix("b")
    return int(number[:-1]) << 10 * (1 + "kmgt".index(number[-1])) if number[-1:] in tuple("kmgt") else int(number)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is accepted only when the session itself is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_ROOTS:
        folder = tempfile.mkdtemp(prefix="marketloom-")
        context.setCheckpointDir(folder)
        _LOCAL_ROOTS[context.applicationId] = folder
    return _LOCAL_ROOTS[context.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, unused folder below the checkpoint root."""
    return f"{checkpoint_root(spark).rstrip('/')}/marketloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Used where one result feeds several branches that must agree row for row, so that a lost
    executor cannot make the branches see different partitionings.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
