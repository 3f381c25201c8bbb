"""Session defaults and the shared scratch space.

Expensive intermediate results (model calls above all) are written as parquet
under the folder the cluster names in ``spark.checkpoint.dir``. Such a table
survives the loss of any executor and keeps column pruning for its readers.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key also where a later join would have reused the partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Folders of a table are listed by tasks; with one each, starting tasks takes the time.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "128",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A repeated key in a model response takes its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # HotSpot never compiles a method of over 8000 bytes. Response reading makes
    # longer ones; below this limit Spark splits them instead of fusing the stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the defaults to a session somebody else made."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "reviewgate") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        # A call site per column expression costs a round trip to the JVM each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        # One machine holds driver and executors, so its own folder is shared.
        app = spark.sparkContext.applicationId
        if app not in _local_scratch:
            _local_scratch[app] = tempfile.mkdtemp(prefix="reviewgate-")
        return _local_scratch[app]
    raise ValueError("spark.checkpoint.dir must name a folder all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/reviewgate/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that is no longer needed, in whatever store holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    target = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
