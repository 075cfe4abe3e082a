"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: HotSpot never compiles a method above this size; it would be interpreted for every row.
JIT_METHOD_BYTES = "8000"
_METHOD_KEY = "spark.sql.codegen.hugeMethodLimit"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "meltlens") -> SparkSession:
    """Return the active session or build one.

    A master is set only when one is passed.  Otherwise Spark's own settings hold
    (``spark-submit --master``, spark-defaults.conf), so a submitted script keeps
    its cluster; Spark falls back to ``local[*]`` where nothing is set.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        bound_generated_methods(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    builder = (
        builder.appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # wide one-row aggregates (profiles, correlation chunks) stay in codegen
        .config("spark.sql.codegen.maxFields", "1000")
        # checkpoint files of finished queries go with their last reference
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(_METHOD_KEY, JIT_METHOD_BYTES)
        # methods that no expression splitting brings below the JIT's limit: let it compile them anyway
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.driver.memory", os.environ.get("MELTLENS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset.

    On a cluster the configured directory is shared storage and has to be set.
    Only a local session may go without; its scratch directory is removed when
    the process ends.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="meltlens-ckpt-", dir=os.environ.get("MELTLENS_SCRATCH", "/tmp"))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint directory (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_generated_methods(spark: SparkSession) -> None:
    """Run stages whose fused method the JIT would refuse (rules, decisions, report texts) as projections of
    small generated methods, whatever JVM flags the session was started with. A limit set by the user stays."""
    if spark.conf.get(_METHOD_KEY) == "65535":  # Spark's default
        spark.conf.set(_METHOD_KEY, JIT_METHOD_BYTES)


#: Applications whose workers have been given this package.
_SHIPPED: set[str] = set()
#: Rows of an Arrow batch where the session keeps Spark's default, which is meant for narrow rows:
#: ten thousand whole texts at a time are a large part of a worker's memory.
ARROW_ROWS = 2000
_ARROW_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run (once per application), and
    give them batches of whole texts that fit their memory.

    The archive is read by Spark's file server only, so the driver's own
    temporary folder will do.
    """
    if spark.conf.get(_ARROW_KEY) == "10000":
        spark.conf.set(_ARROW_KEY, str(ARROW_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="meltlens-py-"), "meltlens_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
