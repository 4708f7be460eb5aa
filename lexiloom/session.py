"""Session helpers shared by tests, the benchmark and the entry module."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Name of the archive in which the package goes to a cluster's executors.
ARCHIVE = "lexiloom-package.zip"
PACKAGE_ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, app: str = "lexiloom") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", os.environ.get("LEXILOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package.

    Workers of this machine import it from where the driver does. On a cluster it is
    handed to the executors as an archive in the shared folder, once a context.
    """
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, known) if x)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and not sc.master.startswith("local"):
        ship_package(spark, shared)


def ship_package(spark: SparkSession, shared: str) -> None:
    """The package as an archive in the folder ``shared``, made known to the executors."""
    sc = spark.sparkContext
    if ARCHIVE in sc._python_includes:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(Path(PACKAGE_ROOT, "lexiloom").rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE_ROOT))
    target = f"{shared.rstrip('/')}/lexiloom-{sc.applicationId}/{ARCHIVE}"
    at = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    The session's ``spark.checkpoint.dir`` wins. Only where it is unset and the
    master is local (tests) a temporary folder is made; elsewhere it is an error.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="lexiloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores where it has fewer splits than there are cores.

    For work that costs far more than moving the rows. A large input has more splits than
    cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
