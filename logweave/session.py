"""Session helpers: the runtime settings every operator relies on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime SQL settings the operators need. They are session-level and can be
# set on an existing session (the driver's, a notebook's, a cluster job's).
RUNTIME_CONF = {
    # event times are parsed from naive strings; treat them as UTC
    "spark.sql.session.timeZone": "UTC",
    # JSON log lines with a repeated key keep the last value
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library depends on (idempotent)."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers find this package when it runs from a plain checkout.

    On a cluster it is installed or sent with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; if it is unset there, this raises. Only a local-mode session (tests,
    the bench) without the setting gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor shares (e.g. on HDFS or object storage)"
            )
        conf_dir = tempfile.mkdtemp(prefix="logweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "logweave") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    ensure_checkpoint_dir(spark)
    return spark


def materialize(df):
    """Reliable checkpoint of an intermediate result several branches read.

    Without it every branch re-runs the plan above the shared result. The
    data goes to the session's checkpoint folder, so it survives the loss of
    the executors that computed it. Used for aggregates, not raw input.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    # persisted first: writing the checkpoint files would otherwise recompute the rows
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()
