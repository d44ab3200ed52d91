"""Spark session defaults for the corpus jobs.

On a cluster the session is created by the platform; ``configure`` only fills
in settings that are still unset, so a cluster's own choices win, but for the
time zone: timestamps are UTC by contract.  It also ships this package to the
executors, once per Spark context.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from inkstone.sources.tables import SCAN_PARTITIONS

# Settings every job relies on: UTC so timestamps agree with the SQL oracle,
# AQE so join strategy / partition counts are re-planned from runtime sizes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches for mapInPandas: bounded so one batch of long texts
    # (20k-word documents) stays well inside executor memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    # streaming state (one row per task, dedupe keys within the horizon) lives in
    # RocksDB off-heap instead of executor heap maps
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(master: str | None = None, app: str = "inkstone", shuffle_partitions: int | None = None,
          extra: dict | None = None) -> SparkSession:
    """Local/test session builder.  Cluster jobs call ``configure`` instead."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.ui.showConsoleProgress", "false")
    conf.setdefault("spark.driver.memory", "16g")
    # remove checkpoint files (numbered intermediates) once nothing references them
    conf.setdefault("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master and master.startswith("local["):
        cores = master.removeprefix("local[").split("]")[0].split(",")[0]
        conf.setdefault(SCAN_PARTITIONS, str(os.cpu_count() if cores == "*" else int(cores)))
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply defaults that are unset.

    The checkpoint directory (``checkpoint_dir``) is read from
    ``spark.checkpoint.dir``; only in local mode without one (tests) is a
    private scratch folder created.
    """
    conf = spark.conf
    for k, v in DEFAULTS.items():
        if conf.get(k, None) is None:
            conf.set(k, v)
    # timestamps are UTC by contract (zone-less parquet values, RFC3339 output);
    # an unset zone reads back as the JVM default, so pin it explicitly
    conf.set("spark.sql.session.timeZone", "UTC")
    # the checkpoint folder is resolved lazily by the jobs that checkpoint
    ship(spark)
    return spark


def packed(folder: str) -> str:
    """The package as a zip file in ``folder``, named after its contents."""
    root = Path(__file__).resolve().parent
    files = sorted(p for p in root.rglob("*.py"))
    digest = hashlib.md5(b"".join(str(p.relative_to(root)).encode() + p.read_bytes() for p in files)).hexdigest()
    path = os.path.join(folder, f"{root.name}-{digest[:12]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, str(p.relative_to(root.parent)))
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever the driver was started."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no context of its own (Spark Connect): artifacts are the platform's matter
        return
    if sc.applicationId not in _shipped:
        sc.addPyFile(packed(tempfile.mkdtemp(prefix="inkstone-package-")))
        _shipped.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            # a machine-local folder is not shared by executors and is lost with them
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        # local mode without a configured folder (tests): a private scratch folder
        d = tempfile.mkdtemp(prefix="inkstone-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d
