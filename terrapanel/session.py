"""Session construction and the shared checkpoint folder.

On a cluster the session is built by the platform; ``get_spark`` is for local
runs (tests, bench).  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session and only invents a folder when the master is local and nothing is set.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(app: str = "terrapanel", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TERRAPANEL_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Scratch folder of a local session that names none, by application.
_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage and published snapshots.

    Uses ``spark.checkpoint.dir`` as the session has it; that folder must be one
    that all executors share.  Only a local master (tests, bench) that names
    none falls back to a fresh scratch folder, one per application; on a cluster
    a machine-local folder would not survive the loss of an executor.  (The
    setting is static, so the fallback is kept here and not written back.)
    """
    try:  # a Spark Connect session has no SparkContext on the client
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001
        sc = None
    conf = spark.conf.get(CHECKPOINT_CONF, None)
    if not conf:
        master = sc.master if sc is not None else (spark.conf.get("spark.master", None) or "")
        if not master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_CONF} is not set; a shared folder is required on a cluster")
        app = sc.applicationId if sc is not None else "connect"
        conf = _LOCAL_DIRS.get(app)
        if conf is None:
            conf = _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="terrapanel-ckpt-")
    # setCheckpointDir makes a new subfolder on every call: set it once
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf)
    return conf
