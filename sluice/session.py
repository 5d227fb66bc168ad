"""Session helpers: a local session for tests/bench, and the shared scratch folder.

The caller owns the session on a cluster. Everything this library writes on its own
(stream checkpoints, staged fixtures, read-back targets) goes under the folder the
cluster names in ``spark.checkpoint.dir`` so that it survives the loss of an executor.
Only when that setting is unset (local tests) do we pick a folder ourselves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sluice", warehouse_dir: str | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster build your own session instead."""
    builder = SparkSession.builder
    if warehouse_dir:
        builder = builder.config("spark.sql.warehouse.dir", warehouse_dir)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local inputs: let AQE keep ~one partition per core instead of merging a few
        # MB into one task (which would then write every partition file of a sink serially).
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.streaming.schemaInference", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Base folder for everything we write on our own.

    Reads ``spark.checkpoint.dir`` (or the checkpoint dir already set on the context).
    Sets a fresh local folder only when neither is set AND the master is ``local[...]``
    (tests, bench); on a cluster a missing setting is an error, never a local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if configured.startswith("file:") and not sc.master.startswith("local") and sc.getConf().get("spark.sluice.sharedFileSystem", "false") != "true":
            raise RuntimeError(
                f"spark.checkpoint.dir is {configured}: on a cluster a file: folder is shared only if it is a network mount; "
                "if it is one on every machine, set spark.sluice.sharedFileSystem=true"
            )
        sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
            "(HDFS / object store) that every executor and a restarted driver can reach"
        )
    local = tempfile.mkdtemp(prefix="sluice-ckpt-")  # local mode only (tests, bench)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared folder (no cleanup by deletion)."""
    return f"{shared_dir(spark)}/sluice/{name}-{uuid.uuid4().hex[:12]}"
