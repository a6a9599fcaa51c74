"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Size bound (bytes) under which a side may be broadcast explicitly.  Anything
# that is not provably small goes through a shuffle join chosen by Catalyst/AQE.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def get_session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Return (or create) a session with AQE on and the UI off.

    On a cluster the session already exists and this only returns it.  Locally
    (tests, bench) the shuffle-partition count follows the core count.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    master = master or f"local[{cpus}]"
    spark = (
        SparkSession.builder.master(master)
        .appName("tessera")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``.  Only a local session
    (tests, bench) without the setting gets a fresh scratch folder; a cluster
    without it raises, as its executors don't share the driver's disk."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Iterative plans (walks, label propagation, power iteration) call this every
    few rounds so that a lost executor re-reads the checkpoint instead of
    recomputing the whole history.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """True when the optimizer's size estimate for ``df`` is under ``limit``.

    The estimate is taken from the optimized logical plan (no job runs).
    """
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        size = int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - defensive: unknown size = not small
        return False
    return size <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its estimated size is proven under ``limit``;
    otherwise return it unchanged so the join shuffles."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if fits_broadcast(df, limit) else df
