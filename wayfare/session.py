"""SparkSession construction and checkpoint-directory handling."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every wayfare job wants: AQE for runtime re-planning (partition
# coalescing, skew-join splitting), UTC so that date formatting of
# timestamps is reproducible, and no UI server.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(shuffle_bytes: float, cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle/scan sizing for a large cluster.

    ``shuffle_bytes`` is the size of the largest shuffle, not of the raw
    input: after column pruning and map-side combining the session and
    feature shuffles carry a fraction of the events (roughly 10-20 %).

    * initial shuffle partitions ~ shuffle / target size (at least 2 x cores),
      whatever the size; raise ``target_partition_bytes`` where the driver
      should track fewer map outputs; AQE then coalesces
      small partitions toward ``advisoryPartitionSizeInBytes`` and splits
      skewed join partitions (a hot user) into several tasks;
    * scan splits of 256 MB keep per-task input bounded;
    * broadcast joins only below 64 MB of *runtime* size (AQE), never by hint
      on data that grows with the input.

    Example: 100 TB of events, ~15 TB in the largest shuffle, 1,000 executors
    x 4 cores -> ``cluster_conf(15e12, 4000)`` -> 55,880 initial partitions.
    """
    parts = max(2 * cores, int(shuffle_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    }


def build_session(master: str | None = None, app: str = "wayfare",
                  shuffle_partitions: int | None = None, checkpoint_dir: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with wayfare's defaults.

    On a cluster ``master`` stays ``None`` so spark-submit decides; tests
    pass ``local[*]``.  ``checkpoint_dir`` names the folder for checkpoints and
    written tables where the cluster does not (``spark.checkpoint.dir``).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if checkpoint_dir:
        conf["spark.checkpoint.dir"] = checkpoint_dir
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None for a Spark Connect session (no driver-side context)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect raises a dedicated "not supported" error
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...) folder
    and is always respected.  Only when nothing is configured (unit tests,
    a laptop) do we fall back to a fresh local scratch folder.
    """
    sc = _context(spark)
    if sc is None:      # Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a machine-local folder would vanish with the executor that wrote it
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="wayfare-ckpt-")
        atexit.register(shutil.rmtree, configured, True)       # a scratch folder of this process only
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: computed once, whichever branches read it,
    and safe when an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
