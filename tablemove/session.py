"""Session and scratch-location helpers.

Everything that writes (staging, snapshots, stream checkpoints, round trips)
writes below one shared root.  On a cluster that root is the shared folder the
cluster names in ``spark.checkpoint.dir``; it is read from the session and only
set here when it is unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Scale-oriented defaults.  AQE re-plans joins and coalesces partitions at
# runtime; skew-join splitting handles hot keys in inner/left/right/semi/anti
# joins.  The broadcast threshold is Spark's own size check (plan statistics),
# so a side is only broadcast when its estimated size is below it.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
}


def sizing(input_bytes: int, total_cores: int, partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Shuffle/scan sizing for an input of ``input_bytes`` on ``total_cores``.

    Shuffle partitions start at about one per ``partition_bytes`` of input
    (never fewer than two per core) so no reducer holds more than it can sort
    in memory; AQE then coalesces small ones and splits skewed ones at
    runtime.  Scan splits stay at 128 MiB.  E.g. 100 TB on 8000 cores gives
    ~400k initial shuffle partitions.
    """
    n = max(2 * total_cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    }


def build_session(master: str = "local[8]", app: str = "tablemove",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint/scratch root, setting a local one only if unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # A driver-local folder is not shared with the executors.
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (HDFS, S3, ABFS, ...)")
        d = tempfile.mkdtemp(prefix="tablemove-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path below the shared root; ``unique`` adds a fresh run-specific folder."""
    root = ensure_checkpoint_dir(spark)
    segs = [root, "tablemove"] + [p.strip("/") for p in parts]
    if unique:
        segs.append(uuid.uuid4().hex[:12])
    return "/".join(segs)


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop FileSystem and Path for ``path`` (works for file:, hdfs:, s3a:, abfs:)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return bool(fs.exists(p))


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return bool(fs.delete(p, True))


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
