"""Spark session settings shared by the library, the tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Engine settings the operators are written for: AQE re-plans joins and
# coalesces shuffle partitions at runtime, skew joins are split, UTC session
# time so timestamps mean the same on every executor and in the oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "vitrine",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared file system and is left alone.
    Only when it is unset (a test on one machine) a scratch folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="vitrine-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read back: as
    ``checkpoint()``, but compressed, and a later step reads the columns it needs."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vitrine-stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input, and of a shuffle, for each task of a shuffle.
TASK_BYTES = 8 << 20


def size_shuffles(spark: SparkSession, sf_dir: str) -> None:
    """Let the number of shuffle tasks grow with the input, so that what one of them sorts or
    groups does not. Adaptive execution merges tasks of small shuffles, up to a size that
    is counted as written: keys of lines take a byte or two each there, and 64 MB of
    them, the usual bound, many times that once read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)  # noqa: SLF001 - Hadoop's file system API
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    size = fs.getContentSummary(path).getLength() if fs.exists(path) else 0
    wanted = -(-size // TASK_BYTES)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    else:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))


def apply_session_defaults(spark: SparkSession) -> None:
    """Runtime SQL settings for a session someone else built."""
    for k in ("spark.sql.adaptive.enabled", "spark.sql.session.timeZone"):
        try:
            spark.conf.set(k, DEFAULT_CONF[k])
        except Exception:  # noqa: BLE001 - static confs cannot change at runtime
            pass

