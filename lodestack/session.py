"""Session set-up and the shared folder that checkpoints and scratch tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestack")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only when running locally without the setting."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="lodestack-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


_PATHS: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _PATHS.append(f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables that this process has made. Results that still read them must be written before."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _PATHS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, so that later passes do not recompute."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
