"""Session and table access shared by every plan."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sondhan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SONDHAN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; only where it is unset and all
    tasks run in this process (tests, single machine) set a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sondhan-ckpt-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives the loss of executors).

    The optimiser's size estimate is cut too.  Spark carries the estimate of the plan over to its checkpoint and
    takes the product of both sides for a join, so over rounds of joins the number itself gets
    twice as many digits (or more) a round, until the driver has no room for it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return type(df)(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().analyzed().rdd(), kept.schema(), False), spark)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, removed at the end."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/folder-{uuid.uuid4().hex}"
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(lambda: _forget(spark, gone))
    return path


def materialise(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Like ``checkpoint`` it cuts lineage and survives lost executors; the columnar,
    compressed table is a fraction of the size, and each reader takes only its columns.  ``by``: columns that partition the table.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    jvm = spark._jvm
    gone = jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(lambda: _forget(spark, gone))
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path) -> None:
    try:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is already gone: the cluster clears its folder
        return


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give CPU-heavy per-row work enough tasks when the input is one small file.

    Only inputs with fewer splits than the cluster has cores are repartitioned,
    so large tables keep their file splits and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * per_core)
    return df
