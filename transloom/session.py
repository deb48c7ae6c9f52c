"""Session defaults and the few plan helpers every module shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults for a session we build ourselves (tests, bench, local runs). On a
# cluster the submitting job owns the session; we only read its settings.
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # One Arrow batch is one inference batch in the translate stage.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # keyed streams with timers hold their state in RocksDB, outside the JVM's heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "transloom") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it. Where it is unset we create one in local mode only, where driver
    and executors are one process; on a cluster a machine-local folder would be lost to the
    other machines, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="transloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared checkpoint folder.

    Used after paid model calls, so a retried stage never calls the model twice for the
    same rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Besides cutting the lineage this tells the planner the table's size, so that it
    broadcasts a small one and shuffles a large one by itself.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark, path: str) -> bool:
    """Existence check through the cluster's file system (works for any Hadoop URI)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ship_package(spark: SparkSession) -> None:
    """Make ``transloom`` importable in the Python workers before a Python stage runs.

    On a cluster the package is normally installed on the executors or passed with
    ``--py-files``; this covers sessions where it is only on the driver's path. The zip is
    staged on the driver and Spark's file server distributes it (no executor reads a
    driver-local path). Done once per SparkContext.
    """
    sc = spark.sparkContext
    if getattr(sc, "_transloom_shipped", False):
        return
    sc._transloom_shipped = True
    import zipfile

    import transloom
    root = os.path.dirname(os.path.abspath(transloom.__file__))
    stage = tempfile.mkdtemp(prefix="transloom-pkg-")
    path = os.path.join(stage, "transloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _dirs, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
