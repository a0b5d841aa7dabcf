"""The session that tests, the bench and scripts share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cores: int | None = None, **settings: str) -> SparkSession:
    """A local session; on a cluster pass the running session to the operators instead."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cores}]").appName("perambula")
    for key, value in {**SETTINGS, "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": str(cores), **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that all executors share and that goes when the driver ends: in spark.checkpoint.dir, or in a local session's own folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="perambula-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    path = f"{root.rstrip('/')}/perambula/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(_delete, at.getFileSystem(spark._jsc.hadoopConfiguration()), at)
    return path


def _delete(files, path) -> None:
    try:
        files.delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass
