"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (timestamps are naive in the inputs),
# adaptive execution for runtime broadcast / skew splitting / partition coalescing.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "frauddeck",
              extra: dict | None = None, driver_memory: str = "16g") -> SparkSession:
    """Local session for tests / bench (on a cluster the session comes from the platform)."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**BASE_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions),
                 "spark.driver.memory": driver_memory, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the folder is configured by the operator and points at shared storage;
    in local mode (tests) a fresh scratch folder stands in when it is unset, anywhere else that
    is an error, since executors don't see each other's folders.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="frauddeck-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def stage_root(spark: SparkSession) -> str:
    """Folder for written stage tables: a sibling of the checkpoint folder."""
    return os.path.join(checkpoint_dir(spark).rstrip("/"), "stages")
