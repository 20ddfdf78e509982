"""Session defaults. On a cluster the caller's own session is used as is."""

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus="*", shuffle_partitions=8, memory="8g", app="worktrail"):
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def work_dir(spark, name):
    """A fresh folder under the cluster's shared checkpoint folder.

    Only a session on one machine may leave ``spark.checkpoint.dir`` unset and
    use a local folder; on a cluster that would lose each executor's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"worktrail-{name}-")
    return os.path.join(base, f"{name}-{os.urandom(8).hex()}")
