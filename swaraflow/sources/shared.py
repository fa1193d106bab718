"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a new local folder if all runs on this machine, as in
    tests; on a cluster, where executors would write to their own disks, an error.
    """
    context = spark.sparkContext
    path = context.getConf().get(SETTING) or spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="swaraflow-")
        context.setCheckpointDir(path)
    return path.rstrip("/")
