"""Where intermediate data goes: the shared folder that the cluster names, never a machine's own."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a local session (tests, trials) gets one of
    its own that goes when it ends; on a cluster that is an error."""
    sc = spark.sparkContext
    set_ = sc.getCheckpointDir()
    if set_:
        return set_
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tarkib-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    sc.setCheckpointDir(where)
    return sc.getCheckpointDir() or where
