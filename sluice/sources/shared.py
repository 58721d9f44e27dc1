"""The folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}
_MADE: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, deleted when its driver ends; or, where that is unset and Spark runs in one process (as in tests), a temporary folder of this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        app = spark.sparkContext.applicationId
        own = f"{path.rstrip('/')}/sluice-{app}"
        if own not in _MADE:
            at = spark._jvm.org.apache.hadoop.fs.Path(own)
            fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
            fs.mkdirs(at)
            fs.deleteOnExit(at)
            _MADE.add(own)
        return own
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="sluice-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]
