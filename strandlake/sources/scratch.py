"""Fresh folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[str] = []
_local: dict[str, str] = {}


def scratch(spark: SparkSession, purpose: str) -> str:
    """Below ``spark.checkpoint.dir`` where it is set; on a single machine without it, a temporary folder until the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="strandlake-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        base = _local[app]
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    _made.append(f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Removes all that this process wrote below folders from ``scratch``; results that read it must have been written."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(f"{_made.pop()}*")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.globStatus(path) or []:
            fs.delete(found.getPath(), True)
