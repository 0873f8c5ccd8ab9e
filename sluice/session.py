"""What a Spark session needs to run this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package; a cluster gets it with ``--py-files``."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark


def decodes_all_charsets(spark: SparkSession) -> frozenset[str]:
    """Let ``decode`` take all charsets of the JVM and replace what is malformed, where it else fails the job; their names in upper case."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    return _charsets(spark.sparkContext._jvm)


@lru_cache(1)
def _charsets(jvm) -> frozenset[str]:
    known = jvm.java.nio.charset.Charset.availableCharsets()
    own = [c for c in known.values() if c.canEncode() or not c.name().startswith("x-")]
    return frozenset(n.strip().upper() for c in own for n in (c.name(), *c.aliases().toString().strip("[]").split(",")) if n.strip())


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one, but only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which is deleted when the application ends."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(where)
    store.deleteOnExit(where)
    return path
