"""Session helpers shared by the operators: inputs, scratch tables, Arrow batch limits.

Scratch tables live under the folder named by ``spark.checkpoint.dir``, which a cluster shares between the driver
and all executors; a folder is made up only on one machine where the session names none.  Each scope has a
folder of its own and deletes nothing else.  One that nobody closes is deleted when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir, ship

#: Rows and bytes that one Arrow batch may carry to a Python worker, so that very long texts don't pile up.
BATCH_ROWS = 512
BATCH_BYTES = "2m"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and let Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """The scratch tables of one piece of work; ``close`` deletes them, once what reads them has been written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.made = False

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self) -> str:
        """A place for a new table."""
        if not self.made:
            where, store = self._at(self.folder)
            store.mkdirs(where)
            store.deleteOnExit(where)
            self.made = True
        return f"{self.folder}/table-{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back, which cuts its lineage."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scope that nothing will read again."""
        where, store = self._at(df._scratch_path)
        store.delete(where, True)

    def close(self) -> None:
        if self.made:
            where, store = self._at(self.folder)
            store.delete(where, True)
            store.cancelDeleteOnExit(where)
            self.made = False

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def finished(result: DataFrame, scratch: Scratch, keep: Scratch | None = None) -> DataFrame:
    """``result``, whose rows are small, from a table of ``keep`` or a scope of its own; all that it was made from is deleted."""
    out = (keep or Scratch(result.sparkSession)).table(result)
    scratch.close()
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
