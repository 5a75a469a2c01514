"""Tables written below the folder that driver and executors share."""

from __future__ import annotations

import copy
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset in a local session, as in tests, a temporary folder takes its place, for this
    session alone. On a cluster no folder of the driver's would do, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="urbanflow-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, never broadcast.

    Ids, pointers and cells pack into few bytes on disk, and by file size alone Spark takes millions of
    such rows for a small table and builds it on the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt over as many partitions as the session shuffles to, for rows that cost much work each.

    Small files are read by few tasks, and the number is given, as otherwise Spark would merge small partitions again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Scratch:
    """Tables and files that one operator run writes below the shared folder.

    A written table cuts the lineage and outlives a lost executor. ``drop`` removes them all; call it
    once the operator's result has itself been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.places: dict[str, str] = {}
        self.merge = False

    def merged(self) -> Scratch:
        """The same folder for tables that grow with the input: joins with them are merged, as with ``large``."""
        same = copy.copy(self)
        same.merge = True
        return same

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df`` as zstd Parquet and read it back; a name that is used again gets a place of its own.

        With ``by``, each value of that column gets a folder, and a filter on it reads no other.
        """
        path = self.path(f"{name}.{len(self.places)}" if name in self.places else name)
        self.places[path] = self.places[name] = path
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
        back = self.spark.read.schema(df.schema).parquet(path)
        return large(back) if self.merge else back

    def drop(self, name: str | None = None) -> None:
        place = self.places.get(name, self.path(name)) if name else self.root
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def settle(self, *names: str) -> None:
        """Drop tables that are read no more, and let the driver collect its garbage.

        Shuffle files of jobs that are done stay on the executors' disks until the driver has forgotten those jobs.
        """
        for name in names:
            self.drop(name)
        self.spark._jvm.System.gc()
