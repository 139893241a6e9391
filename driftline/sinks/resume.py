"""Saved uploads: a table in a folder, one file a state under its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.reliability import stale_states, state_key, valid_states
from driftline.schema import RESUME


class Uploads:
    """The states of uploads that are under way. A state is keyed by its local and remote path."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, states: DataFrame) -> None:
        """Adds states (RESUME); one of the same key is replaced."""
        keyed = states.withColumn("key", state_key(F.col("local_path"), F.col("remote_path")))
        keyed.repartition("key").write.mode("overwrite").partitionBy("key").option("partitionOverwriteMode", "dynamic").parquet(self.folder)

    def pending(self) -> DataFrame:
        """All states, with their keys; a folder that is not there has none."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        schema = f"{RESUME}, key string"
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder)

    def load(self, local: DataFrame) -> DataFrame:
        """The states whose local file is as it was, by an inventory of the local side; the others are removed."""
        known = valid_states(self.pending(), local)
        self.remove(known.where("NOT valid"))
        return valid_states(self.pending(), local).where("valid").drop("valid")

    def clean_up(self, now: int, max_age: int) -> int:
        """Removes the states that began more than max_age seconds before now; how many."""
        return self.remove(stale_states(self.pending(), now, max_age))

    def remove(self, states: DataFrame) -> int:
        """Removes states (key); how many. Keys come one by one, whatever their number."""
        path, n = self.spark._jvm.org.apache.hadoop.fs.Path, 0
        system = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for row in states.select("key").distinct().toLocalIterator():
            n += bool(system.delete(path(f"{self.folder}/key={row['key']}"), True))
        return n
