"""Extension: a plan kept up to date while inventory rows arrive.

Rows of the source's inventory arrive as files of a stream. Each micro-batch is reduced to the newest
row a path and compared with the destination; its actions are appended under the batch's number, so a
batch that runs again after a failure replaces its own rows and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from driftline.config import Options
from driftline.operators.diff import diff, one_row_a_path
from driftline.operators.plan import estimated
from driftline.schema import INVENTORY


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(INVENTORY).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def plan_arrivals(rows: DataFrame, dest: DataFrame, out: str, checkpoint: str, o: Options | None = None) -> StreamingQuery:
    """Writes the actions of each batch to out/batch=<number>; deletes are not decided on a part of the source."""
    from dataclasses import replace

    options = replace(o or Options(), delete=False)

    def act(batch: DataFrame, number: int) -> None:
        estimated(diff(one_row_a_path(batch), dest, options)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throughput(events: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Transfers (ts, bytes) per window of event time, with late rows admitted up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).select(F.col("window.start").alias("start"), "n", "bytes")
