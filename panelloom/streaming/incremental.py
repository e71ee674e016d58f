"""New daily bars as a stream: affected symbols are summarised anew, batch by batch."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.bars import daily_returns, monthly_summary

#: Folders that symbols are dealt to; a batch reads those of the symbols it touches.
BUCKETS = 64
#: Bars that a task sorts, about; whole symbols lie in one.
TASK_ROWS = 250_000


def maintain_monthly(stream: DataFrame, store: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep store/bars (every bar, by bucket of symbols) and store/monthly/<batch> up to date.

    Of a symbol and date the first batch's bar counts, and in one batch the one with the
    least price and volume, as rows of a batch have no order. A batch rewrites nothing that
    it reads: each one's summary of the symbols it touched is a folder of its own, and
    latest_monthly takes each symbol's newest. A batch that is run again overwrites its own.
    """
    bucket = F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/bars/batch={number}")
        own = spark.read.parquet(f"{store}/bars/batch={number}")
        there = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # BUCKETS at most
        stored = spark.read.parquet(f"{store}/bars").filter(F.col("bucket").isin(there) & (F.col("batch") <= number) & F.col("symbol").isNotNull())
        # Tasks by the number of bars rather than the session's: what one of them sorts doesn't grow with the table.
        stored = stored.repartition(stored.count() // TASK_ROWS + 1, "symbol")
        first = stored.groupBy("symbol", "date").agg(F.min(F.struct("batch", "price", "volume")).alias("b"), F.max("batch").alias("_last"))
        first = first.withColumn("_last", F.max("_last").over(W.partitionBy("symbol"))).filter(F.col("_last") == number)  # symbols that this batch touched
        monthly_summary(daily_returns(first.select("symbol", "date", "b.price", "b.volume"))).write.mode("overwrite").parquet(f"{store}/monthly/batch={number}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where all run on this machine."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(shared or tempfile.mkdtemp(prefix='panelloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch
        pass


def latest_monthly(spark: SparkSession, store: str) -> DataFrame:
    rows = spark.read.parquet(f"{store}/monthly")
    newest = rows.groupBy("symbol").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["symbol", "batch"]).drop("batch")
