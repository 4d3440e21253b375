"""Incremental ingestion: resumable file streams, windowed counts with late data, bursts, first-wins de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """A stream over the files of a folder, `files` a batch at most."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def ingest(source: DataFrame, target: str, checkpoint: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Take in all that is new and stop. A batch is written to its own folder, which a retry overwrites; rows whose key an
    earlier batch holds are left out, so an interrupted run that is started again ends with what one run would have given."""
    spark = source.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        rows = (transform(batch) if transform else batch).dropDuplicates(keys)
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            old = spark.read.parquet(target).where(F.col("batch") != number)
            rows = rows.join(old.select(*keys), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n) of tumbling or sliding windows; rows later than `late` are dropped."""
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, key, n) of stretches of activity without a pause of `gap`."""
    return events.withWatermark(ts, late).groupBy(F.session_window(F.col(ts), gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_wins(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(result: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Run an append stream over what is there and read what it wrote."""
    result.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(target)
