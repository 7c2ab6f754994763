"""Continuous ingest of cell tables by Structured Streaming: clean rows, quarantine, and a row of figures per batch."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import number_strict
from ..sources.tables import digests

CELLS = "dataset_id string, feature_id string, sample_id string, raw string, _corrupt string"


def cells(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A stream of parsed cells; ``ok`` tells whether the number was usable."""
    raw = spark.readStream.schema(CELLS).option("header", True).option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_batch).csv(path)
    value, ok = number_strict(F.col("raw"))
    return raw.withColumn("value", value).withColumn("ok", ok & F.col("_corrupt").isNull())


def _before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """Rows that batches before ``number`` left below ``path``, with their ``batch``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.option("basePath", path).parquet(path).where(F.col("batch") < number)


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, files_per_batch: int = 4, detail: int = 20) -> None:
    """All files now below ``path`` in bounded batches. ``target`` gets /clean and /quarantine (rows), /batches (figures of
    each batch, file and dataset, with the first ``detail`` bad values), /files (bytes and digests of each file of the batch, as
    stored and decompressed), /warnings (distinct bad values that no batch before had) and /totals (rows, bad rows, files
    and distinct warnings of each dataset after the batch).

    A batch is held on disk while it is written, so its files are scanned once. It writes folders of its own number, and reads of
    earlier batches only what has a smaller number; so one that is repeated after a failure replaces what it had written, and
    totals count each batch once.
    """

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        named = batch.withColumn("file_name", F.element_at(F.split("file", "/"), -1)).persist(StorageLevel.DISK_ONLY)
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        put(named.where("ok").drop("_corrupt", "ok", "file"), "clean")
        put(named.where("not ok").drop("file"), "quarantine")
        order = Window.partitionBy("file_name", "dataset_id").orderBy("feature_id", "sample_id", "raw")
        bad = named.where("not ok").withColumn("k", F.row_number().over(order)).where(F.col("k") <= detail)
        few = bad.groupBy("file_name", "dataset_id").agg(F.array_sort(F.collect_set(F.coalesce("raw", F.lit("")))).alias("bad_values"))
        figures = named.groupBy("file_name", "dataset_id").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("ok")).alias("n_bad"))
        put(figures.join(few, ["file_name", "dataset_id"], "left"), "batches")
        paths = [r[0] for r in named.select("file").distinct().collect()]  # at most ``files_per_batch``
        put(digests(session, paths).withColumn("file_name", F.element_at(F.split("file_path", "/"), -1)).drop("file_path"), "files")
        warnings = named.where("not ok").select("dataset_id", F.coalesce("raw", F.lit("")).alias("value")).distinct()
        known = _before(session, f"{target}/warnings", number)
        put(warnings if known is None else warnings.join(known.select("dataset_id", "value").distinct(), ["dataset_id", "value"], "left_anti"), "warnings")
        here = session.read.parquet(f"{target}/batches/batch={number}").select("dataset_id", "n_rows", "n_bad", F.lit(1).cast("long").alias("n_files"), F.lit(0).cast("long").alias("n_warnings"))
        fresh = session.read.parquet(f"{target}/warnings/batch={number}").select("dataset_id", *(F.lit(0).cast("long").alias(c) for c in ("n_rows", "n_bad", "n_files")), F.lit(1).cast("long").alias("n_warnings"))
        parts = here.unionByName(fresh)
        past = _before(session, f"{target}/totals", number)
        if past is not None:
            parts = parts.unionByName(past.join(past.agg(F.max("batch").alias("batch")), "batch").drop("batch"))
        put(parts.groupBy("dataset_id").agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_bad", "n_files", "n_warnings"))), "totals")
        named.unpersist()

    stream = cells(spark, path, files_per_batch).withColumn("file", F.col("_metadata.file_path")).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()


def totals(spark: SparkSession, target: str) -> DataFrame:
    """The totals after the last batch that ``ingest`` wrote."""
    every = spark.read.parquet(f"{target}/totals")
    return every.join(every.agg(F.max("batch").alias("batch")), "batch").drop("batch")


def running_totals(spark: SparkSession, path: str, target: str, checkpoint: str, files_per_batch: int = 4) -> None:
    """Rows and bad rows of each dataset so far, kept by the stream's state (one row per dataset) and written whole to
    ``target`` after every batch."""
    totals = cells(spark, path, files_per_batch).groupBy("dataset_id").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("ok")).alias("n_bad"))
    store = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")
    totals.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
