"""Chart files that arrive one after another, kept in a table that a stream brings up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship
from ..sources import keyed


def keep_charts(spark: SparkSession, folder: str, schema: str, path: str, keys: list[str], progress: str, least: int = 10) -> None:
    """Merge the CSV files of folder that weren't read yet into the keyed table at path: their columns and the date that their names hold.

    Files are told by the stream's progress folder, so a run reads only new ones, however many runs there were; a run that ended amid a batch does that
    batch again under the same name, which the table passes over if it had been merged. keys: columns that make a row with its
    date; a file that comes again for a date takes the place of those rows. Files with fewer than least rows whose first column can be read (pages of
    HTML, say) and files without a date are passed over.
    """
    ship(spark)
    first = StructType.fromDDL(schema).names[0]
    rows = spark.readStream.schema(schema).option("header", True).csv(folder).withColumn("_file", F.col("_metadata.file_path"))
    rows = rows.withColumn("_at", F.col("_metadata.file_modification_time"))

    def merge(batch: DataFrame, number: int) -> None:
        good = batch.where(F.col(first).isNotNull())
        sizes = good.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
        dated = good.join(sizes, "_file", "left_semi").withColumn("date", F.regexp_extract("_file", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1).try_cast("date"))
        keyed.change(dated.drop("_file"), path, ["date", *keys], keyed.latest(["_at"]), f"batch {number}", by=["date"])

    stream = rows.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start()
    stream.awaitTermination()


def charts(spark: SparkSession, path: str) -> DataFrame:
    """All charts that keep_charts has merged into the table at path."""
    return keyed.read(spark, path).drop("_at")
