"""Writers: compressed Parquet, sorted lookups whose row groups prune, positional JSON and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch


def parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def dump(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated without header or quotes, \\N for null, as readers.dump reads it; texts must hold no tabs or line ends."""
    df.write.mode(mode).csv(path, sep="\t", header=False, quote="", escape="", nullValue="\\N", emptyValue="")


def lookup(df: DataFrame, path: str, keys: list[str], partitions: int | None = None, group_bytes: int = 1 << 20) -> None:
    """Range-partitioned and sorted by keys in small row groups, so that point and prefix filters read little."""
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", group_bytes).parquet(path)


def positional_json(df: DataFrame, order: list[str]) -> DataFrame:
    """One row json: the field names, the rows as arrays in order, and their number. For small result tables only."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.array(*(F.col(c).cast("string") for c in df.columns)).alias("_row"))))
    body = F.struct(F.array(*map(F.lit, df.columns)).alias("fields"), F.transform(rows, lambda r: r["_row"]).alias("rows"), F.count(F.lit(1)).alias("n"))
    return df.agg(F.to_json(body).alias("json"))


def manifest_json(manifest: DataFrame) -> DataFrame:
    """One row json for a one-row manifest."""
    return manifest.select(F.to_json(F.struct(*manifest.columns)).alias("json"))


def dated_csv(df: DataFrame, date: str, path: str) -> None:
    """A CSV file with header for each value of a date column, under its name, as charts come; a file that is there already stays. The dates are few."""
    spark = df.sparkSession
    with scratch(spark, "dated") as at:
        df.withColumn("_date", F.col(date).cast("string")).drop(date).repartition("_date").write.option("header", True).partitionBy("_date").csv(f"{at}/all")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(at).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(hadoop(path))
        for folder in fs.globStatus(hadoop(f"{at}/all/_date=*")):
            day = folder.getPath().getName().partition("=")[2]
            for i, part in enumerate(fs.globStatus(hadoop(f"{folder.getPath()}/part-*"))):
                fs.rename(part.getPath(), hadoop(f"{path}/charts-{day}.csv" if not i else f"{path}/charts-{i}-{day}.csv"))
