"""Sources and sinks: text lines, whole binaries and chunks of them, configuration, JSON, staged feeds, record tables."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

SUBSCRIPTION = "name string, time date, url string, on_air_range string, exclude string, include string"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line; without an order, as lines of a splittable source."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text: one row per file, for listings whose lines belong together."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """file, length, content; at most 2 GB a file."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")


def binary_chunks(spark: SparkSession, path: str, size: int = 64 << 20) -> DataFrame:
    """path, chunk_no, content: files of any size on a file system that all workers mount, read piece by piece."""
    listed = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:", "").alias("path"), "length")
    pieces = listed.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)))).alias("chunk_no"))

    def read(batches):
        for pdf in batches:
            content = []
            for p, n in zip(pdf["path"], pdf["chunk_no"]):
                with open(p, "rb") as file:
                    file.seek(int(n) * size)
                    content.append(file.read(size))
            yield pdf.assign(content=content)

    return pieces.repartition(spark.sparkContext.defaultParallelism, "path", "chunk_no").mapInPandas(read, "path string, chunk_no long, content binary")


def configuration(path: str | Path) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def subscriptions(spark: SparkSession, config: dict) -> DataFrame:
    """The subscriptions of a configuration, urls with shortcuts expanded."""
    from gleanery.operators.feeds import expand_shortcuts

    rows = [tuple(None if s.get(k) is None else s[k] if k == "time" else str(s[k]) for k in ("name", "time", "url", "on_air_range", "exclude", "include")) for s in config.get("subscribes", [])]
    shortcuts = [(s["name"], s["alias"]) for s in config.get("shortcuts", [])]
    return spark.createDataFrame(rows, SUBSCRIPTION).withColumn("url", expand_shortcuts(F.col("url"), shortcuts))


def variables(spark: SparkSession, config: dict) -> DataFrame:
    """One row: the variables of a configuration as a map."""
    return spark.createDataFrame([(config.get("var", {}),)], "variables map<string,string>")


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    return whole_texts(spark, path)


FEED = "id string, link array<struct<_href:string,_type:string>>"


def staged_feed(spark: SparkSession, path: str, row_tag: str = "entry") -> DataFrame:
    """id, links array<struct<type,href>> of feed files that were fetched and staged."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(FEED).load(path)
    return raw.select("id", F.transform("link", lambda x: F.struct(x["_type"].alias("type"), x["_href"].alias("href"))).alias("links"))


def write_record(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append to a record table."""
    writer = rows.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read_record(spark: SparkSession, path: str, schema: str = "torrent_name string, torrent_url string") -> DataFrame:
    """A record table; empty if nothing was recorded yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def write_files(rows: DataFrame, name: str, content: str, folder: str) -> None:
    """One file per row, written where the rows are, into a folder that all workers mount."""

    def save(batch):
        for r in batch:
            target = Path(folder) / Path(r[0]).name
            part = target.with_name(target.name + ".part")
            part.write_bytes(bytes(r[1]))
            part.rename(target)

    rows.select(name, content).foreachPartition(save)
