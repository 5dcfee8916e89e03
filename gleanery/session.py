"""Sessions, the shared folder, and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "gleanery", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where the session names none (tests, local mode) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="gleanery-")  # one machine only: the executors of local mode are threads of the driver
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gleanery/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write df once into the shared folder and read it back: later uses share one computation, lineage is cut,
    and the result outlives the executors that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of Hadoop, so that files can be handled under any scheme."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path."""
    system, target = file_system(spark, path)
    system.delete(target, True)


def list_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of what a folder holds; nothing if there is no such folder."""
    system, target = file_system(spark, path)
    return [(s.getPath().getName(), s.getLen()) for s in system.listStatus(target)] if system.exists(target) else []


def list_names(spark: SparkSession, path: str) -> list[str]:
    return [name for name, _ in list_sizes(spark, path)]


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def interpreted(spark: SparkSession):
    """For many short plans over few rows: compiling their code costs more than it saves, and drives the code of the long
    ones out of the executors' caches (100 entries)."""
    return settings(spark, {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})


def read_text(spark: SparkSession, path: str) -> str:
    system, target = file_system(spark, path)
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all: under another name first, then renamed."""
    system, target = file_system(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    stream = system.create(part, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    system.rename(part, target)


class Scratch:
    """Lineage cuts that are only needed for a while: `keep` writes and reads back like `materialize`, leaving the block
    removes the files and lets Spark drop the shuffle files of what went out of use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        self.paths.append(path)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            discard(self.spark, path)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Shuffle files stay until the driver collects the garbage that refers to them; between the steps of a long job that
    should not wait for a full heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything this library has written into the shared folder."""
    discard(spark, f"{shared_dir(spark)}/gleanery")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
