"""Levelled immutable runs in a folder that outlives the session: tables bucketed and sorted by a key, merged level by level.

A store holds named tables, each a list of runs. A run is written once and never changed. Its buckets are files sorted by
the key, whose row groups carry the least and greatest key: the block fences, by which a look-up of few keys skips blocks.
A batch is shuffled by the key once and merge-joined with every run; the runs are neither shuffled nor sorted again, nor
held in memory. A run's level is the logarithm of its size. When a level holds `fan_out` runs, bucket i of all of them is
merged by one task, without a shuffle, into a larger run, so small runs are never merged with large ones; a run whose
buckets would outgrow `bucket_bytes` gets twice as many, each bucket split in place.

What belongs to the store is what the newest manifest names; it is written under another name and renamed, so a session
that ends in between leaves the store as it was. `RunStore.open` reads it in any later session.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.session import discard, list_names, list_sizes, read_text, settings, write_text


@dataclass(frozen=True)
class Run:
    folder: str
    size: int  # bytes
    buckets: int
    ddl: str


class RunStore:
    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], buckets: int, fan_out: int = 4, bucket_bytes: int = 64 << 20, block_bytes: int = 8 << 20):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.fan_out, self.bucket_bytes, self.block_bytes = fan_out, bucket_bytes, block_bytes
        self.runs: dict[str, list[Run]] = {t: [] for t in keys}
        self.facts: dict = {}
        self.number = 0
        self._registered: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> RunStore:
        """The store as its newest manifest has it."""
        numbers = sorted(n for n in list_names(spark, path) if n.startswith("manifest-") and n.endswith(".json"))
        if not numbers:
            raise FileNotFoundError(f"no manifest in {path}")
        held = json.loads(read_text(spark, f"{path}/{numbers[-1]}"))
        store = cls(spark, path, held["keys"], held["buckets"], held["fan_out"], held["bucket_bytes"], held["block_bytes"])
        store.runs = {t: [Run(**r) for r in runs] for t, runs in held["runs"].items()}
        store.facts, store.number = held["facts"], held["number"]
        return store

    def commit(self, staged: dict[str, Run] | None = None, replaced: dict[str, list[Run]] | None = None, **facts) -> None:
        """Staged runs become part of the store, replaced ones (of the same tables) leave it; all at once."""
        for table, gone in (replaced or {}).items():
            self.runs[table] = [r for r in self.runs[table] if r not in gone]
        for table, run in (staged or {}).items():
            if run.size:
                self.runs[table].append(run)
            else:
                self._drop(run)
        self.facts |= facts
        self.number += 1
        held = {
            "keys": self.keys, "buckets": self.buckets, "fan_out": self.fan_out, "bucket_bytes": self.bucket_bytes, "block_bytes": self.block_bytes,
            "runs": {t: [asdict(r) for r in runs] for t, runs in self.runs.items()}, "facts": self.facts, "number": self.number,
        }
        write_text(self.spark, f"{self.path}/manifest-{self.number:08d}.json", json.dumps(held))
        discard(self.spark, f"{self.path}/manifest-{self.number - 1:08d}.json")
        for gone in (replaced or {}).values():
            for run in gone:
                self._drop(run)

    @contextmanager
    def trusted(self) -> Iterator[None]:
        """Inside, plans use the order of the runs' buckets and read bucket by bucket even where no join asks for it."""
        wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.codegen.useIdInClassName": "false"}
        with settings(self.spark, wanted):
            yield

    def table(self, run: Run) -> DataFrame:
        name = self._registered.get(run.folder)
        if name is None:
            key = run.folder.split("/")[0]
            name = f"run_{uuid.uuid4().hex[:16]}"
            self.spark.sql(
                f"CREATE TABLE {name} ({run.ddl}) USING parquet CLUSTERED BY ({self.keys[key]}) SORTED BY ({self.keys[key]}) INTO {run.buckets} BUCKETS LOCATION '{self.path}/{run.folder}'"
            )
            self._registered[run.folder] = name
        return self.spark.table(name)

    def tables(self, table: str) -> list[DataFrame]:
        return [self.table(r) for r in self.runs[table]]

    def level(self, run: Run) -> int:
        return int(math.log(max(run.size, 1), self.fan_out))

    def _write(self, table: str, rows: DataFrame, buckets: int) -> Run:
        key, folder, name = self.keys[table], f"{table}/{uuid.uuid4().hex[:12]}", f"run_{uuid.uuid4().hex[:16]}"
        (
            rows.write.format("parquet").option("path", f"{self.path}/{folder}").option("parquet.block.size", self.block_bytes)
            .option("parquet.dictionary.page.size", self.block_bytes // 2)  # titles and signatures repeat, hashes don't
            .option(f"parquet.enable.dictionary#{key}", "false").option("parquet.enable.dictionary#ref", "false")
            .bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        )
        self._registered[folder] = name
        size = sum(n for file, n in list_sizes(self.spark, f"{self.path}/{folder}") if file.endswith(".parquet"))
        return Run(folder, size, buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))

    def stage(self, table: str, rows: DataFrame) -> Run:
        """Write rows as a run that belongs to the store once it is committed."""
        return self._write(table, rows.repartition(self.buckets, self.keys[table]), self.buckets)

    def compact(self) -> None:
        """Merge the runs of every level that is full into one."""
        for table in self.keys:
            while True:
                levels: dict[int, list[Run]] = {}
                for r in self.runs[table]:
                    levels.setdefault(self.level(r), []).append(r)
                full = next((runs for _, runs in sorted(levels.items()) if len(runs) >= self.fan_out), None)
                if full is None:
                    break
                size = sum(r.size for r in full)
                alike = {r.buckets for r in full}
                buckets = max(alike)
                while size > buckets * self.bucket_bytes:
                    buckets *= 2
                with self.trusted():
                    if len(alike) == 1:
                        name, merged = self._side_by_side(table, full)
                    else:
                        name, merged = None, reduce(DataFrame.unionByName, map(self.table, full)).repartition(buckets, self.keys[table])
                    run = self._write(table, merged, buckets)
                    if self.table(run).count() != sum(self.table(r).count() for r in full):
                        raise RuntimeError(f"merging {table} has changed the number of rows")
                self.commit({table: run}, {table: full})
                if name:
                    self.spark.sql(f"DROP TABLE {name}")

    def _side_by_side(self, table: str, runs: list[Run]) -> tuple[str, DataFrame]:
        """Runs with equal buckets as partitions of one table: a scan reads bucket i of all of them in one task."""
        name, key = f"runs_{uuid.uuid4().hex[:16]}", self.keys[table]
        self.spark.sql(f"CREATE TABLE {name} ({runs[0].ddl}, run INT) USING parquet PARTITIONED BY (run) CLUSTERED BY ({key}) INTO {runs[0].buckets} BUCKETS LOCATION '{self.path}/{table}'")
        for k, run in enumerate(runs):
            self.spark.sql(f"ALTER TABLE {name} ADD PARTITION (run = {k}) LOCATION '{self.path}/{run.folder}'")
        return name, self.spark.table(name).drop("run")

    def _drop(self, run: Run) -> None:
        name = self._registered.pop(run.folder, None)
        if name:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, f"{self.path}/{run.folder}")

    def close(self) -> None:
        """Forget the tables of this session; the files stay."""
        for name in self._registered.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._registered = {}

    def destroy(self) -> None:
        self.close()
        discard(self.spark, self.path)
