"""Has this key been seen before?

A log-structured store of key hashes (see sorted_runs): every batch of new keys becomes one immutable run of (hash, key,
first order) in which each bucket is one file sorted by hash, with block fences. A batch is reduced to its distinct keys,
which are shuffled by hash once and merge-joined with every run in one stage; the runs are read in the order they were
written in. A hit counts only if the full key is equal. Keys not found form the next run; full levels are merged bucket by
bucket, so a store of n batches has O(fan_out * log n) runs. The store lives in a folder and can be opened again later.

Memory per task is that of a merge join: one block of each run. Nothing is collected to the driver but counts.

Special input: a null key is never found and never stored; the empty string is a key; of rows with equal ids and keys
none is earlier; a key that a third of all rows hold is one row after the map-side aggregation; an empty batch adds no
run. Other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.llm.sorted_runs import RunStore
from gleanery.session import Scratch, materialize, scratch_path

HASHES = {
    "xxhash64": F.xxhash64,
    # The first 15 hexadecimal digits of the MD5: a hash that other engines have, too.
    "md5": lambda key: F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"),
}


class SeenKeys:
    """A store of keys in the folder `path`. `hash_bits` (multiples of 4 for md5) below the full width shortens the hash."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fan_out: int = 4, hash_name: str = "xxhash64", hash_bits: int | None = None, store: RunStore | None = None):
        self.spark = spark
        self.store = store or RunStore(spark, path, {"keys": "_h"}, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fan_out)
        self.hash_name, self.hash_bits = hash_name, hash_bits
        if store is None:
            self.store.facts = {"hash_name": hash_name, "hash_bits": hash_bits}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SeenKeys:
        """The store that an earlier session has left in the folder."""
        store = RunStore.open(spark, path)
        return cls(spark, path, hash_name=store.facts["hash_name"], hash_bits=store.facts["hash_bits"], store=store)

    def hash_of(self, key: Column) -> Column:
        full = HASHES[self.hash_name](key)
        width = 60 if self.hash_name == "md5" else 64
        return F.shiftrightunsigned(full, width - self.hash_bits) if self.hash_bits and self.hash_bits < width else full

    def distinct_keys(self, batch: DataFrame, key: str, order: str) -> DataFrame:
        """(_h, _key, _first): each key of the batch once, with its least order; combined before the shuffle."""
        return (
            batch.select(F.col(key).cast("string").alias("_key"), F.col(order).alias("_order"))
            .filter(F.col("_key").isNotNull())
            .groupBy("_key")
            .agg(F.min("_order").alias("_first"))
            .select(self.hash_of(F.col("_key")).alias("_h"), "_key", "_first")
        )

    def lookup(self, values: list[str]) -> DataFrame:
        """(_key, _first) of the given few keys that are stored; reads only the blocks whose fences enclose their hashes."""
        asked = self.spark.createDataFrame([(v,) for v in values], "_key string").select(self.hash_of(F.col("_key")).alias("_h"))
        hashes = [r[0] for r in asked.collect()]
        found = self.spark.createDataFrame([], "_key string, _first long")
        for run in self.store.tables("keys"):
            found = found.unionByName(run.filter(F.col("_h").isin(hashes) & F.col("_key").isin(values)).select("_key", "_first"))
        return found

    def add(self, batch: DataFrame, key: str, order: str, scratch: Scratch) -> DataFrame:
        """Look up all keys of the batch, store the new ones. Returns the batch's distinct keys (_first, _same, _hash_only):
        `_same` is the order of the earlier equal key, `_hash_only` says that the hash alone would have called a new key
        seen."""
        fresh = self.distinct_keys(batch, key, order)
        none = F.lit(None).cast(fresh.schema["_first"].dataType)
        if not self.store.runs["keys"]:
            run = self.store.stage("keys", fresh)
            self.store.commit({"keys": run})
            new = self.store.tables("keys")[0] if run.size else fresh.limit(0)
            return new.select("_first", none.alias("_same"), F.lit(False).alias("_hash_only"))
        with self.store.trusted():
            equal = F.when(F.col("_key") == F.col("_stored"), F.col("_was"))
            runs = [r.select("_h", F.col("_key").alias("stored"), F.col("_first").alias("was")) for r in self.store.tables("keys")]
            keys = fresh.repartition(self.store.buckets, "_h").withColumns({"_same": none, "_other": F.lit(False)})
            for run in runs:
                keys = keys.hint("merge").join(run.select("_h", F.col("stored").alias("_stored"), F.col("was").alias("_was")).hint("merge"), "_h", "left")
                other = F.col("_other") | F.coalesce(F.col("_key") != F.col("_stored"), F.lit(False))
                keys = keys.select("_h", "_key", "_first", F.coalesce("_same", equal).alias("_same"), other.alias("_other"))
            # Where stored keys share a hash, a key has come out once for each of them.
            keys = keys.groupBy("_h", "_key", "_first").agg(F.min("_same").alias("_same"), F.max("_other").alias("_other"))
            checked = scratch.keep(keys.select("_h", "_key", "_first", "_same", (F.col("_same").isNull() & F.col("_other")).alias("_hash_only")), "probed")
        run = self.store.stage("keys", checked.filter(F.col("_same").isNull()).select("_h", "_key", "_first"))
        self.store.commit({"keys": run})
        return checked


def epochs(df: DataFrame, order: str, count: int) -> list[Column]:
    """Predicates that cut df into `count` consecutive ranges of order."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return []
    width = max(1, -(-(high - low + 1) // count))
    return [(F.col(order) >= low + i * width) & (F.col(order) < low + (i + 1) * width) for i in range(count) if low + i * width <= high]


def replay(df: DataFrame, key: str, order: str, batches: int = 6, fan_out: int = 3, path: str | None = None, report: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Feed df to a new store in `batches` consecutive ranges of order. The store stays in `path`, or is removed if none is
    given.

    Returns (order of every row whose key a row of smaller order has; per batch: keys, keys_seen, hash_only_wrong, if asked
    for). Both are tables, written batch by batch.
    """
    spark = df.sparkSession
    store = SeenKeys(spark, path or scratch_path(spark, "seen"), fan_out=fan_out, **options)
    answers, reports = None, []
    parts = epochs(df, order, batches)
    for i, part in enumerate(parts):
        batch = df.filter(part)
        with Scratch(spark) as scratch:
            keys = store.add(batch, key, order, scratch)
            first = keys.filter(F.col("_same").isNull()).select(F.col("_first").alias(order))
            again = materialize(batch.filter(F.col(key).isNotNull()).select(order).join(first, order, "left_anti"), "again")
            if report:
                counts = keys.agg(F.count("*"), F.count("_same"), F.coalesce(F.sum(F.col("_hash_only").cast("long")), F.lit(0)))
                reports.append((i, *counts.first()))
        answers = again if answers is None else answers.unionByName(again)
        if i + 1 < len(parts):
            store.store.compact()
    (store.store.close if path else store.store.destroy)()
    return (
        answers if answers is not None else df.select(order).limit(0),
        spark.createDataFrame(reports, "batch int, keys long, keys_seen long, hash_only_wrong long"),
    )


def seen_before(df: DataFrame, key: str, order: str, **options) -> DataFrame:
    """The order of every row whose key equals, byte for byte, that of a row of smaller order."""
    return replay(df, key, order, **options)[0]


def error_rate(df: DataFrame, key: str, order: str, hash_bits: int = 32, batches: int = 6, **options) -> DataFrame:
    """Per batch: how many keys, how many seen before, how often a hash of hash_bits alone would have been wrong and that
    rate; and the rows answered wrongly in the end, counted against an exact first occurrence of every key."""
    answers, reports = replay(df, key, order, hash_bits=hash_bits, batches=batches, report=True, **options)
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order)).select(order, F.lit(1).alias("_new"))
    said = answers.select(order, F.lit(1).alias("_said"))
    parts = epochs(df, order, batches)
    number = F.coalesce(*[F.when(p, F.lit(i)) for i, p in enumerate(parts)], F.lit(0))
    audit = (
        df.filter(F.col(key).isNotNull()).select(order).join(first, order, "left").join(said, order, "left").withColumn("batch", number)
        .groupBy("batch").agg(F.count("*").alias("rows"), F.sum((F.col("_new").isNull() != F.col("_said").isNotNull()).cast("long")).alias("wrong_answers"))
    )
    rate = F.col("hash_only_wrong") / F.greatest(F.col("keys"), F.lit(1))
    return reports.join(audit, "batch", "left").select(
        "batch", "rows", "keys", "keys_seen", "hash_only_wrong", rate.alias("rate_hash_only"), "wrong_answers", (F.col("wrong_answers") / F.col("rows")).alias("rate_wrong")
    )
