"""Sampling by time, batch lists, ladders.

Special input: blank lines are no names; with an interval below one nothing is sampled; ties in a bucket take the least
key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def batch_list(lines: DataFrame, line: str = "value") -> DataFrame:
    return lines.select(F.trim(line).alias("name")).filter("name <> ''")


def skip_existing(names: DataFrame, existing: DataFrame, suffix: str = ".jpg", compat: bool = False) -> DataFrame:
    """Names whose output does not exist yet; compat looks for the bare name."""
    key = F.col("name") if compat else F.concat("name", F.lit(suffix))
    return names.withColumn("_out", key).join(existing.select(F.col("name").alias("_out")), "_out", "left_anti").select("name")


def one_per_bucket(events: DataFrame, at: str, key: str, seconds: float, group: list[str] | None = None, within: float | None = None, origin: Column | None = None) -> DataFrame:
    """The first event of every bucket of `seconds`, within the first `within` seconds; bucket is counted from the origin."""
    t = F.unix_micros(F.col(at).cast("timestamp")) / 1e6 - (origin if origin is not None else F.lit(0))
    if seconds <= 0:
        return events.withColumn("bucket", F.lit(0).cast("long")).limit(0)
    kept = events.withColumn("bucket", F.floor(t / seconds).cast("long"))
    if within is not None:
        kept = kept.filter((t >= 0) & (t < within))
    best = kept.groupBy(*(group or []), "bucket").agg(F.min_by(F.struct(*events.columns), F.struct(at, key)).alias("_r"))
    return best.select("bucket", "_r.*")


def collected(frames: DataFrame, file: str, order: str, frame: str) -> DataFrame:
    """file, frames: the sampled frames of a file in order. A file has as many as the sampling window holds."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(frame).alias("f"))))
    return frames.filter(F.col(frame).isNotNull()).groupBy(file).agg(F.transform(listed, lambda x: x["f"]).alias("frames"))


def rounded_interval(seconds: float, digits: int = 2) -> float:
    """The interval that a rate rounded to two digits really has: 1 per 30 s becomes 0.03, one per 33.3 s."""
    rate = round(1 / seconds, digits)
    return 1 / rate if rate else 0.0


def ladder(width: Column, step: int = 20) -> Column:
    """-width, -width + step, ... up to width."""
    return F.when(width >= 0, F.sequence(-width, width, F.lit(step)))
