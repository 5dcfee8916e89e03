"""Irregular readings onto a regular grid.

Readings are first reduced to occupied slots (a partial aggregation: a source has at most one row per slot, however many
readings), then to one row per source and day. Gaps are found between the days of a source, and every day unfolds its own
missing slots, so no task holds a source's series and no slot list is longer than a day.

Missing slots are filled by a low-rank factorisation of the source-by-time matrix (alternating least squares, Spark's
distributed one) of the deviations from each source's mean; observed cells stay exact, and a cell whose row or column has
too little support stays marked. The matrix has columns of `column_minutes`, whatever a source's pace: all missing slots of a
source in one column get the same filled value.

Special input: a null value, time or source is no reading; a source without a pace (`every` null or below 1) has no grid;
equal readings share their slot; with an empty table the grid is empty; when there is nothing to factorise, all missing
cells stay marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleanery.operators.joins import numbered
from gleanery.session import materialize

MINUTES = 1440


def occupied_slots(readings: DataFrame, sources: DataFrame) -> DataFrame:
    """source, day, minute (of the slot's start), value (mean), first_t, last_t; readings: source, at, value; sources:
    source, every (minutes)."""
    paced = sources.filter(F.col("every") >= 1).select("source", "every").dropDuplicates(["source"])
    t = F.unix_seconds("at")
    return (
        readings.filter(F.col("value").isNotNull() & F.col("at").isNotNull())
        .select("source", t.alias("t"), "value")
        .join(paced, "source")
        .withColumn("day", F.floor(F.col("t") / 86400).cast("int"))
        .withColumn("minute", (F.floor(F.pmod("t", F.lit(86400)) / 60 / F.col("every")) * F.col("every")).cast("int"))
        .groupBy("source", "every", "day", "minute")
        .agg(F.avg("value").alias("value"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    )


def missing_slots(slots: DataFrame, closure_days: int = 30) -> DataFrame:
    """source, every, day, minute of the slots without a reading between a source's first and last reading, without the
    slots of closures (`closure_days` or more between two readings)."""
    days = slots.groupBy("source", "every", "day").agg(
        F.sort_array(F.collect_list(F.struct("minute", "first_t", "last_t"))).alias("held")  # at most a day's slots
    )
    first, last = F.col("held")[0], F.element_at("held", -1)
    w = W.partitionBy("source").orderBy("day")  # one row per day
    days = days.withColumns(
        {
            "prev_day": F.lag("day").over(w),
            "gap": first["first_t"] - F.lag(last["last_t"]).over(w),
            "prev_minute": F.lag(last["minute"]).over(w),
        }
    )
    every = F.col("every")
    open_gap = F.coalesce(F.col("gap") < closure_days * 86400, F.lit(False))
    full = lambda low, high: F.when(high >= low, F.sequence(low, high, every)).otherwise(F.array().cast("array<int>"))
    inside = F.array_except(full(first["minute"], last["minute"]), F.transform("held", lambda x: x["minute"]))
    same_day = days.select("source", "every", "day", F.explode(inside).alias("minute"))
    # Between the last slot of the day before and the first of this day: rest of that day, whole days, start of this day.
    last_minute = F.floor((MINUTES - 1) / every).cast("int") * every
    gaps = days.filter(open_gap)
    rest = gaps.select("source", "every", F.col("prev_day").alias("day"), F.explode(full(F.col("prev_minute") + every, last_minute)).alias("minute"))
    start = gaps.select("source", "every", "day", F.explode(full(F.lit(0), first["minute"] - every)).alias("minute"))
    between = gaps.filter(F.col("day") - F.col("prev_day") > 1).select(
        "source", "every", F.explode(F.sequence(F.col("prev_day") + 1, F.col("day") - 1)).alias("day")  # fewer than closure_days
    )
    whole = between.select("source", "every", "day", F.explode(full(F.lit(0), last_minute)).alias("minute"))
    return same_day.unionByName(rest).unionByName(start).unionByName(whole)


def slot_time(day: Column, minute: Column) -> Column:
    return F.timestamp_seconds(day.cast("long") * 86400 + minute.cast("long") * 60)


def factorise(slots: DataFrame, missing: DataFrame, column_minutes: int, rank: int, iterations: int, regularisation: float, bound: float, support: int) -> DataFrame:
    """missing with `filled`: the product of the factors plus the source's mean, null where unsupported."""
    from pyspark.ml.recommendation import ALS

    column = lambda: F.floor((F.col("day").cast("long") * MINUTES + F.col("minute")) / column_minutes).cast("int")
    plausible = slots.filter(F.abs("value") <= bound)
    means = plausible.groupBy("source").agg(F.avg("value").alias("mean"), F.count("*").alias("held"))
    ids = materialize(numbered(means, "source", "row"), "sources")
    cells = materialize(
        plausible.join(ids, "source").groupBy("row", column().alias("column")).agg(F.avg(F.col("value") - F.col("mean")).cast("float").alias("cell")), "cells"
    )
    model = ALS(
        rank=rank, maxIter=iterations, regParam=regularisation, userCol="column", itemCol="row", ratingCol="cell", coldStartStrategy="nan", seed=7, checkpointInterval=-1
    ).fit(cells)
    columns = cells.groupBy("column").agg(F.count("*").alias("beside"))
    asked = missing.join(ids, "source", "left").withColumn("column", column()).join(columns, "column", "left")
    rows = model.itemFactors.select(F.col("id").alias("row"), F.col("features").alias("u"))
    cols = model.userFactors.select(F.col("id").alias("column"), F.col("features").alias("v"))
    product = F.aggregate(F.zip_with("u", "v", lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    enough = (F.col("held") >= support) & (F.col("beside") >= 2)
    return (
        asked.join(rows, "row", "left").join(cols, "column", "left")
        .select("source", "every", "day", "minute", F.when(enough, F.col("mean") + product).alias("filled"))
    )


def regular_grid(
    readings: DataFrame,
    sources: DataFrame,
    closure_days: int = 30,
    column_minutes: int = 60,
    rank: int = 3,
    iterations: int = 8,
    regularisation: float = 0.05,
    bound: float = 60.0,
    support: int = 12,
) -> DataFrame:
    """source, slot (timestamp), value, status: `observed` (mean of the slot's readings), `filled` or `missing` (null)."""
    slots = materialize(occupied_slots(readings, sources), "slots")
    missing = materialize(missing_slots(slots, closure_days), "missing")
    if slots.filter(F.abs("value") <= bound).isEmpty():
        filled = missing.withColumn("filled", F.lit(None).cast("double"))
    else:
        filled = factorise(slots, missing, column_minutes, rank, iterations, regularisation, bound, support)
    seen = slots.select("source", slot_time(F.col("day"), F.col("minute")).alias("slot"), "value", F.lit("observed").alias("status"))
    return seen.unionByName(
        filled.select(
            "source", slot_time(F.col("day"), F.col("minute")).alias("slot"), F.col("filled").alias("value"), F.when(F.col("filled").isNull(), "missing").otherwise("filled").alias("status")
        )
    )


def held_out_error(readings: DataFrame, sources: DataFrame, one_in: int = 20, **options) -> DataFrame:
    """cells, filled, error, error_of_mean: one slot in `one_in` (by its hash) is held back; the mean absolute error of the
    filled values there, and that of each source's mean in their place."""
    slots = materialize(occupied_slots(readings, sources).filter(F.abs("value") <= options.get("bound", 60.0)), "slots")
    at = slots.select("source", slot_time(F.col("day"), F.col("minute")).alias("slot"), "value")
    held = F.pmod(F.xxhash64("source", "slot"), F.lit(one_in)) == 0
    kept = at.filter(~held)
    grid = regular_grid(kept.withColumnRenamed("slot", "at"), sources, **options).filter("status = 'filled'").select("source", "slot", F.col("value").alias("guess"))
    means = kept.groupBy("source").agg(F.avg("value").alias("mean"))
    judged = at.filter(held).join(grid, ["source", "slot"], "left").join(means, "source", "left")
    return judged.agg(
        F.count("*").alias("cells"), F.count("guess").alias("filled"), F.avg(F.abs(F.col("value") - F.col("guess"))).alias("error"),
        F.avg(F.when(F.col("guess").isNotNull(), F.abs(F.col("value") - F.col("mean")))).alias("error_of_mean"),
    )
