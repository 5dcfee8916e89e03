"""Joins by order and by range, that stay distributed whatever the distribution of the keys.

As-of: both sides are cut into cells of the ordering value; what a cell inherits from the cells before it is found over one
row per cell, so no task holds a whole key. Containment and point-in-range: intervals are cut into cells of a given width
and joined on the cell. Zip: rows are numbered range by range.

Special input: null values match nothing; ties on the ordering value of the right side take the greatest payload; an empty
side gives the defaults; clashing column names are avoided by returning the named columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleanery.session import materialize


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, value: str, by: list[str] | None = None, width: int = 1 << 20, into: str = "found", default=None) -> DataFrame:
    """left with `into`: `value` of the right row with the greatest right_on <= left_on (and equal `by`), else default."""
    by = by or []
    cell = lambda c: F.floor(F.col(c).cast("double") / width).cast("long")
    r = right.select(*by, F.col(right_on).alias("_v"), F.col(value).alias("_p")).filter(F.col("_v").isNotNull()).withColumn("_cell", cell("_v"))
    l = left.withColumn("_v", F.col(left_on)).withColumn("_cell", cell("_v"))
    latest = r.groupBy(*by, "_cell").agg(F.max_by("_p", F.struct("_v", "_p")).alias("_last"), F.lit(True).alias("_has"))
    cells = latest.unionByName(l.select(*by, "_cell").filter(F.col("_cell").isNotNull()).distinct(), allowMissingColumns=True).groupBy(*by, "_cell").agg(F.first("_last", True).alias("_last"))
    if by:
        earlier = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
        inherited = cells.select(*by, "_cell", F.last("_last", True).over(earlier).alias("_before"))
    else:
        inherited = _last_before(cells)
    both = l.withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    inside = W.partitionBy(*by, "_cell").orderBy("_v", "_side", F.col("_p").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    got = both.withColumn("_in", F.last("_p", True).over(inside)).filter("_side = 1")
    found = got.join(inherited, [*by, "_cell"], "left")
    out = F.coalesce("_in", "_before") if default is None else F.coalesce("_in", "_before", F.lit(default))
    return found.select(*left.columns, F.when(F.col("_v").isNotNull(), out).alias(into))


def _cells(low: Column, high: Column, width: float) -> Column:
    """(size, cell) of the cells that an interval covers, in the least of the sizes width * 16^k in which they are at most 17,
    so that a long interval is a few large cells."""
    long = (F.greatest(high - low, F.lit(0)).cast("double") / width / 16).cast("double")
    size = F.greatest(F.ceil(F.log(16.0, F.greatest(long, F.lit(1.0))) - 1e-9), F.lit(0)).cast("int")
    edge = F.pow(F.lit(16.0), size) * width
    return F.transform(F.sequence(F.floor(low.cast("double") / edge).cast("long"), F.floor(high.cast("double") / edge).cast("long")), lambda c: F.struct(size.alias("_size"), c.alias("_cell")))


def _cell_of(value: Column, sizes: list[int], width: float) -> Column:
    """The cell of a value in each size that is in use."""
    return F.array(*(F.struct(F.lit(k).alias("_size"), F.floor(value.cast("double") / (width * 16.0**k)).cast("long").alias("_cell")) for k in sizes))


def _in_cells(ranges: DataFrame, low: str, high: str, width: float) -> tuple[DataFrame, list[int]]:
    """(ranges by (size, cell), the sizes in use: a handful)."""
    cut = ranges.filter(F.col(low) <= F.col(high)).withColumn("_c", F.explode(_cells(F.col(low), F.col(high), width))).select("*", "_c._size", "_c._cell").drop("_c")
    return cut, sorted(r[0] for r in cut.select("_size").distinct().collect())


def contained_pairs(inner: DataFrame, outer: DataFrame, inner_key: str, outer_key: str, low: str, high: str, outer_low: str, outer_high: str, width: float) -> DataFrame:
    """outer_key, inner_key of the inner intervals that lie inside each outer interval. An inner interval is looked up in
    the cell where it begins, an outer one stands in every cell that it covers."""
    o = outer.select(F.col(outer_key).alias("_o"), F.col(outer_low).alias("_ol"), F.col(outer_high).alias("_oh"))
    covered, sizes = _in_cells(o, "_ol", "_oh", width)
    i = inner.select(F.col(inner_key).alias("_i"), F.col(low).alias("_l"), F.col(high).alias("_h"))
    i = i.select("*", F.inline(_cell_of(F.col("_l"), sizes or [0], width)))
    return i.join(covered, ["_size", "_cell"]).filter("_l >= _ol and _h <= _oh").select(F.col("_o").alias(outer_key), F.col("_i").alias(inner_key))


def contained(inner: DataFrame, outer: DataFrame, inner_key: str, outer_key: str, low: str, high: str, outer_low: str, outer_high: str, width: float) -> DataFrame:
    """outer_key, members: the sorted keys of the inner intervals inside each outer one (an empty array if none). For outer
    intervals with few members; `contained_pairs` has no such bound."""
    pairs = contained_pairs(inner, outer, inner_key, outer_key, low, high, outer_low, outer_high, width)
    hits = pairs.groupBy(outer_key).agg(F.array_sort(F.collect_set(inner_key)).alias("members"))
    empty = F.array().cast(hits.schema["members"].dataType)
    return outer.select(outer_key).join(hits, outer_key, "left").select(outer_key, F.coalesce("members", empty).alias("members"))


def in_ranges(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float, keep: bool = True) -> DataFrame:
    """points whose value lies in some range, both ends included (keep=False: in none)."""
    r, sizes = _in_cells(ranges.select(F.col(low).alias("_l"), F.col(high).alias("_h")), "_l", "_h", width)
    out = points
    hit = None
    for k in sizes:  # one join per size in use
        part = r.filter(F.col("_size") == k)
        on = (F.floor(F.col(value).cast("double") / (width * 16.0**k)).cast("long") == F.col("_cell")) & F.col(value).between(F.col("_l"), F.col("_h"))
        if keep:
            found = out.join(part, on, "left_semi")
            hit = found if hit is None else hit.unionByName(found)
        out = out.join(part, on, "left_anti")
    return out if not keep else points.limit(0) if hit is None else hit


def in_order(df: DataFrame, order: str) -> tuple[DataFrame, list[int]]:
    """(df in ranges of a column, each sorted in one partition and written; `_p` is its number, the numbers in use)."""
    ranged = materialize(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()), "ranged")
    return ranged, sorted(r[0] for r in ranged.select("_p").distinct().collect())  # one per partition


def _by_part(values: dict, default) -> Column:
    out = F.lit(default)
    for p, value in values.items():
        out = F.when(F.col("_p") == p, F.lit(value)).otherwise(out)
    return out


def numbered(df: DataFrame, order: str, into: str = "row_no") -> DataFrame:
    """df with consecutive numbers from 1 in order of a column without ties; sorted by ranges, so no task holds all rows."""
    ranged, parts = in_order(df, order)
    sizes = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}
    starts = {p: sum(sizes[q] for q in parts if q < p) for p in parts}
    return ranged.withColumn(into, (F.row_number().over(W.partitionBy("_p").orderBy(order)) + _by_part(starts, 0)).cast("int")).drop("_p")


def _last_before(cells: DataFrame) -> DataFrame:
    """cells (_cell, _last) with `_before`: the last value of the cells before, found range by range; a range hands on one
    value."""
    ranged, parts = in_order(cells, "_cell")
    held = {r["_p"]: r["v"] for r in ranged.filter(F.col("_last").isNotNull()).groupBy("_p").agg(F.max_by("_last", "_cell").alias("v")).collect()}
    carried = {p: next((held[q] for q in reversed(parts) if q < p and q in held), None) for p in parts}
    inside = F.last("_last", True).over(W.partitionBy("_p").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    return ranged.select("_cell", F.coalesce(inside, _by_part(carried, None).cast(cells.schema["_last"].dataType)).alias("_before"))


def zipped(panels: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """row_no, line: texts of several panels (frame, order column, text column) row by row side by side, each padded to its
    panel's greatest width; as many rows as the longest panel has."""
    out, columns = None, []
    for k, (df, order, text) in enumerate(panels):
        widest = df.agg(F.coalesce(F.max(F.length(text)), F.lit(0)).alias(f"_w{k}"))
        rows = numbered(df, order, "row_no").select("row_no", F.col(text).alias(f"_t{k}"))
        out = rows if out is None else out.join(rows, "row_no", "full_outer")
        columns.append((k, widest.first()[0]))
    pads = [F.rpad(F.coalesce(F.col(f"_t{k}"), F.lit("")), max(1, w), " ") for k, w in columns]
    return out.select("row_no", F.concat_ws(" ", *pads).alias("line"))
