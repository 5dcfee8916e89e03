"""Implausible readings, each judged against its own source.

Per source and field a robust control chart runs over the readings in order of time: an exponentially weighted level and
scale, updated with clipped values only, so a suspect moves neither. A reading beyond the chart's limits is a signal; a
reading with a signal, and the one after it, are suspects, and only suspects are then checked exactly (two neighbours on
both sides). The chart misses no spike, because its limit is never wider than LIMIT = 0.999 * jump / (2 + weight): were
neither the first reading x of a spike nor the reading y before it a signal, x would be within LIMIT of the level then, y
within LIMIT of the level before, and the level moves by weight * LIMIT at most, so x and y would differ by less than jump.
Run-length counters find stuck values; physical limits need no neighbours.

Sources are cut into blocks of time, so that a source with a third of all rows is many groups. One pass over the blocks
finds what lies inside them and hands on the first and last readings and runs of each; a second pass over these few rows
per block finds what crosses the edges. Charts of many blocks advance together, one reading of each at a time.

Special input: illegible or null values are no readings; copies of a report (same source and time) are one reading, of
which the smallest id's value counts, and all are listed; at the ends of a series, where two neighbours on a side are
missing, there is no spike; ties in value are equal values; empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gleanery.operators import canonical, report_times
from gleanery.session import materialize


@dataclass(frozen=True)
class Limits:
    """Fixed values of the problem: physical limits, least size of a spike, and the chart's parameters."""

    warm: float = 60.0  # °C either way
    windy: float = 75.0  # m/s
    jump: tuple[tuple[str, float], ...] = (("temperature", 6.0), ("dew", 6.0), ("speed", 9.0))
    times: float = 2.5  # of the change that nine in ten do not exceed
    usual: float = 0.9
    stuck_readings: int = 6
    stuck_seconds: int = 12 * 3600
    pause_seconds: int = 30 * 86400
    block_days: int = 14
    weight: float = 0.25
    width: float = 3.0


EDGE = 5  # readings at each end of a block: a spike of two, two neighbours on both sides, and one for the chart
FOUND = "kind string, source string, field string, block int, t long, t_end long, n long, size double, first boolean, last boolean"
AT_ONCE = 50_000  # rows whose charts advance together


def signals(x: np.ndarray, starts: np.ndarray, jump: float, limits: Limits) -> np.ndarray:
    """Readings beyond the chart's limits; x holds the series one after the other, starts where each begins."""
    n = len(x)
    out = np.zeros(n, bool)
    if not n:
        return out
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    heads = np.full((len(starts), 5), np.nan)
    for k in range(5):
        has = lengths > k
        heads[has, k] = x[starts[has] + k]
    level = np.nanmedian(heads, axis=1)
    scale = np.maximum(0.5, np.nanmedian(np.abs(heads - level[:, None]), axis=1))
    most, floor, a = 0.999 * jump / (2 + limits.weight), jump / 12, limits.weight
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # how many series have a k-th reading
    for k in range(lengths[0]):
        m = active[k]
        at = starts[:m] + k
        off = x[at] - level[:m]
        bound = np.minimum(limits.width * scale[:m], most)
        size = np.abs(off)
        out[at] = size > bound
        size = np.minimum(size, bound)  # clipped before it updates anything
        level[:m] += a * np.copysign(size, off)
        scale[:m] = np.maximum(scale[:m] + a * (size * 1.25 - scale[:m]), floor)
    return out


def spike_sizes(x: np.ndarray, signal: np.ndarray, series: np.ndarray, jump: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, sizes): readings of suspected spikes and the least difference to their neighbours, if it is at least
    `jump`. series numbers the stretches whose readings are neighbours."""
    n = len(x)
    suspect = signal.copy()
    suspect[1:] |= signal[:-1]
    where, sizes = [], []
    for k in (1, 2):
        i = np.flatnonzero(suspect)
        i = i[(i >= 2) & (i + k + 1 < n)]
        i = i[series[i - 2] == series[i + k + 1]]
        least = np.full(len(i), np.inf)
        for p in range(k):
            for q in (-2, -1, k, k + 1):
                least = np.minimum(least, np.abs(x[i + p] - x[i + q]))
        big = least >= jump - 1e-9
        for p in range(k):
            where.append(i[big] + p)
            sizes.append(least[big])
    return np.concatenate(where), np.concatenate(sizes)


def _rows(kind: str, source, field: str, block, t, t_end=None, n=None, size=None, first=None, last=None) -> pd.DataFrame:
    count = len(t) if t is not None else len(size)
    none = lambda v, kind: v if v is not None else pd.array([None] * count, dtype=kind)
    out = pd.DataFrame(
        {"kind": kind, "source": source, "field": field, "block": none(block, "Int32"), "t": none(t, "Int64"), "t_end": none(t_end, "Int64"), "n": none(n, "Int64"), "size": none(size, "Float64"), "first": none(first, "boolean"), "last": none(last, "boolean")}
    )
    return out.astype({"block": "Int32", "t": "Int64", "t_end": "Int64", "n": "Int64", "size": "Float64", "first": "boolean", "last": "boolean"})


def inside_blocks(pdf: pd.DataFrame, limits: Limits) -> Iterator[pd.DataFrame]:
    """What whole blocks hold (rows sorted by source, block, time and id): spikes, long runs, far values, counts of changes,
    and the readings and runs at the edges."""
    key = pdf.groupby(["source", "block", "t"], sort=False, dropna=False).ngroup().to_numpy()
    fields = [f for f, _ in limits.jump]
    merged = pdf.groupby(key, sort=False)[["source", "block", "t", *fields]].first()  # of copies, the first value that there is
    wet = merged["dew"] > merged["temperature"]
    if wet.any():
        w = merged[wet]
        yield _rows("wet", w["source"].array, "dew", w["block"].array, w["t"].array)
    for field, jump in limits.jump:
        held = merged[merged[field].notna()]
        n = len(held)
        if not n:
            continue
        source, block, t, x = held["source"].array, held["block"].to_numpy(np.int64), held["t"].to_numpy(np.int64), held[field].to_numpy(float)
        series = held.groupby(["source", "block"], sort=False).ngroup().to_numpy()
        new = np.append(True, series[1:] != series[:-1])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, n))
        rank = np.arange(n) - starts[series]
        left = lengths[series] - 1 - rank

        def take(i, kind, field=field, source=source, block=block, t=t, **more):
            return _rows(kind, source[i], field, block[i], t[i], **more)

        where, sizes = spike_sizes(x, signals(x, starts, jump, limits), series, jump)
        yield take(where, "spike", size=sizes)
        far = np.flatnonzero(x > limits.windy if field == "speed" else np.abs(x) > limits.warm)
        yield take(far, "impossible")
        steps = pd.DataFrame({"source": source[1:], "size": np.round(np.abs(np.diff(x)), 6)})[~new[1:]].groupby(["source", "size"]).size()
        yield _rows("change", steps.index.get_level_values(0), field, None, None, n=steps.to_numpy(), size=steps.index.get_level_values(1))
        edge = np.flatnonzero((rank < EDGE) | (left < EDGE))
        # first: readings are left out before this one
        yield take(edge, "edge", size=x[edge], first=(left[edge] == EDGE - 1) & (rank[edge] > EDGE), last=np.zeros(len(edge), bool))
        same = np.append(False, (np.abs(np.diff(x)) < 1e-6) & (np.diff(t) < limits.pause_seconds)) & ~new
        begins = np.flatnonzero(~same)
        ends = np.append(begins[1:], n) - 1
        count = ends - begins + 1
        first, last = rank[begins] == 0, left[ends] == 0
        long = (count >= limits.stuck_readings) & (t[ends] - t[begins] >= limits.stuck_seconds)
        keep = first | last | long
        yield take(begins[keep], "run", t_end=t[ends[keep]], n=count[keep], first=first[keep], last=last[keep])


def scan_blocks(limits: Limits):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= AT_ONCE:
                rows = pd.concat(held, ignore_index=True)
                open_block = (rows["source"] == rows["source"].iat[-1]) & (rows["block"] == rows["block"].iat[-1])
                yield from inside_blocks(rows[~open_block], limits) if not open_block.all() else ()
                held = [rows[open_block]]
        if held:
            yield from inside_blocks(pd.concat(held, ignore_index=True), limits)

    return scan


def across_blocks(limits: Limits):
    """What crosses the edges of the blocks of one source and field; a few rows per block."""
    jumps = dict(limits.jump)

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        source, field = pdf["source"].iat[0], pdf["field"].iat[0]
        edge = pdf[pdf["kind"] == "edge"].sort_values("t", kind="stable")
        x, t, block = edge["size"].to_numpy(float), edge["t"].to_numpy(np.int64), edge["block"].to_numpy(np.int64)
        stretch = np.cumsum(edge["first"].to_numpy(bool))
        where, sizes = spike_sizes(x, signals(x, np.zeros(1, np.int64), jumps[field], limits), stretch, jumps[field])
        out = [_rows("spike", source, field, block[where], t[where], size=sizes)]
        border = np.flatnonzero(np.diff(block) != 0) + 1
        steps = np.abs(x[border] - x[border - 1])
        out.append(_rows("change", source, field, None, None, n=np.ones(len(border), np.int64), size=np.round(steps, 6)))
        joined = dict(zip(block[border].tolist(), ((steps < 1e-6) & (t[border] - t[border - 1] < limits.pause_seconds)).tolist()))
        runs = pdf[pdf["kind"] == "run"].sort_values("t", kind="stable")
        if len(runs):
            chain = np.cumsum([not (first and joined.get(b, False)) for first, b in zip(runs["first"], runs["block"])])
            whole = runs.groupby(chain)
            long = (whole["n"].transform("sum") >= limits.stuck_readings) & (whole["t_end"].transform("max") - whole["t"].transform("min") >= limits.stuck_seconds)
            stuck = runs[long]
            out.append(_rows("stuck", source, field, stuck["block"].array, stuck["t"].array, t_end=stuck["t_end"].array))
        return pd.concat([o for o in out if len(o)] or out[:1], ignore_index=True)

    return cross


def usual_changes(changes: DataFrame, share: float) -> DataFrame:
    """source, field, usual: the size that `share` of the changes between consecutive readings do not exceed, exactly."""
    counts = changes.groupBy("source", "field", "size").agg(F.sum("n").alias("n"))
    w = W.partitionBy("source", "field")
    up_to = F.sum("n").over(w.orderBy("size").rowsBetween(W.unboundedPreceding, 0))
    enough = counts.withColumn("enough", up_to >= F.ceil(F.sum("n").over(w) * F.lit(share) - 1e-9))
    return enough.filter("enough").groupBy("source", "field").agg(F.min("size").alias("usual"))


def implausible(readings: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """id, field, kind (`impossible`, `stuck`, `spike`) for readings (id, source, at, temperature, dew, speed).

    A reading may have several kinds; every copy of it is listed.
    """
    fields = [f for f, _ in limits.jump]
    t = F.unix_seconds("at")
    block = F.floor(t / (limits.block_days * 86400)).cast("int").alias("block")
    readings = materialize(readings.filter(F.col("source").isNotNull() & F.col("at").isNotNull()).select("id", "source", t.alias("t"), block, *fields), "readings")
    sorted_blocks = readings.repartition("source", "block").sortWithinPartitions("source", "block", "t", "id")
    inside = materialize(sorted_blocks.mapInPandas(scan_blocks(limits), FOUND), "inside")
    at_edges = inside.filter("kind = 'edge' or (kind = 'run' and (first or last))")
    across = materialize(at_edges.groupBy("source", "field").applyInPandas(across_blocks(limits), FOUND), "across")
    found = inside.unionByName(across)
    usual = usual_changes(found.filter("kind = 'change'"), limits.usual)
    spikes = found.filter("kind = 'spike'").groupBy("source", "field", "block", "t").agg(F.max("size").alias("size")).join(usual, ["source", "field"])
    span = ["source", "field", "block", "t", "t_end"]
    cases = (
        spikes.filter(F.col("size") >= F.col("usual") * limits.times - 1e-9).select(*span[:-1], F.col("t").alias("t_end"), F.lit("spike").alias("kind"))
        .unionByName(inside.filter("kind = 'run' and not first and not last").select(*span, F.lit("stuck").alias("kind")))
        .unionByName(across.filter("kind = 'stuck'").select(*span, "kind"))
        .unionByName(inside.filter("kind = 'impossible'").select(*span[:-1], F.col("t").alias("t_end"), "kind"))
    )
    cases = materialize(cases, "cases")
    hot = cases.filter("field = 'temperature'").select("source", "block", F.col("t").alias("_t"), F.col("t_end").alias("_end"))
    wet = inside.filter("kind = 'wet'").join(hot, ["source", "block"], "left").groupBy("source", "field", "block", "t").agg(F.max(F.col("t").between(F.col("_t"), F.col("_end"))).alias("_case"))
    far_dew = cases.filter("field = 'dew' and kind = 'impossible'").select("source", "field", "block", "t")
    wet = wet.filter(~F.coalesce("_case", F.lit(False))).drop("_case").join(far_dew, ["source", "field", "block", "t"], "left_anti")
    cases = cases.unionByName(wet.select(*span[:-1], F.col("t").alias("t_end"), F.lit("impossible").alias("kind")))
    listed = readings.withColumnRenamed("t", "at").join(cases, ["source", "block"]).filter(F.col("at").between(F.col("t"), F.col("t_end")))
    legible = F.coalesce(*(F.when(F.col("field") == f, F.col(f).isNotNull()) for f in fields))
    return listed.filter(legible).select("id", "field", "kind")


def readings_of(reports: DataFrame, stations: DataFrame) -> DataFrame:
    """id, source, at, temperature, dew, speed (m/s) of the weather reports whose time is valid."""
    timed = reports.filter(report_times.valid(reports))
    winds = canonical.winds(timed, stations, report_times.columns())
    return winds.select(F.col("report_id").alias("id"), F.col("station").alias("source"), "at", "temperature", "dew", F.round("wind_mps", 6).alias("speed"))


def kinds(found: DataFrame) -> DataFrame:
    """Cases by field and kind."""
    return found.groupBy("field", "kind").agg(F.count("*").alias("cases"))
