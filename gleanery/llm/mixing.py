"""Mixing sources to target weights: balanced sampling by the cube method.

The total is the largest at which every source can supply its share without a record being used more often than allowed.
A source's records are then each used `rate` times: the whole part of the rate surely, one more time with its fraction as
the inclusion probability. The flight phase moves these probabilities through the null space of the constraints (number of
records, number of tokens), so both totals stay what they were while probability after probability becomes 0 or 1. It runs
in groups of bounded size inside each source, and in a group over classes of falling size: a flight leaves at most two
fractions, a small landing problem settles them, and the next class makes up for what that missed, down to the smallest
records. A group thus misses its totals by about one small record.

Special input: a null source, or one without a target, is not used (times_used 0); source names are compared without case
and surrounding blanks; empty texts count no tokens and are not used; a target whose source has no records gets nothing,
and the others keep their proportions; max_repeats null or below 1 means 0 uses; with no usable source all counts are 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gleanery.session import materialize

GROUP = 4000
TINY = 1e-9


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase; sums of p and of p * sizes are kept; at most two stay fractional."""
    p = np.clip(p.astype(float), 0, 1)
    p[p < TINY] = 0
    p[p > 1 - TINY] = 1
    values, scale = p.tolist(), sizes.tolist()
    waiting = [i for i in range(len(p)) if 0 < values[i] < 1]
    waiting.reverse()
    draws = iter(rng.random(4 * len(p) + 8).tolist())
    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 3:
            break
        i, j, k = held
        a, b, c = scale[i], scale[j], scale[k]
        u = (b - c, c - a, a - b)  # orthogonal to (1, 1, 1) and to (a, b, c)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for n, d in zip(held, u):
            if d > 0:
                up, down = min(up, (1 - values[n]) / d), min(down, values[n] / d)
            elif d < 0:
                up, down = min(up, values[n] / -d), min(down, (1 - values[n]) / -d)
        step = up if next(draws) * (up + down) < down else -down
        for n, d in zip(held, u):
            x = values[n] + step * d
            values[n] = 0.0 if x < TINY else 1.0 if x > 1 - TINY else x
        held = [n for n in held if 0 < values[n] < 1]
    return np.array(values)


def land(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settle at most two fractions: of the joint designs with these probabilities the one with the least expected
    deviation of the total size."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_) == 1:
        p[open_] = float(rng.random() < p[open_[0]])
    elif len(open_) == 2:
        i, j = open_
        expected = p[i] * sizes[i] + p[j] * sizes[j]
        low, high = max(0.0, p[i] + p[j] - 1), min(p[i], p[j])

        def cost(both: float) -> float:
            odds = ((both, sizes[i] + sizes[j]), (p[i] - both, sizes[i]), (p[j] - both, sizes[j]), (1 - p[i] - p[j] + both, 0))
            return sum(q * abs(total - expected) for q, total in odds)

        both = min((low, high), key=cost)
        x = rng.random()
        first, second = (1, 1) if x < both else (1, 0) if x < p[i] else (0, 1) if x < p[i] + p[j] - both else (0, 0)
        p[i], p[j] = first, second
    return p


def shifted(p: np.ndarray, sizes: np.ndarray, count: float, total: float, rounds: int = 20) -> np.ndarray:
    """p moved by a linear function of size so that the expected number grows by count and the expected size by total, as far
    as [0, 1] allows. Where both cannot be had, the size goes before the number."""
    p = p.copy()
    for turn in range(2 * rounds):
        free = (p > 0) & (p < 1)
        if not free.any() or abs(total) < 1e-6 and (turn >= rounds or abs(count) < 1e-9):
            break
        s = sizes[free]
        a, b, c = float(free.sum()), float(s.sum()), float((s * s).sum())
        det = a * c - b * b
        if turn < rounds and det > 1e-9 * max(1.0, a * c):
            x, y = (c * count - b * total) / det, (a * total - b * count) / det
        else:
            x, y = (total / b if b else 0.0), 0.0
        moved = p.copy()
        moved[free] = np.clip(p[free] + x + y * s, 0, 1)
        count -= float((moved - p).sum())
        total -= float(((moved - p) * sizes).sum())
        p = moved
    return p


def settle(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube method over classes of falling size: flight and landing of a class (sizes within a factor of two), what the
    landing missed is spread over all smaller items. A large item's probability hardly moves against small ones, so it must
    not be the last one left."""
    p = p.copy()
    order = np.lexsort((rng.random(len(p)), -sizes))
    level = np.floor(np.log2(np.maximum(sizes[order], 1)))
    cuts = [0, *(np.flatnonzero(np.diff(level)) + 1).tolist(), len(order)]
    for a, b in zip(cuts, cuts[1:]):
        part = order[a:b]
        if not len(part):
            continue
        moved = land(flight(p[part], sizes[part], rng), sizes[part], rng)
        missed = p[part] - moved
        p[part] = moved
        rest = order[b:]
        p[rest] = shifted(p[rest], sizes[rest], float(missed.sum()), float((missed * sizes[part]).sum()))
    return p


def _settle_group(key: str, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        rng = np.random.default_rng([seed, int(pdf["_shard"].iat[0]), *pdf["source"].iat[0].encode()])
        extra = settle(pdf["_p"].to_numpy(float), pdf["tokens"].to_numpy(float), rng)
        return pd.DataFrame({key: pdf[key], "times_used": pdf["_whole"].to_numpy() + np.rint(extra).astype(int)})

    return run


def rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, share, cap, docs, held, rate (uses per record); one row per target with records."""
    held = sized.filter("tokens > 0").groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("held"))
    t = targets.select(
        F.lower(F.trim("source")).alias("source"), F.col("target_share").alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap")
    ).filter("share > 0 and cap > 0").groupBy("source").agg(F.max("share").alias("share"), F.min("cap").alias("cap"))
    both = t.join(held, "source")
    total = both.agg(F.min(F.col("held") * F.col("cap") / F.col("share"))).first()[0] or 0.0
    return both.withColumn("rate", F.least(F.lit(float(total)) * F.col("share") / F.col("held"), F.col("cap").cast("double")))


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", group: int = GROUP, seed: int = 11) -> DataFrame:
    """key, source (normalised), tokens, times_used; documents: key, source, tokens."""
    sized = materialize(documents.select(key, F.lower(F.trim("source")).alias("source"), F.col("tokens").cast("long").alias("tokens")), "sized")
    rate = rates(sized, targets)
    used = sized.filter("tokens > 0").join(rate.select("source", "rate", "docs"), "source")
    whole = F.floor(F.col("rate") + TINY).cast("int")
    spread = used.select(
        key, "source", "tokens", whole.alias("_whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("_p"), F.pmod(F.xxhash64(key), F.ceil(F.col("docs") / group)).cast("int").alias("_shard")
    )
    kind = sized.select(key).schema[0].dataType.simpleString()
    times = spread.groupBy("source", "_shard").applyInPandas(_settle_group(key, seed), f"`{key}` {kind}, times_used int")
    return sized.join(times, key, "left").select(key, "source", "tokens", F.coalesce("times_used", F.lit(0)).alias("times_used"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, documents (distinct), uses, tokens, most (uses of a record), max_repeats."""
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    per = mixed.filter("times_used > 0").groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("times_used").alias("uses"), F.sum(F.col("times_used") * F.col("tokens")).alias("tokens"), F.max("times_used").alias("most")
    )
    total = per.agg(F.sum("tokens")).first()[0] or 0
    return t.join(per, "source", "left").select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.lit(max(1, total))).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most", F.lit(0)).alias("most"), "max_repeats",
    )
