"""Filling fixed-capacity containers with items: minimum bin slack.

Items are spread over shards by a hash of their key, each shard of bounded total size; a shard is packed bin by bin. A bin
starts with the longest item left; bitset dynamic programming over the lengths available (one big-integer shift per
item) finds the fullest combination for the rest, and its items are removed. Items of one length are interchangeable, so
the search is over a multiset of lengths. Only an item longer than the capacity is cut: into full bins and a remainder,
which is packed like an item.

Special input: items of size null, 0 or less take no room and get no bin (bin null); equal items are separate items; a
capacity that is null or below 1 has no result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SHARD_SIZE = 4_000_000  # about the total size of a shard; about one bin per shard stays unfilled


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths from the multiset whose sum is as near to room as can be. `lengths` are the keys of counts, falling."""
    reach, steps, full, mask = 1, [], 1 << room, (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            more = (reach | (reach << length)) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not (before >> at) & 1:
            chosen.append(length)
            at -= length
    return chosen


def minimum_bin_slack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, size)."""
    bins: list[list[tuple[int, int, int]]] = []
    of_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, size in enumerate(sizes):
        start = 0
        while size - start > capacity:
            bins.append([(item, start, capacity)])
            start += capacity
        of_length[size - start].append((item, start))
    counts = {length: len(held) for length, held in of_length.items()}
    lengths = sorted(counts, reverse=True)
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        taken = [first, *fullest(counts, lengths, capacity - first)]
        for length in taken[1:]:
            counts[length] -= 1
        for length in set(taken):
            if not counts[length]:
                del counts[length]
                lengths.remove(length)
        bins.append([(*of_length[length].pop(), length) for length in taken])
    return bins


def pack(items: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "tokens", shard_size: int = SHARD_SIZE) -> DataFrame:
    """container, bin, key, start, tokens: a row per item (or piece of an item longer than the capacity) and container.

    items: key, size. containers: container, capacity.
    """
    kind = items.select(key).schema[0].dataType.simpleString()
    sized = items.select(key, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    total = sized.agg(F.sum(F.greatest("_size", F.lit(0)))).first()[0] or 0
    shards = max(1, -(-total // shard_size))
    spread = sized.filter("_size > 0").withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    valid = containers.filter(F.col("capacity") >= 1).select("container", F.col("capacity").cast("long").alias("_capacity"))
    jobs = [(r["container"], r["_capacity"]) for r in valid.collect()]  # a handful of container sizes
    sizes = F.explode(F.array(*(F.struct(F.lit(c).alias("container"), F.lit(n).alias("_capacity")) for c, n in jobs))) if jobs else None
    if sizes is None:
        return spread.select(F.lit("").alias("container"), F.lit(0).cast("long").alias("bin"), key, F.lit(0).cast("long").alias("start"), F.col("_size").alias("tokens")).limit(0)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        container, capacity, shard = pdf["container"].iat[0], int(pdf["_capacity"].iat[0]), int(pdf["_shard"].iat[0])
        keys, rows = pdf[key].tolist(), []
        for number, held in enumerate(minimum_bin_slack(pdf["_size"].tolist(), capacity)):
            rows += [(container, (shard << 32) + number, keys[i], start, n) for i, start, n in held]
        return pd.DataFrame(rows, columns=["container", "bin", key, "start", "tokens"])

    packed = spread.select(key, "_size", "_shard", sizes.alias("_c")).select(key, "_size", "_shard", "_c.*").groupBy("container", "_shard").applyInPandas(fill, f"container string, bin long, `{key}` {kind}, start long, tokens long")
    none = sized.filter("_size <= 0").select(sizes.alias("_c"), key, "_size").select("_c.container", F.lit(None).cast("long").alias("bin"), key, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("tokens"))
    return packed.unionByName(none)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container size: bins, least possible bins, tokens, the share of room used, and the cut items' pieces."""
    used = packed.filter(F.col("bin").isNotNull()).groupBy("container", "bin").agg(F.sum("tokens").alias("tokens"), F.sum((F.col("start") > 0).cast("long")).alias("cuts"))
    c = containers.select("container", F.col("capacity").cast("long").alias("capacity"))
    return (
        used.groupBy("container").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.sum("cuts").alias("cuts"), F.max("tokens").alias("fullest"))
        .join(c, "container")
        .select("container", "capacity", "bins", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), "tokens", "cuts", "fullest", (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("room_used"))
    )

