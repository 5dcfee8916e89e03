"""Cross references: caller edges, name fallbacks, label recovery.

Special input: cycles end where a node was seen before; an address without a name shows as hexadecimal; rows that fail a
check are dropped (`failures` lists them with the reason); ties in order take the greatest label.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.session import materialize

INVALID = (0, 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF)


def names_of(addresses: DataFrame, functions: DataFrame, symbols: DataFrame, address: str = "address") -> DataFrame:
    """addresses with `name`: function's, else symbol's, else hexadecimal. functions, symbols: address, name."""
    f = functions.select(F.col("address").alias("_fa"), F.col("name").alias("_fn")).dropDuplicates(["_fa"])
    s = symbols.select(F.col("address").alias("_sa"), F.col("name").alias("_sn")).dropDuplicates(["_sa"])
    shown = F.concat(F.lit("0x"), F.lower(F.hex(F.col(address).cast("long"))))
    joined = addresses.join(f, F.col(address) == F.col("_fa"), "left").join(s, F.col(address) == F.col("_sa"), "left")
    return joined.select(*addresses.columns, F.coalesce("_fn", "_sn", shown).alias("name"))


def callers(roots: DataFrame, edges: DataFrame, root: str = "root", depth: int | None = None) -> DataFrame:
    """root, node, depth of everything that leads to a root by edges (src, dst), each node at its least depth. Every round
    is one join of the newest nodes with the edges, minus what was seen; it ends when nothing new comes, or at `depth` if one is
    asked for."""
    e = edges.select("src", "dst").distinct()
    newest = materialize(roots.select(F.col(root).alias("root"), F.col(root).alias("node"), F.lit(0).alias("depth")).distinct(), "roots")
    seen = newest
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        step = newest.join(e, F.col("node") == F.col("dst")).select("root", F.col("src").alias("node")).distinct()
        newest = materialize(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d)), f"callers-{d}")
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return seen


def valid_address(address: Column, low: Column, high: Column) -> Column:
    """Neither null, 0 nor all ones, and within the bounds."""
    return F.coalesce(~address.cast("decimal(20,0)").isin(*(F.lit(str(x)).cast("decimal(20,0)") for x in INVALID)) & (address >= low) & (address <= high), F.lit(False))


def recovered_labels(calls: DataFrame, target: str, label: str, order: str, checks: dict[str, Column], last_wins: bool = True) -> tuple[DataFrame, DataFrame]:
    """(target, label of the last or first call that passes all checks; calls that fail, with `reason`)."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(list(checks.items())):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    judged = calls.withColumn("reason", reason)
    pick = F.max_by if last_wins else F.min_by
    good = judged.filter("reason is null").groupBy(target).agg(pick(F.col(label), F.struct(order, label)).alias(label))
    return good, judged.filter("reason is not null")
