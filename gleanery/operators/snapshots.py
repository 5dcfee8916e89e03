"""Memory maps, register snapshots and bounded pointer chases.

Special input: lines that are no map line are dropped; a first snapshot has no changes; a null value differs from nothing;
a pointer outside all ranges ends its chain; with an empty range table no address is inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleanery.operators.joins import in_ranges

# Fixed value: the shape of a memory map's line.
MAP_LINE = r"([\da-f]+)-([\da-f]+) ([\w\-]+) {offset} {device} \d+ [\w\W]+"
# The argument registers of an architecture's calling convention.
ARGUMENTS = {"i386:x86-64": ["rdi", "rsi", "rdx", "r10", "r8", "r9"], "i386": []}


def parse_maps(lines: DataFrame, line: str = "line", compat: bool = False) -> DataFrame:
    """Other columns, start, end, permission. compat: offset and device must be decimal."""
    pattern = MAP_LINE.format(offset=r"\d+", device=r"[\d:]+") if compat else MAP_LINE.format(offset=r"[\da-f]+", device=r"[\da-f:]+")
    got = lambda n: F.regexp_extract(F.col(line), pattern, n)
    address = lambda n: F.conv(got(n), 16, 10).cast("decimal(20,0)")
    rest = [c for c in lines.columns if c != line]
    return lines.filter(F.col(line).rlike(pattern)).select(*rest, address(1).alias("start"), address(2).alias("end"), got(3).alias("permission"))


def known_addresses(points: DataFrame, ranges: DataFrame, value: str, width: float = 1 << 20) -> DataFrame:
    return in_ranges(points, ranges, value, "start", "end", width)


def with_previous(rows: DataFrame, group: str, order: str, value: str, width: int | None = None, into: str = "previous") -> DataFrame:
    """rows with the value of the row before in their group. With a `width`, groups are cut into cells of the ordering value
    and a cell's first row takes the last value of the cells before it (one row per cell), so that no task holds a group."""
    if width is None:
        return rows.withColumn(into, F.lag(value).over(W.partitionBy(group).orderBy(order)))
    t = rows.withColumn("_cell", F.floor(F.col(order) / width).cast("long"))
    ends = t.groupBy(group, "_cell").agg(F.max_by(F.struct(value), order).alias("_end"))
    ends = ends.select(F.col(group).alias("_g"), F.col("_cell").alias("_c"), F.lag("_end").over(W.partitionBy(group).orderBy("_cell")).alias("_end"))
    inside = W.partitionBy(group, "_cell").orderBy(order)
    t = t.withColumns({"_lag": F.lag(F.struct(value)).over(inside)}).join(ends, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_c")), "left")
    return t.select(*rows.columns, F.coalesce("_lag", "_end")[value].alias(into))


def changes(snapshots: DataFrame, item: str, order: str, value: str, width: int | None = None) -> DataFrame:
    """snapshots with `previous` and `changed`."""
    found = with_previous(snapshots, item, order, value, width)
    return found.withColumn("changed", F.coalesce(F.col("previous") != F.col(value), F.lit(False)))


def changed_items(snapshots: DataFrame, item: str, order: str, value: str, skip: tuple[str, ...] = ("ip", "flag")) -> DataFrame:
    """The changed ones, without items whose name contains one of `skip`."""
    found = changes(snapshots, item, order, value).filter("changed")
    for part in skip:
        found = found.filter(~F.contains(F.col(item), F.lit(part)))
    return found


def gaps(rows: DataFrame, group: str, order: str, begin: str, end: str, width: int | None = None) -> DataFrame:
    """rows with `gap`: from a row's end to the begin of the next one of its group; null for the last. The next row is the one
    before in falling order."""
    falling = rows.withColumn("_falling", -F.col(order))
    return with_previous(falling, group, "_falling", begin, width, "_next").select(*rows.columns, (F.col("_next") - F.col(end)).alias("gap"))


def block_numbers(rows: DataFrame, group: str, order: str, mark: Column, width: int | None = None) -> DataFrame:
    """rows with `block`: how many marked rows stand before it in its group; `width` as in with_previous."""
    cell = F.lit(0) if width is None else F.floor(F.col(order) / width)
    t = rows.withColumns({"_cell": cell.cast("long"), "_m": F.coalesce(mark.cast("int"), F.lit(0))})
    before = F.sum("_m").over(W.partitionBy(group, "_cell").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    if width is None:
        return t.select(*rows.columns, F.coalesce(before, F.lit(0)).alias("block"))
    sums = t.groupBy(group, "_cell").agg(F.sum("_m").alias("_s"))
    base = sums.select(F.col(group).alias("_g"), F.col("_cell").alias("_c"), F.sum("_s").over(W.partitionBy(group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)).alias("_base"))
    t = t.withColumn("_before", before).join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_c")), "left")
    return t.select(*rows.columns, (F.coalesce("_before", F.lit(0)) + F.coalesce("_base", F.lit(0))).alias("block"))


def chase(roots: DataFrame, memory: DataFrame, key: str, address: str, at: str, target: str, depth: int = 3) -> DataFrame:
    """key, depth, address: the root's own address at 0, then what is stored there, at most `depth` steps. memory holds one
    row (at, target) per readable address; joins are as many as steps, each on the address."""
    m = memory.select(F.col(at).alias("_at"), F.col(target).alias("_to")).dropDuplicates(["_at"])
    step = roots.select(F.col(key), F.lit(0).alias("depth"), F.col(address).alias("address"))
    out = step
    for d in range(1, depth + 1):
        step = step.join(m, F.col("address") == F.col("_at")).select(key, F.lit(d).alias("depth"), F.col("_to").alias("address"))
        out = out.unionByName(step)
    return out


def any_known(ranges: DataFrame) -> DataFrame:
    """known: whether there are ranges at all."""
    return ranges.agg((F.count("*") > 0).alias("known"))


def readable(chased: DataFrame, memory: DataFrame, key: str, at: str, content: str, depth: int = 3) -> DataFrame:
    """chased with `kind` and `data`: what an address holds. `addr` if a further step follows, else `string` if its eight
    bytes are ASCII, else `data`; bytes are given where the chain ends at a readable address."""
    m = memory.select(F.col(at).alias("_at"), F.col(content).alias("_c")).dropDuplicates(["_at"])
    ends = chased.groupBy(key).agg(F.max("depth").alias("_last"))
    inner = F.col("depth") < F.col("_last")
    held = F.when(~inner & (F.col("depth") < depth), F.col("_c"))
    ascii_only = F.coalesce(~F.hex(held).rlike("^(?:..)*?[89A-F]"), F.lit(False))
    return (
        chased.join(ends, key).join(m, F.col("address") == F.col("_at"), "left")
        .select(*chased.columns, F.when(inner, "addr").when(ascii_only, "string").otherwise("data").alias("kind"), held.alias("data"))
    )


def changed_references(snapshots: DataFrame, memory: DataFrame, item: str, order: str, value: str, at: str, target: str, depth: int = 3) -> DataFrame:
    """item, order, depth, address: where the values lead that changed since the snapshot before."""
    found = changed_items(snapshots, item, order, value).select(F.struct(item, order).alias("_key"), F.col(value).alias("_value"))
    return chase(found, memory, "_key", "_value", at, target, depth).select(f"_key.{item}", f"_key.{order}", "depth", "address")


def chain_text(chased: DataFrame, key: str) -> DataFrame:
    """key, chain: `a => b => c`."""
    listed = F.array_sort(F.collect_list(F.struct("depth", "address")))  # as many as the chase's depth allows
    shown = F.transform(listed, lambda x: F.concat(F.lit("0x"), F.lower(F.hex(x["address"].cast("long")))))
    return chased.groupBy(key).agg(F.array_join(shown, " => ").alias("chain"))


def unsigned_register(value: Column, compat: bool = False) -> Column:
    """The value as an unsigned 64-bit number; compat: a negative one masked to its own bit length."""
    full = F.conv(F.hex(value.cast("long")), 16, 10).cast("decimal(20,0)")
    if not compat:
        return full
    bits = F.length(F.bin(F.abs(value.cast("long"))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return F.when(value < 0, value.cast("long").bitwiseAND(mask)).otherwise(value.cast("long")).cast("decimal(20,0)")


def clean_listing(lines: DataFrame, order: str, address: str, text: str, limit: int = 12) -> DataFrame:
    """The first lines in order, annotations removed, addresses right-justified, an arrow at the first."""
    first = lines.orderBy(order).limit(limit)
    n = F.row_number().over(W.orderBy(order))  # over `limit` rows
    shown = F.lpad(F.concat(F.lit("0x"), F.lower(F.hex(F.col(address).cast("long")))), 17, " ")
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "<.+>", ""), " +#", "")
    arrow = F.when(F.col("_n") == 1, F.concat(F.lit("=> "), F.substring(shown, 4, 17))).otherwise(shown)
    return first.withColumn("_n", n).select(F.col("_n").alias("row_no"), F.concat_ws(" ", arrow, plain).alias("line"))


def call_arguments(registers: DataFrame, register: str, architecture: str) -> DataFrame:
    names = ARGUMENTS.get(architecture, [])
    return registers.filter(F.col(register).isin(names)).withColumn("argument_no", F.array_position(F.array(*map(F.lit, names or [""])), F.col(register)))


def instruction_pointer(registers: DataFrame, register: str, order: str) -> DataFrame:
    """The first register whose name contains `ip`."""
    return registers.agg(F.min_by(register, F.when(F.contains(F.col(register), F.lit("ip")), F.col(order))).alias(register))
