"""Ordered lists of blocks: edits, JSON round trips, reconciliation.

A list is either an ARRAY column (edits of one list) or rows with a position (lists of any length).

Special input: a missing element leaves the list as it is; positions outside are clamped; unknown types read as null;
an empty prefix selects nothing; repeated elements move together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.operators.snapshots import with_previous

NOTE = "struct<`note-info`:struct<id:string,type:string,children:array<string>,parent:string>,content:string,checked:boolean>"
TYPES = ("header", "paragraph", "todo")


def note(kind: Column, content: Column, identity: Column | None = None, checked: Column | None = None) -> Column:
    """A note without children and parent; `checked` only for a todo."""
    done = F.when(kind == "todo", F.coalesce(checked if checked is not None else F.lit(False), F.lit(False)))
    info = F.struct((identity if identity is not None else F.uuid()).alias("id"), kind.alias("type"), F.array().cast("array<string>").alias("children"), F.lit(None).cast("string").alias("parent"))
    return F.struct(info.alias("note-info"), content.alias("content"), done.alias("checked")).cast(NOTE)


def to_text(notes: Column) -> Column:
    return F.to_json(notes)


def from_text(text: Column, keep_relations: bool = True) -> Column:
    """array of notes; those of unknown type are left out. keep_relations=False: children and parent start anew."""
    parsed = F.filter(F.from_json(text, f"array<{NOTE}>"), lambda n: n["note-info"]["type"].isin(*TYPES))
    return parsed if keep_relations else F.transform(parsed, lambda n: note(n["note-info"]["type"], n["content"], n["note-info"]["id"], n["checked"]))


def without(items: Column, item: Column) -> Column:
    return F.filter(items, lambda x: x != item)


def moved(items: Column, item: Column, to: Column) -> Column:
    """item put at an index (from 0, clamped) of the list without it."""
    rest = without(items, item)
    at = F.least(F.greatest(to, F.lit(0)), F.size(rest))
    found = F.concat(F.slice(rest, F.lit(1), at), F.filter(items, lambda x: x == item), F.slice(rest, at + 1, F.size(rest)))
    return F.when(F.array_contains(items, item), found).otherwise(items)


def moved_rows(rows: DataFrame, key: str, pos: str, item, to: int) -> DataFrame:
    """The same for rows (key, pos from 0 without gaps): one pass, two aggregates and no sort of the list."""
    stats = rows.agg(F.count("*").alias("_n"), F.max(F.when(F.col(key) == F.lit(item), F.col(pos))).alias("_from")).first()
    n, old = stats["_n"], stats["_from"]
    if old is None:
        return rows
    new = min(max(to, 0), n - 1)
    p = F.col(pos)
    shifted = F.when(p == old, F.lit(new)).when((p > old) & (p <= new), p - 1).when((p < old) & (p >= new), p + 1).otherwise(p)
    return rows.withColumn(pos, shifted.cast(rows.schema[pos].dataType))


def appended(rows: DataFrame, pos: str, more: DataFrame) -> DataFrame:
    """more (with positions from 0) behind rows."""
    end = (rows.agg(F.max(pos)).first()[0] if not rows.isEmpty() else -1) + 1
    return rows.unionByName(more.withColumn(pos, (F.col(pos) + end).cast(rows.schema[pos].dataType)))


def drop_index(rows: DataFrame, pos: str, middle: str, y: float, group: list[str] | None = None) -> DataFrame:
    """How many rows at the beginning have their middle above y: the position of the first that has not, or their number."""
    first = F.min(F.when(~F.coalesce(F.col(middle) < y, F.lit(False)), F.col(pos)))
    grouped = rows.groupBy(*(group or []))
    return grouped.agg(F.coalesce(first, F.count("*")).cast("long").alias("index"))


def prefix(rows: DataFrame, pos: str, condition: Column, group: list[str]) -> DataFrame:
    """The rows before the first that fails the condition."""
    cut = rows.groupBy(*group).agg(F.min(F.when(~F.coalesce(condition, F.lit(False)), F.col(pos))).alias("_cut"))
    return rows.join(cut, group).filter(F.col("_cut").isNull() | (F.col(pos) < F.col("_cut"))).select(*rows.columns)


def reconcile(shown: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key, action: `remove` what is shown and not wanted, `add` what is wanted and not shown."""
    gone = shown.select(key).distinct().join(wanted.select(key), key, "left_anti").withColumn("action", F.lit("remove"))
    new = wanted.select(key).distinct().join(shown.select(key), key, "left_anti").withColumn("action", F.lit("add"))
    return gone.unionByName(new)


def synchronised(shown: DataFrame, wanted: DataFrame, key: str, pos: str) -> DataFrame:
    """key, action (`remove`, `add`, `move` or `keep`), pos (wanted; null for what goes): what brings a shown list to the
    wanted order. Both hold key and pos; what stays is moved if its place differs."""
    a, b = shown.select(F.col(key), F.col(pos).alias("_a")).dropDuplicates([key]), wanted.select(F.col(key), F.col(pos).alias("_b")).dropDuplicates([key])
    action = F.when(F.col("_b").isNull(), "remove").when(F.col("_a").isNull(), "add").when(F.col("_a") != F.col("_b"), "move").otherwise("keep")
    return a.join(b, key, "full_outer").select(key, action.alias("action"), F.col("_b").alias(pos))


def matching_commands(commands: DataFrame, name: str, typed: str) -> DataFrame:
    return commands.filter(F.startswith(F.col(name), F.lit(typed)) & F.lit(typed != ""))


def next_selection(index: Column, step: int, size: Column) -> Column:
    return F.when(size > 0, F.pmod(index + step, size))


def by_type(kind: Column, choices: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in choices.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def only_changed(updates: DataFrame, key: str, order: str, value: str, width: int | None = None) -> DataFrame:
    """Updates that change what was there: a guard against writing equal values again; the first update of a key is one.
    `width` as in snapshots.with_previous."""
    held = updates.withColumn("_held", F.struct(F.col(value).alias("v")))
    before = with_previous(held, key, order, "_held", width, "_b")
    return before.filter(F.col("_b").isNull() | ~F.col("_b.v").eqNullSafe(F.col(value))).drop("_held", "_b")
