"""Dynamic tables: tag scans and the relocation, symbol, string lookup.

Special input: a missing tag is named in `error`; a name that no relocation has is not found (no row, or `found` false);
of several relocations the first counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TAGS = ["STRTAB", "STRSZ", "JMPREL", "PLTRELSZ", "SYMTAB"]
ENTRY_SIZE = 24


def dynamic_tables(tags: DataFrame, key: str, tag: str = "tag", value: str = "value", order: str = "idx") -> DataFrame:
    """key, one column per tag (the last one counts), entries, error."""
    wide = tags.groupBy(key).agg(*(F.max_by(F.when(F.col(tag) == t, F.col(value)), F.when(F.col(tag) == t, F.col(order))).alias(t) for t in TAGS))
    missing = F.array_compact(F.array(*(F.when(F.col(t).isNull(), F.lit(f"no {t}")) for t in TAGS)))
    return wide.withColumn("entries", F.floor(F.col("PLTRELSZ") / ENTRY_SIZE).cast("long")).withColumn("error", F.when(F.size(missing) > 0, F.array_join(missing, ", ")))


def find_relocation(relocations: DataFrame, symbols: DataFrame, strings: DataFrame, name: str | None = None) -> DataFrame:
    """name, idx: the first relocation of each symbol name (or of one). relocations: idx, sym; symbols: sym, str; strings:
    str, name."""
    wanted = strings if name is None else strings.filter(F.col("name") == name)
    return relocations.join(symbols.select("sym", "str"), "sym").join(wanted.select("str", "name"), "str").groupBy("name").agg(F.min("idx").alias("idx"))
