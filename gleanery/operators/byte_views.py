"""Views over bytes: hex rows, byte classes, searches, C strings, key streams.

All but the chunk search are expressions over one BINARY value, `xored` in Python. `find_in_chunks` searches contents cut into chunks, across
chunk borders, without putting them together.

Special input: null gives null, empty bytes give no rows; an empty pattern or one that is absent is at -1; a start beyond
the end finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

ROW = 16


def byte_class(value: Column) -> Column:
    """GREY, GREEN, BLUE or YELLOW of a byte's number."""
    return F.when(value == 0, "GREY").when(value.between(0x21, 0x7E), "BLUE").when(value.between(0x80, 0xFE), "YELLOW").otherwise("GREEN")


def byte_numbers(content: Column) -> Column:
    """array<int> of the bytes."""
    digits = F.hex(content)
    n = F.octet_length(content)
    numbers = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(n > 0, numbers).when(n == 0, F.array().cast("array<int>"))


_CLASSES = {name: "".join(chr(b) for b in range(256) if keep(b)) for name, keep in (("GREY", lambda b: b == 0), ("BLUE", lambda b: 0x21 <= b <= 0x7E), ("YELLOW", lambda b: 0x80 <= b <= 0xFE))}


def class_counts(df: DataFrame, content: str) -> DataFrame:
    """class, count over all bytes of all rows; counted per row by what is left when a class is taken out, one character per
    byte, so no byte becomes a row of its own."""
    one_per_byte = df.select(F.decode(F.col(content), "ISO-8859-1").alias("x"))
    without = lambda c: F.length("x") - F.length(F.translate("x", _CLASSES[c], ""))
    per = one_per_byte.select(*(without(c).alias(c) for c in _CLASSES), F.length("x").alias("ALL"))
    total = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_CLASSES, "ALL")))
    rest = F.col("ALL") - F.col("GREY") - F.col("BLUE") - F.col("YELLOW")
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(c).alias("count")) for c in _CLASSES), F.struct(F.lit("GREEN").alias("class"), rest.alias("count"))))
    return total.select(rows.alias("r")).select("r.*").filter("count > 0")


def find_offset(content: Column, pattern: Column, start: int = 0) -> Column:
    """First offset of pattern at or after start, -1 if it is absent or empty."""
    one_per_byte = lambda x: F.decode(x, "ISO-8859-1")  # noqa: E731  position() counts characters
    at = F.call_function("position", one_per_byte(pattern), one_per_byte(content), F.lit(start + 1))
    return F.when(F.length(pattern) > 0, at - 1).otherwise(F.when(content.isNotNull(), -1))


def viewport(content: Column, line: Column, height: int) -> Column:
    return F.substring(content, F.greatest(line, F.lit(0)) * ROW + 1, F.lit(ROW * height))


def search_line(content: Column, pattern: Column, line: int, height: int) -> Column:
    """The line of the first occurrence after the page of `height` lines that begins at `line`; the line itself if there is
    none."""
    found = line_of(find_offset(content, pattern, (max(line, 0) + height) * ROW))
    return F.coalesce(found, F.lit(line))


def after_keys(keys: Column, start: Column) -> Column:
    """The line shown after an array of keys: `down`, `up`, `page_down` and `page_up` move by 1 or 10 and never above the
    first line, a number goes to that line; a step up that would leave the beginning is none, other keys change nothing."""
    steps = {"down": 1, "up": -1, "page_down": 10, "page_up": -10}

    def step(at: Column, key: Column) -> Column:
        moved = F.when(key.rlike("^[0-9]+$"), F.coalesce(key.try_cast("int"), at))
        for name, by in steps.items():
            moved = moved.when((key == name) & (at + by >= 0), at + by)
        return moved.otherwise(at)

    return F.reduce(keys, start.cast("int"), step)


def dump_rows(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, row_no, line: rows of a log dump; sixteen bytes in hexadecimal, short rows padded, then the letters and digits of
    the same bytes, blanks for the rest."""
    shown = hex_rows(df, key, content)
    text = F.decode(F.unhex(F.regexp_replace("hex", " ", "")), "ISO-8859-1")
    plain = F.regexp_replace(text, r"[^\p{L}\p{Nd}²³¹¼½¾]", " ")
    return shown.select(key, (F.conv("address", 16, 10).cast("long") / ROW).cast("long").alias("row_no"), F.concat(F.rpad("hex", 3 * ROW, " "), plain).alias("line"))


def line_of(offset: Column) -> Column:
    return F.when(offset >= 0, F.floor(offset / ROW).cast("int"))


def hex_rows(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, address, hex, chars: rows of sixteen bytes; what is not printable ASCII is a dot."""
    n = F.octet_length(F.col(content))
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(ROW))))
    rows = df.select(F.col(key), F.col(content).alias("_c"), at.alias("_at")).withColumn("_b", F.substring(F.col("_c"), F.col("_at") + 1, F.lit(ROW)))
    return rows.select(
        key,
        F.lpad(F.lower(F.hex("_at")), 8, "0").alias("address"),
        F.regexp_replace(F.lower(F.hex("_b")), "(..)", "$1 ").alias("hex"),
        F.regexp_replace(F.decode("_b", "ISO-8859-1"), r"[^\x20-\x7e]", ".").alias("chars"),
    )


def find_in_chunks(chunks: DataFrame, file: str, number: str, content: str, pattern: bytes) -> DataFrame:
    """file, offset of the first occurrence, -1 if there is none; a chunk looks len(pattern) - 1 bytes into the next ones."""
    w = W.partitionBy(file).orderBy(number)
    head = F.substring(F.col(content), 1, max(1, len(pattern) - 1))
    light = chunks.select(file, number, F.length(content).cast("long").alias("_n"), head.alias("_head"))
    base = light.select(
        file,
        number,
        F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.array_join(F.transform(F.collect_list("_head").over(w.rowsBetween(1, max(1, len(pattern) - 1))), lambda x: F.hex(x)), "").alias("_next"),
    )
    joined = F.concat(F.col(content), F.substring(F.unhex("_next"), 1, max(0, len(pattern) - 1)))
    hits = chunks.join(base, [file, number]).select(file, "_base", find_offset(joined, F.lit(pattern)).alias("_at"))
    return hits.groupBy(file).agg(F.coalesce(F.min(F.when(F.col("_at") >= 0, F.col("_base") + F.col("_at"))), F.lit(-1)).alias("offset"))


def c_string(content: Column, address: Column, limit: int = 32) -> Column:
    """The bytes from an address up to NUL, at most limit + 1 of them, as text; empty for an invalid address."""
    some = F.decode(F.substring(content, address + 1, F.lit(limit + 1)), "ISO-8859-1")
    return F.when(address.isin(0, 0xFFFFFFFF), "").otherwise(F.substring_index(some, "\0", 1))


def xor_stream(content: Column, key: list[int]) -> Column:
    """array<int>: every byte xor the key's byte at (i + (i >> 4)) & 15; applied twice it gives the bytes again."""
    k = F.array(*(F.lit(x) for x in key))
    return F.transform(byte_numbers(content), lambda b, i: b.bitwiseXOR(F.get(k, (i + F.shiftright(i, 4)).bitwiseAND(15))))


def xored(content: Column, key: list[int]) -> Column:
    """BINARY: the bytes of `xor_stream`, in Arrow batches. The stream repeats after 256 bytes."""
    stream = np.array([key[(i + (i >> 4)) & 15] & 255 for i in range(256)], np.uint8)

    def xor(value: bytes | None) -> bytes | None:
        if value is None:
            return None
        data = np.frombuffer(value, np.uint8)
        return (data ^ np.resize(stream, len(data))).tobytes()

    @F.arrow_udf("binary")
    def batch(values: pa.Array) -> pa.Array:
        return pa.array([xor(v.as_buffer() if v.is_valid else None) for v in values], pa.binary())

    return batch(content)


def leading_run(content: Column, byte: int = 0) -> Column:
    """How many equal bytes stand at the beginning."""
    return F.length(F.regexp_extract(F.hex(content), f"^(?:{byte:02X})*+", 0)) / 2
