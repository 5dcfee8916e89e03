"""Fixed-layout binary records: little-endian fields, record arrays, string tables, interval containment.

A layout is a list of (name, offset, size); sizes of 8 become DECIMAL(20,0), so unsigned values keep their sign. Counts
are read unsigned.

Special input: a null or short content gives null fields and no records; a name without its NUL ends with the content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleanery.session import materialize

Layout = list[tuple[str, int, int]]

# The layouts of 64-bit executables and of the container files.
ELF_HEADER: Layout = [
    ("type", 16, 2), ("machine", 18, 2), ("version", 20, 4), ("entry", 24, 8), ("phoff", 32, 8), ("shoff", 40, 8), ("flags", 48, 4),
    ("ehsize", 52, 2), ("phentsize", 54, 2), ("phnum", 56, 2), ("shentsize", 58, 2), ("shnum", 60, 2), ("shstrndx", 62, 2),
]
ELF_SEGMENT: Layout = [("type", 0, 4), ("flags", 4, 4), ("offset", 8, 8), ("vaddr", 16, 8), ("paddr", 24, 8), ("filesz", 32, 8), ("memsz", 40, 8), ("align", 48, 8)]
ELF_SECTION: Layout = [
    ("name_at", 0, 4), ("type", 4, 4), ("flags", 8, 8), ("addr", 16, 8), ("offset", 24, 8), ("size", 32, 8), ("link", 40, 4), ("info", 44, 4), ("addralign", 48, 8), ("entsize", 56, 8),
]
CONTAINER_HEADER: Layout = [("magic", 0, 4), ("checksum", 4, 4), ("size", 8, 4), ("count", 12, 4)]
CONTAINER_ENTRY: Layout = [("offset", 32, 4), ("length", 36, 4), ("checksum", 40, 4)]
SEGMENT_SIZE, SECTION_SIZE, NAME_SIZE = 56, 64, 32
_LOW_HALVES = 0x0F0F0F0F0F0F0F0F


def unsigned(content: Column, at: Column, size: int) -> Column:
    """A little-endian unsigned number."""
    piece = F.substring(content, at + 1, F.lit(size))
    swapped = F.conv(F.reverse(F.hex(piece)), 16, -10).cast("long")  # bytes in order, the halves of each exchanged
    n = F.shiftleft(swapped.bitwiseAND(_LOW_HALVES), 4)
    n = n.bitwiseOR(F.shiftrightunsigned(swapped, 4).bitwiseAND(_LOW_HALVES))
    if size == 8:
        whole = n.cast("decimal(20,0)")
        n = F.when(n < 0, whole + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(whole).cast("decimal(20,0)")
    return F.when(F.length(piece) == size, n)


def fields(content: Column, base: Column, layout: Layout) -> Column:
    return F.struct(*(unsigned(content, base + at, size).alias(name) for name, at, size in layout))


def records(content: Column, start: Column, count: Column, stride: int, layout: Layout) -> Column:
    """array<struct> of count records; the array ends with the content."""
    fit = F.floor((F.octet_length(content) - start) / stride)
    n = F.least(count.cast("long"), fit.cast("long"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: fields(content, (start + i * stride).cast("int"), layout))
    return F.when(n > 0, each).otherwise(F.filter(F.array(fields(content, F.lit(0), layout)), lambda x: F.lit(False)))


def text_at(content: Column, at: Column) -> Column:
    """NUL-terminated text at an offset."""
    rest = F.substring(content, at.cast("int") + 1, F.octet_length(content))
    return F.decode(F.unhex(F.regexp_extract(F.hex(rest), "^(?:(?!00)..)*+", 0)), "UTF-8")


def executables(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, content, header, segments, sections of 64-bit little-endian executables."""
    c = F.col(content)
    t = files.select(F.col(key), c.alias("content"), fields(c, F.lit(0), ELF_HEADER).alias("header"))
    h = F.col("header")
    return t.select(
        key,
        "content",
        "header",
        records(F.col("content"), h["phoff"].cast("int"), h["phnum"], SEGMENT_SIZE, ELF_SEGMENT).alias("segments"),
        records(F.col("content"), h["shoff"].cast("int"), h["shnum"], SECTION_SIZE, ELF_SECTION).alias("sections"),
    )


def sections(parsed: DataFrame, key: str) -> DataFrame:
    """key, idx, name, addr, offset, size: sections with their names from the section that holds names."""
    names = F.get("sections", F.col("header.shstrndx").cast("int"))["offset"]
    t = parsed.select(key, "content", names.cast("int").alias("_names"), F.posexplode("sections").alias("idx", "s"))
    return t.select(key, "idx", text_at(F.col("content"), F.col("_names") + F.col("s.name_at").cast("int")).alias("name"), "s.addr", "s.offset", "s.size")


def segments(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(key, F.posexplode("segments").alias("idx", "s")).select(key, "idx", "s.*")


def sections_in_segments(parsed: DataFrame, key: str) -> DataFrame:
    """key, idx of each segment, names of the sections inside it by number. Both tables are of one file, hence of one row:
    nothing is joined or shuffled, and names are read for sections inside a segment alone."""
    names = F.get("sections", F.col("header.shstrndx").cast("int"))["offset"].cast("int")

    def listed(g: Column, i: Column) -> Column:
        inside = F.filter("sections", lambda s: (s["addr"] >= g["vaddr"]) & (s["addr"] + s["size"] <= g["vaddr"] + g["memsz"]))
        return F.struct(i.alias("idx"), F.transform(inside, lambda s: text_at(F.col("content"), F.col("_names") + s["name_at"].cast("int"))).alias("sections"))

    t = parsed.select(key, "content", "segments", "sections", names.alias("_names"))
    # The outer form, since for the other Spark infers a filter that reads all tables of the file once more.
    each = t.select(key, F.explode_outer(F.transform("segments", listed)).alias("_s"))
    return each.filter(F.col("_s").isNotNull()).select(key, F.col("_s.idx").alias("idx"), F.coalesce("_s.sections", F.array().cast("array<string>")).alias("sections"))


def segment_gaps(parsed: DataFrame, key: str, load: int = 1, executable: int = 1) -> DataFrame:
    """key, idx, gap: room between an executable loaded segment and the next loaded one."""
    loaded = segments(parsed, key).filter(F.col("type") == load)
    w = W.partitionBy(key).orderBy("idx")
    gap = F.lead("vaddr").over(w) - (F.col("vaddr") + F.col("memsz"))
    return loaded.withColumn("gap", gap).filter((F.col("flags").bitwiseAND(executable) != 0) & (F.col("gap") > 0)).select(key, "idx", "gap")


def containers(files: DataFrame, key: str, content: str, start: int, stride: int, by_header_size: bool = False) -> DataFrame:
    """key, magic, idx, name, offset, length, checksum of a container's entries: from `start` every `stride` bytes, as many
    as the header counts (or as fit below the header's size)."""
    c = F.col(content)
    t = files.select(F.col(key), c.alias("content"), fields(c, F.lit(0), CONTAINER_HEADER).alias("h"))
    count = F.floor((F.col("h.size") - start) / stride).cast("long") if by_header_size else F.col("h.count")
    c = F.col("content")
    entries = F.posexplode(records(c, F.lit(start), count, stride, [*CONTAINER_ENTRY]))
    e = t.select(key, "content", F.col("h.magic").alias("magic"), entries.alias("idx", "e"))
    name = F.decode(F.unhex(F.regexp_extract(F.hex(F.substring(F.col("content"), F.col("idx") * stride + start + 1, F.lit(NAME_SIZE))), "^(?:(?!00)..)*+", 0)), "UTF-8")
    return e.select(key, "magic", "idx", name.alias("name"), "e.offset", "e.length", "e.checksum")


# The magic numbers of the container variants, and where each holds its entries: begin, stride, whether the
# header's count (else its size) ends them, and whether offsets count from the header.
VARIANTS = {"KWS": (0x484B5753, 64, 44, False, False), "K20": (0x484B3230, None, None, None, None), "K30": (0x484B3330, 240, 64, True, True)}


def container_headers(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, at, variant, magic, checksum, size, count: the header that a content begins with, by its magic number; contents
    with another begin, or too short for a header, have none. For a variant without entries this is all there is."""
    c = F.col(content)
    t = files.select(F.col(key), fields(c, F.lit(0), CONTAINER_HEADER).alias("h")).filter("h.count is not null")
    variant = F.lit(None).cast("string")
    for name, (magic, *_) in VARIANTS.items():
        variant = F.when(F.col("h.magic") == magic, name).otherwise(variant)
    return t.select(key, variant.alias("variant"), "h.*").filter("variant is not null")


def dispatched(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, header_at, variant, idx, name, offset, length, checksum of the entries of all headers of a file: every header is
    followed by its entries' bytes up to the next one. Reading stops at an unknown magic number or at the end; offsets are
    absolute in the file."""
    rest = files.select(F.col(key), F.lit(0).cast("long").alias("header_at"), F.col(content).alias("content")).filter(F.octet_length("content") >= 16)
    out = None
    while True:
        heads = materialize(container_headers(rest, key, "content").join(rest, key), "headers")
        if heads.isEmpty():
            break
        found = None
        for name, (_, start, stride, by_count, relative) in VARIANTS.items():
            if start is not None:
                part = containers(heads.filter(F.col("variant") == name), key, "content", start, stride, not by_count)
                part = part.join(heads.select(key, "header_at", "variant"), key).withColumn("offset", F.col("offset") + (F.col("header_at") if relative else F.lit(0)))
                found = part if found is None else found.unionByName(part)
        found = materialize(found, "entries")
        out = found if out is None else out.unionByName(found)
        ends = found.groupBy(key).agg(F.max(F.col("offset") + F.col("length")).alias("_end"))
        after = heads.join(ends, key, "left").withColumn("_at", F.greatest(F.col("header_at") + F.col("size"), F.coalesce("_end", F.lit(0))))
        rest = after.select(key, F.col("_at").alias("header_at"), F.expr("substring(content, CAST(_at - header_at AS INT) + 1)").alias("content")).filter(F.octet_length("content") >= 16)
    columns = [key, "header_at", "variant", "idx", "name", "offset", "length", "checksum"]
    if out is None:
        empty = files.select(F.col(key)).limit(0)
        kinds = dict(zip(columns[1:], ["long", "string", "int", "string", "long", "long", "long"]))
        return empty.select(key, *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    return out.select(*columns)


def payloads(files: DataFrame, entries: DataFrame, key: str, content: str) -> DataFrame:
    """entries with the bytes that they name."""
    return entries.join(files.select(key, F.col(content).alias("_c")), key).select(
        *entries.columns, F.substring(F.col("_c"), F.col("offset").cast("int") + 1, F.col("length").cast("int")).alias("payload")
    )


def short_table(df: DataFrame, width: int = 10) -> DataFrame:
    """Texts cut to `width`, integers in hexadecimal."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    return df.select(*((F.substring(c, 1, width) if t == "string" else F.lower(F.hex(c)) if t in whole else F.col(c)).alias(c) for c, t in df.dtypes))
