"""Tokens of coded weather reports.

The grammar is one atomic expression anchored with \\G, so tokenizing is a projection in the JVM. `kind` is what the
ordered alternatives give (four letters are a station code before they are weather); `kind_fixed` accepts only the first
such token as a station code and reads later ones as weather where they can be.

Special input: a null line has no tokens and is complete as null; a blank line has none and is incomplete unless empty;
a line that stops being readable gives its readable prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import patterns as P

# The alternatives of a report, in the order in which they are tried.
WEATHER = "(?>-|\\+|RE|VC)*+(?>MI|BC|PR|TS|BL|SH|DR|FZ)*+(?>DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PO|SQ|FC|SS|DS|TS)++"
GRAMMAR = [
    ("report", "METAR(?>/SPECI)*+"),
    ("cavok", "CAVOK"),
    ("trend", "(?>NOSIG|BECMG|TEMPO|PROB[0-9]{2}|(?>FM|TL|AT)[0-9]{4})"),
    ("icao", "[A-Z]{4}"),
    ("time", "[0-9]{6}Z"),
    ("wind", "(?>[0-9]{3}|VRB)[0-9]{2}(?>G[0-9]{2})*+(?>MPS|KT|KMH)"),
    ("vary", "[0-9]{3}V[0-9]{3}"),
    ("shear", "WS (?>LDG|TKOF) RWY[0-9]{2}L*+"),
    ("visibility", "[0-9]{4}"),
    ("runway", "R[0-9]{2}[LR]*+/[0-9]{4}[UDN]*+"),
    ("cloud", "(?>SKC|FEW|SCT|BKN|OVC|NSC|NCD|CLR)(?>[0-9]{3})*+(?>CB)*+"),
    ("temperature", "M*+[0-9]{2}/M*+[0-9]{2}"),
    ("pressure", "[QA][0-9]{4}"),
    ("weather", WEATHER),
]
SEPARATORS = " ="
# Which alternative takes a token that several would: those with the longer fixed shapes come first in GRAMMAR, but a
# visibility must not take the start of a longer group, which the separator after it ensures.


def token_array(line: Column) -> Column:
    return P.tokens(line, [p for _, p in GRAMMAR], SEPARATORS)


def kind_of(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(GRAMMAR):
        out = F.when(token.rlike(f"^{pattern}$"), name).otherwise(out)
    return out


def part(token: Column, kind: str, pattern: str, group: int) -> Column:
    got = F.regexp_extract(token, pattern, group)
    return F.when((F.col("kind") == kind) & (got != ""), got)


def weather_tokens(lines: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """key, pos, kind, kind_fixed, raw and the typed payloads of each token."""
    t = lines.select(F.col(key), F.posexplode(token_array(F.col(line))).alias("pos", "_t"))
    t = t.select(key, "pos", F.expr("substring(_t, 1, length(_t) - 1)").alias("raw")).withColumn("kind", kind_of(F.col("raw")))
    raw = F.col("raw")
    fixed = F.when((F.col("kind") == "icao") & (F.col("pos") > 1) & raw.rlike(f"^{WEATHER}$"), "weather").otherwise(F.col("kind"))
    cloud = "^([A-Z]{3})([0-9]{3})?((?:[0-9]{3})*)(CB)?"
    return t.select(
        key,
        "pos",
        "kind",
        fixed.alias("kind_fixed"),
        "raw",
        part(raw, "time", "^(..)(....)Z$", 1).alias("day"),
        part(raw, "time", "^(..)(....)Z$", 2).alias("time"),
        part(raw, "wind", "^(...)(..)(?:G(..))?", 1).alias("wind_direction"),
        part(raw, "wind", "^(...)(..)(?:G(..))?", 2).alias("wind_speed"),
        part(raw, "wind", "(MPS|KT|KMH)$", 1).alias("wind_unit"),
        part(raw, "wind", "^(...)(..)(?:G(..))?", 3).alias("wind_gust"),
        part(raw, "vary", "^(...)V(...)$", 1).alias("vary_from"),
        part(raw, "vary", "^(...)V(...)$", 2).alias("vary_to"),
        F.when(F.col("kind") == "visibility", raw).alias("visibility"),
        part(raw, "cloud", cloud, 1).alias("cloud_desc"),
        part(raw, "cloud", cloud, 2).alias("cloud_num"),
        part(raw, "cloud", cloud, 4).alias("cloud_cb"),
        (part(raw, "cloud", cloud, 3).isNotNull()).alias("cloud_extra"),
        part(raw, "temperature", "^(M*..)/(M*..)$", 1).alias("temperature"),
        part(raw, "temperature", "^(M*..)/(M*..)$", 2).alias("dew"),
        part(raw, "pressure", "^(.)(....)$", 1).alias("pressure_unit"),
        part(raw, "pressure", "^(.)(....)$", 2).alias("pressure_num"),
        F.when(F.col("kind") == "runway", F.array(F.lit("R"), F.regexp_extract(raw, "^R(..[LR]*)/", 1), F.lit("/"), F.regexp_extract(raw, "/(.*)$", 1))).alias("runway"),
        F.when(F.col("kind") == "weather", F.regexp_extract_all(raw, F.lit("[-+]|RE|VC|[A-Z]{2}"), F.lit(0))).alias("weather"),
        F.when(F.col("kind") == "shear", F.regexp_extract_all(raw, F.lit("WS|LDG|TKOF|RWY[0-9]{2}L*"), F.lit(0))).alias("shear"),
    )


def consumed(lines: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """key, used (characters tokenized), complete."""
    used = F.length(F.array_join(token_array(F.col(line)), ""))
    return lines.select(key, used.alias("used"), (used == F.length(F.col(line))).alias("complete"))


def degrees(text: Column) -> Column:
    """Whole degrees of a coded temperature."""
    return F.regexp_replace(text, "^M", "-").try_cast("int")
