"""Quantities recorded in different units, converted to m/s and hPa.

A record's unit is taken from the value itself, else from the unit field, else from the remark, else from the station's
note, else it is the canonical one. For pressure the size has the last word: every station has a level (the median of its
own readings as declared), and a number that cannot be near that level in its declared unit gets the unit and decimal
scale that brings it nearest. Wind has no size by which a unit could be told.

The grammar runs once per distinct text (texts of units, remarks and notes repeat), the arithmetic in Catalyst.

Special input: a value without digits, or null, is not legible and has no result; a station without a note, or unknown,
has no default; a station with no usable reading has the sea-level as its level; repeated reports each have a row; the
input's other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gleanery.functions import units as U

SEA_LEVEL = 1013.25
LOWEST, HIGHEST = 450.0, 1100.0  # hPa that any station can report
TOLERANCE = 0.12  # of a station's level; the nearest two pressure scales are a third apart

# Candidate readings of a bare number: unit, decimal scale.
SCALES = {"hPa": 1.0, "tenths of hPa": 0.1, "kPa": 10.0, "tenths of kPa": 1.0, "mmHg": U.MERCURY / 100, "tenths of mmHg": U.MERCURY / 1000, "inHg": U.MERCURY * 0.254, "hundredths of inHg": U.MERCURY * 0.00254}


def _text_units(text: str) -> Column:
    """struct<wind, pressure>: the scales of the units that a free text names."""

    @F.pandas_udf("struct<wind:double,pressure:double>")
    def named_units(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            named = U.units_in_text(t if isinstance(t, str) else None)
            wind, pressure = U.unit_of_kind(named, U.SPEED), U.unit_of_kind(named, U.PRESSURE)
            rows.append((wind and wind.scale / U.METRES_PER_SECOND.scale, pressure and pressure.scale / U.HECTOPASCAL.scale))
        return pd.DataFrame(rows, columns=["wind", "pressure"], dtype=object)

    return named_units(text)


def _each(texts: pd.Series, f) -> np.ndarray:
    """f of every text, called once per distinct one."""
    codes, distinct = pd.factorize(texts)
    found = np.empty(len(distinct) + 1, object)
    found[:-1] = [f(t) for t in distinct]
    found[-1] = f(None)
    return found[codes]


def _declared(numbers: pd.Series, units: pd.Series, remarks: pd.Series, kind: U.Unit, to: float) -> pd.DataFrame:
    scale = lambda u: u.scale / to if u and u.vector == kind.vector else np.nan
    quantities = _each(numbers, lambda t: (lambda n, u: (np.nan if n is None else n, scale(u)))(*U.parse_quantity(t)))
    number, own = (np.array([q[k] for q in quantities], float) for k in (0, 1))
    field = _each(units, lambda t: scale(U.parse_unit(t))).astype(float)
    said = _each(remarks, lambda t: scale(U.unit_of_kind(U.units_in_text(t), kind))).astype(float)
    return pd.DataFrame({"number": number, "scale": np.where(np.isnan(own), np.where(np.isnan(field), said, field), own)})


def declared_wind(speed: Column, unit: Column, remark: Column) -> Column:
    """struct<number, scale>: the wind's number and the scale to m/s that value, unit field or remark declare, NaN where
    they don't. The grammar runs once per distinct text of a batch; other columns stay in the JVM."""

    @F.pandas_udf("struct<number:double,scale:double>")
    def wind(numbers: pd.Series, units: pd.Series, remarks: pd.Series) -> pd.DataFrame:
        return _declared(numbers, units, remarks, U.SPEED, U.METRES_PER_SECOND.scale)

    return wind(speed, unit, remark)


def declared_pressure(number: Column, unit: Column, remark: Column) -> Column:
    """The same for a pressure and hPa."""

    @F.pandas_udf("struct<number:double,scale:double>")
    def pressure(numbers: pd.Series, units: pd.Series, remarks: pd.Series) -> pd.DataFrame:
        return _declared(numbers, units, remarks, U.PRESSURE, U.HECTOPASCAL.scale)

    return pressure(number, unit, remark)


def defaults(stations: DataFrame) -> DataFrame:
    """station, default struct<wind, pressure>: the scales that a station's note names; one row per station."""
    return stations.select(F.col("icao").alias("station"), _text_units("note").alias("default")).dropDuplicates(["station"])


def _number(quantity: str) -> Column:
    return F.nanvl(f"{quantity}.number", F.lit(None).cast("double"))


def _scale(quantity: str, default: str) -> Column:
    return F.coalesce(F.nanvl(f"{quantity}.scale", F.lit(None).cast("double")), f"default.{default}", F.lit(1.0))


def winds(reports: DataFrame, stations: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns of `keep` and wind_mps, for callers that need no pressure."""
    rows = reports.select("station", *keep, declared_wind(F.col("wind_expr.speed"), F.col("wind_expr.unit"), F.col("remark")).alias("_w"))
    both = rows.join(defaults(stations), "station", "left").withColumn("wind_mps", _number("_w") * _scale("_w", "wind"))
    return both.drop("_w", "default")


def declared(reports: DataFrame, stations: DataFrame) -> DataFrame:
    """report_id, station, and for wind and pressure the number and the declared scale to the canonical unit."""
    rows = reports.select(
        "report_id",
        "station",
        declared_wind(F.col("wind_expr.speed"), F.col("wind_expr.unit"), F.col("remark")).alias("_w"),
        declared_pressure(F.col("pressure_expr.num"), F.col("pressure_expr.unit"), F.col("remark")).alias("_p"),
    )
    return rows.join(defaults(stations), "station", "left").select(
        "report_id", "station", _number("_w").alias("wind"), _scale("_w", "wind").alias("wind_scale"), _number("_p").alias("pressure"), _scale("_p", "pressure").alias("pressure_scale")
    )


def station_levels(rows: DataFrame) -> DataFrame:
    """station, level: the median of a station's pressures as declared (hundredths for inHg where the size demands)."""
    as_declared = F.col("pressure") * F.col("pressure_scale")
    value = F.when(as_declared.between(LOWEST, HIGHEST), as_declared).when((as_declared / 100).between(LOWEST, HIGHEST), as_declared / 100).when((as_declared / 10).between(LOWEST, HIGHEST), as_declared / 10)
    return rows.groupBy("station").agg(F.percentile_approx(value, 0.5, 10_000).alias("level"))


def canonical_readings(reports: DataFrame, stations: DataFrame) -> DataFrame:
    """report_id, station, wind_number, wind_scale, wind_mps, pressure_number, pressure_scale, pressure_hpa.

    *_scale is what the recorded number was multiplied by; values are null where nothing legible was recorded.
    """
    rows = declared(reports, stations)
    levels = station_levels(rows)
    # null-safe: reports without a station form one station of their own
    both = rows.join(levels.withColumnRenamed("station", "_s"), F.col("station").eqNullSafe(F.col("_s")), "left").drop("_s")
    level = F.coalesce("level", F.lit(SEA_LEVEL))
    number, scale = F.col("pressure"), F.col("pressure_scale")
    fits = lambda k: F.abs(number * k - level) <= level * TOLERANCE
    decimal = F.when(fits(scale), scale).when(fits(scale / 100), scale / 100).when(fits(scale / 10), scale / 10)
    candidates = F.array_sort(F.array(*(F.struct(F.abs(number * k - level).alias("off"), F.lit(k).alias("k")) for k in sorted(set(SCALES.values())))))
    nearest = F.get(candidates, F.lit(0))
    found = F.coalesce(decimal, F.when(nearest["off"] <= level * TOLERANCE, nearest["k"]), scale)
    return both.select(
        "report_id",
        "station",
        F.col("wind").alias("wind_number"),
        "wind_scale",
        (F.col("wind") * F.col("wind_scale")).alias("wind_mps"),
        F.col("pressure").alias("pressure_number"),
        F.when(number.isNotNull(), found).alias("pressure_scale"),
        (number * found).alias("pressure_hpa"),
    )


def converted(readings: DataFrame) -> DataFrame:
    """report_id, quantity: the legible values whose recorded number was not in m/s or hPa."""
    off = lambda c: F.abs(F.col(c) - 1.0) > 1e-9
    wind = F.when(F.col("wind_mps").isNotNull() & off("wind_scale"), F.lit("wind"))
    pressure = F.when(F.col("pressure_hpa").isNotNull() & off("pressure_scale"), F.lit("pressure"))
    return readings.select("report_id", F.explode(F.array_compact(F.array(wind, pressure))).alias("quantity"))
