"""Queries of the general data-quality operators over the test tables, and the SQL that answers the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.operators import canonical, grid, malformed, report_times, spikes
from gleanery.plans import problem_sql
from gleanery.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return malformed.failed_parts(malformed.load_report_lines(table(spark, sf, "zspd")), "line_id").select("line_id", "expr")


def p2_failures(spark: SparkSession, sf: str) -> DataFrame:
    return malformed.failed_parts(malformed.load_report_lines(table(spark, sf, "zspd")), "line_id")


def p2_loaded(spark: SparkSession, sf: str) -> DataFrame:
    v = malformed.valid_lines(malformed.load_report_lines(table(spark, sf, "zspd")))
    part = lambda x: F.concat_ws("/", x["desc"], F.coalesce(x["num"], F.lit("")), F.coalesce(x["cb"], F.lit("")))
    return v.select("line_id", "wind_expr.*", F.array_join(F.transform("cloud_expr", part), " ").alias("clouds"))


def p4_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_readings(table(spark, sf, "weather_report"), table(spark, sf, "station"))


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    return p4_canonical(spark, sf).select("report_id", "station", F.round("wind_mps", 6).alias("wind_mps"), F.round("pressure_hpa", 4).alias("pressure_hpa"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.converted(p4_canonical(spark, sf))


def p5_implausible(spark: SparkSession, sf: str) -> DataFrame:
    readings = spikes.readings_of(table(spark, sf, "weather_report"), table(spark, sf, "station"))
    return spikes.implausible(readings).withColumnRenamed("id", "report_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_implausible(spark, sf).select("report_id", "field").distinct()


def p6_grid(spark: SparkSession, sf: str) -> DataFrame:
    readings = report_times.reports(table(spark, sf, "weather_report")).select(F.col("station").alias("source"), "at", F.col("temperature").alias("value"))
    sources = table(spark, sf, "station").select(F.col("icao").alias("source"), F.col("report_every").alias("every"))
    return grid.regular_grid(readings, sources).withColumnRenamed("source", "station")


def p6_observed(spark: SparkSession, sf: str) -> DataFrame:
    return p6_grid(spark, sf).filter("status = 'observed'").select("station", F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), F.round("value", 6).alias("value"))


def p6_held_out(spark: SparkSession, sf: str) -> DataFrame:
    readings = report_times.reports(table(spark, sf, "weather_report")).select(F.col("station").alias("source"), "at", F.col("temperature").alias("value"))
    sources = table(spark, sf, "station").select(F.col("icao").alias("source"), F.col("report_every").alias("every"))
    return grid.held_out_error(readings, sources)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_grid(spark, sf).filter("status <> 'observed'").select("station", F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"))


QUERIES = {
    "p2_found": p2_found,
    "p2_failures": p2_failures,
    "p2_loaded": p2_loaded,
    "p4_found": p4_found,
    "p4_canonical": p4_canonical,
    "p4_values": p4_values,
    "p5_found": p5_found,
    "p5_implausible": p5_implausible,
    "p6_found": p6_found,
    "p6_grid": p6_grid,
    "p6_observed": p6_observed,
    "p6_held_out": p6_held_out,
}

ORACLES = {
    "p2_found": problem_sql.P2,
    "p2_loaded": problem_sql.P2_LOADED,
    "p4_found": problem_sql.P4,
    "p4_values": problem_sql.P4_CANONICAL,
    "p5_found": problem_sql.P5,
    "p5_implausible": problem_sql.P5_CASES,
    "p6_found": problem_sql.P6,
    "p6_observed": problem_sql.P6_OBSERVED,
}
