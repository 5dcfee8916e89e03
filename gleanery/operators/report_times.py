"""When a report was made: only day of month and time of day are recorded; month and year come from its arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


DAY = "^(0[1-9]|[12][0-9]|3[01])$"
TIME = "^([01][0-9]|2[0-3])[0-5][0-9]$"


def has_time(day: Column, time: Column) -> Column:
    """day 01-31 and time 0000-2359."""
    return F.coalesce(day.rlike(DAY) & time.rlike(TIME), F.lit(False))


def observed_at(day: Column, time: Column, received: Column) -> Column:
    """The latest instant with that day of month and time of day not after `received`; null unless the day is 01-31 and the
    time 0000-2359. It lies in the month of arrival, the one before, or, where that is too short, the one before that: a
    short month always follows a long one."""
    number = F.when(has_time(day, time), day.try_cast("int"))
    minute = F.substring(time, 1, 2).try_cast("int") * 60 + F.substring(time, 3, 2).try_cast("int")
    arrived = F.floor(F.unix_seconds(received) / 86400).cast("int")
    on = F.date_from_unix_date(arrived)
    first = arrived - F.dayofmonth(on) + 1  # days since 1970, of the month's first day
    before = F.dayofmonth(F.date_from_unix_date(first - 1))  # length of the month before
    gone = (number < F.dayofmonth(on)) | ((number == F.dayofmonth(on)) & (minute * 60 <= F.pmod(F.unix_seconds(received), F.lit(86400))))
    start = F.when(gone, first).when(number <= before, first - before).otherwise(first - before - 31)
    return F.timestamp_seconds((start + number - 1).cast("long") * 86400 + minute * 60)


def celsius(text: Column) -> Column:
    """Degrees of a coded temperature (`07`, `M12`), null if it is not legible."""
    return F.when(text.rlike("^M?[0-9]+$"), F.regexp_replace(text, "^M", "-").try_cast("double"))


def valid(df: DataFrame) -> Column:
    """Reports of a station with a valid time."""
    return has_time(F.col("date_expr.day"), F.col("date_expr.time")) & F.col("received_at").isNotNull() & F.col("station").isNotNull()


def columns() -> list[Column]:
    """report_id, at, temperature, dew of a report."""
    return [
        F.col("report_id"),
        observed_at(F.col("date_expr.day"), F.col("date_expr.time"), F.col("received_at").cast("timestamp")).alias("at"),
        celsius(F.col("temperature_expr.temperature")).alias("temperature"),
        celsius(F.col("temperature_expr.dew")).alias("dew"),
    ]


def reports(df: DataFrame) -> DataFrame:
    """station, report_id, at, temperature, dew, of the reports whose time is valid."""
    # As a generated row, the time is computed once, however often it is used afterwards.
    return df.filter(valid(df)).select("station", F.inline(F.array(F.struct(*columns()))))
