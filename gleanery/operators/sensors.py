"""Sensor texts, device means and template pages.

Special input: a disk report without the attribute has temperature null; a device without readings has mean null; a
template's unknown variables stay as they are; nulls are left out of means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TEMPERATURE_ATTRIBUTE = "194"


def words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda x: x != "")


def disk_temperature(lines: DataFrame, device: str = "device", number: str = "line_no", line: str = "line") -> DataFrame:
    """device, temperature: the tenth word of the first line of the attribute; null if there is none."""
    hit = F.when(F.startswith(F.col(line), F.lit(TEMPERATURE_ATTRIBUTE)), F.col(number))
    return lines.groupBy(device).agg(F.min_by(F.get(words(F.col(line)), F.lit(9)), hit).alias("temperature"))


def device_mean(readings: DataFrame, name: str, value: str, scale: float = 1000.0) -> DataFrame:
    """name, mean: mean of the readings in the base unit (readings are in `scale`-ths)."""
    return readings.groupBy(name).agg((F.avg(value) / scale).alias("mean"))


def is_disk(name: Column) -> Column:
    return name.rlike("^sd.*[^0-9]$") | (F.startswith(name, F.lit("nvme")) & (F.length(name) == 5))


def fill_template(template: Column, variables: Column) -> Column:
    """Every `{name}` of a map's names replaced by its value, in the order of the map."""
    return F.reduce(F.map_entries(variables), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def found_sensors(devices: DataFrame, cpus: DataFrame, name: str, temperature: str) -> DataFrame:
    """kind, name, temperature of the disks among the devices and of the CPU sensors, those that show one (neither null nor
    0)."""
    disks = devices.filter(is_disk(F.col(name))).select(F.lit("hard_disk").alias("kind"), F.col(name).alias("name"), F.col(temperature).cast("double").alias("temperature"))
    cores = cpus.select(F.lit("cpu").alias("kind"), F.col(name).alias("name"), F.col(temperature).cast("double").alias("temperature"))
    return disks.unionByName(cores).filter(F.coalesce("temperature", F.lit(0.0)) != 0)


def link_card(name: Column, url: Column) -> Column:
    return F.format_string('<div class="card"><header>%s</header><footer><a href="%s">URL</a></footer></div>', name, url)


def cards(sensors: DataFrame, group: str, kind: str, name: str, value: str, order: str) -> DataFrame:
    """group, html: one card per group of sensors in their order; kinds other than cpu and hard_disk leave it empty. A group
    is what one page shows."""
    said = lambda label: F.format_string(f"<p>{label} %s temperature: %s°C</p>", F.col(name), F.col(value).cast("string"))
    entry = F.when(F.col(kind) == "cpu", said("CPU")).when(F.col(kind) == "hard_disk", said("Disk")).otherwise("")
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e"))))
    return sensors.groupBy(group).agg(F.concat(F.lit('<div class="card">'), F.array_join(F.transform(listed, lambda x: x["e"]), ""), F.lit("</div>")).alias("html"))
