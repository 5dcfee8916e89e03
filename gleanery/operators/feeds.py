"""Feed ingestion: subscriptions, rules, links, and first-wins deduplication against a record table.

Special input: null or zero settings take the defaults; a null rule is no rule, an empty own rule falls back to the global
one; `now` is always a parameter; of equal addresses in one batch the first in order counts.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_RANGE = 90
TORRENT = "application/x-bittorrent"


def on_air_range(setting: Column) -> Column:
    """The setting in days; 0, null and unreadable texts mean the default."""
    return F.coalesce(F.nullif(setting.try_cast("int"), F.lit(0)), F.lit(DEFAULT_RANGE))


def expand_shortcuts(url: Column, shortcuts: list[tuple[str, str]]) -> Column:
    """`name://` at the beginning replaced by its alias, for every shortcut in order."""
    return reduce(lambda u, s: F.when(F.startswith(u, F.lit(s[0])), F.regexp_replace(u, "^" + _quoted(s[0] + "://"), s[1].replace("\\", "\\\\").replace("$", "\\$"))).otherwise(u), shortcuts, url)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def on_air(start: Column, now: Column, days: Column) -> Column:
    """Whole days since the start are at most `days`; future starts pass; a null start never does."""
    return F.coalesce(F.datediff(now, start) <= days, F.lit(False))


def active(subscriptions: DataFrame, now: Column, start: str = "start_date", setting: str = "on_air_range") -> DataFrame:
    """Subscriptions on air, with the effective range as `range_days`."""
    days = on_air_range(F.col(setting))
    return subscriptions.filter(on_air(F.col(start), now, days)).withColumn("range_days", days)


def excluded(text: Column, own: Column, general: Column) -> Column:
    """An own rule replaces the general one; an empty one does not."""
    rule = F.coalesce(F.nullif(own, F.lit("")), F.nullif(general, F.lit("")))
    return F.coalesce(F.rlike(text, rule), F.lit(False))


def included(text: Column, general: Column, own: Column | None = None) -> Column:
    """Without a rule everything is included; own rules only if given (they are not part of the default behaviour)."""
    rule = F.nullif(general, F.lit(""))
    if own is not None:
        rule = F.coalesce(F.nullif(own, F.lit("")), rule)
    return rule.isNull() | F.coalesce(F.rlike(text, rule), F.lit(False))


def select_entries(entries: DataFrame, text: str, own_exclude: str, exclude: str | None = None, include: str | None = None, own_include: str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    general = lambda x: none if x is None else F.lit(x)
    own = F.col(own_include) if own_include else None
    return entries.filter(~excluded(F.col(text), F.col(own_exclude), general(exclude)) & included(F.col(text), general(include), own))


def rule_error(rule: Column) -> Column:
    """Why a pattern cannot be used; null if it can, or if there is none."""

    def check(text: str) -> str | None:
        try:
            re.compile(text)
        except re.error as e:
            return str(e)

    @F.pandas_udf("string")
    def errors(rules: pd.Series) -> pd.Series:
        known = {text: check(text) for text in rules.dropna().unique()}
        return pd.Series([known.get(text) for text in rules], dtype=object)

    return errors(rule)


def judged_entries(entries: DataFrame, text: str, rules: DataFrame, by: str, rule: str) -> DataFrame:
    """entries with `chosen` and `error`: a subscription's pattern that cannot be read makes an error of its own entries only.
    The patterns are checked once per subscription (rules: by, rule), before any row meets them."""
    checked = rules.select(by, F.col(rule).alias("_rule")).dropDuplicates([by]).withColumn("_error", rule_error(F.col("_rule")))
    good = checked.withColumn("_rule", F.when(F.col("_error").isNull(), F.col("_rule")))
    joined = entries.join(good, by, "left")
    return joined.select(*entries.columns, (F.col("_error").isNull() & ~excluded(F.col(text), F.col("_rule"), F.lit(None).cast("string"))).alias("chosen"), F.col("_error").alias("error"))


def links(entries: DataFrame, key: str, links: str = "links", kind: str = TORRENT) -> DataFrame:
    """key, pos, href of the links of a type; links is array<struct<type,href>>."""
    some = F.filter(F.col(links), lambda x: x["type"] == kind)
    return entries.select(F.col(key), F.posexplode(some).alias("pos", "_l")).select(key, "pos", F.col("_l.href").alias("href"))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; combined before the shuffle, so a frequent key does not gather."""
    held = F.struct(*rows.columns)
    rest = [c for c in rows.columns if c != key]
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(held, F.col(order)).alias("_r"))
    return best.select(*(F.col(f"_r.{c}").alias(c) for c in [key, *rest])).select(*rows.columns)


def not_recorded(rows: DataFrame, record: DataFrame, key: str, record_key: str | None = None) -> DataFrame:
    seen = record.select(F.col(record_key or key).alias(key)).filter(F.col(key).isNotNull())
    return rows.join(seen, key, "left_anti")


def new_downloads(rows: DataFrame, record: DataFrame, key: str, order: str) -> DataFrame:
    return first_wins(not_recorded(rows, record, key), key, order)


def payload(name: Column, content: Column, directory: Column, token: Column) -> Column:
    """A JSON-RPC call that hands base64 content over, to be stored in the directory's folder of that name; a token, if there
    is one, stands first among the parameters."""
    options = F.to_json(F.struct(F.concat_ws("/", F.regexp_replace(directory, "(?<=.)/+$", ""), name).alias("dir")))
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.base64(content), r"\s", ""), F.lit('"'))
    secret = F.when(F.coalesce(token, F.lit("")) != "", F.concat(F.lit('"token:'), token, F.lit('"')))
    params = F.concat(F.lit("["), F.concat_ws(",", secret, quoted, F.lit("[]"), options), F.lit("]"))
    return F.concat(F.lit('{"jsonrpc":"2.0","id":1,"method":"aria2.addTorrent","params":'), params, F.lit("}"))
