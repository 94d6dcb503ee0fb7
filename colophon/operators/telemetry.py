"""Telemetry roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_key(flags: Column) -> Column:
    """A canonical string of a map of flags."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(flags, F.create_map().cast("map<string,boolean>")))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(False)).cast("string"))), ",")


def roll_up(events: DataFrame) -> DataFrame:
    """A10: per set of flags the number of queries, mean total latency, mean list sizes; largest first.

    ``events``: ``flags MAP, timings_ms MAP, n_fused, n_colbert``.
    """
    total = F.aggregate(F.map_values(F.coalesce("timings_ms", F.create_map().cast("map<string,double>"))), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    mean = lambda c: F.round(F.avg(c), 1)
    return events.groupBy(flag_key(F.col("flags")).alias("flags")).agg(F.count("*").alias("n_queries"), mean(total).alias("mean_latency_ms"), mean(F.coalesce("n_fused", F.lit(0))).alias("mean_fused"), mean(F.coalesce("n_colbert", F.lit(0))).alias("mean_colbert")).orderBy(F.desc("n_queries"), "flags")


def since(events: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Events of the last ``days`` days before ``now``."""
    return events.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def daily(events: DataFrame, at: str, by: list[str], value: str) -> DataFrame:
    """Count and mean per day and group."""
    return events.groupBy(F.date_trunc("day", at).alias("day"), *by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"))


def masked_query(query: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a query."""
    return F.substring(F.sha2(query, 256), 1, 16)


def check_targets(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """``metric, value, target, passed``; ``op`` is lt or gt."""
    return measured.join(targets, "metric").select("metric", "value", "target", F.when(F.col("op") == "lt", F.col("value") < F.col("target")).otherwise(F.col("value") > F.col("target")).alias("passed"))
