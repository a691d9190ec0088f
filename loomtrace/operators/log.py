"""Projections and aggregates of event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_case() -> WindowSpec:
    """Events of a case in order; the one shuffle that most operators on logs need."""
    return Window.partitionBy("case_id").orderBy("ts", "seq")


def micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def add_events(log: DataFrame, events: DataFrame) -> DataFrame:
    return log.unionByName(events, allowMissingColumns=True)


def ordered(log: DataFrame) -> DataFrame:
    """Events with their place in the case, from 0."""
    return log.withColumn("position", F.row_number().over(in_case()) - 1)


def traces(log: DataFrame) -> DataFrame:
    """One row per case: its events as an array in order, and its variant, the array of activities."""
    events = F.sort_array(F.collect_list(F.struct("ts", "seq", "activity", "resource", "lifecycle")))
    return log.groupBy("case_id").agg(events.alias("events")).withColumn("variant", F.transform("events", lambda e: e.activity))


def variants(log: DataFrame) -> DataFrame:
    """``variant`` (array of activities) with its number of cases."""
    return traces(log).groupBy("variant").agg(F.count(F.lit(1)).alias("cases"))


def counts(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("case_id").alias("cases"), F.count(F.lit(1)).alias("events"))


def activities(log: DataFrame) -> DataFrame:
    return log.select("activity").distinct().orderBy("activity")


def resources(log: DataFrame) -> DataFrame:
    return log.where("resource <> ''").select("resource").distinct().orderBy("resource")


def cases(log: DataFrame) -> DataFrame:
    """``case_id, events, start_ts, end_ts, duration_us``; a case of one event lasts 0."""
    per = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return per.withColumn("duration_us", micros("end_ts") - micros("start_ts"))


def summary(log: DataFrame) -> DataFrame:
    """One row on the whole log; durations in microseconds, the mean case duration by whole division."""
    per = traces(log).select(F.size("events").alias("events"), "variant", F.element_at("events", 1).ts.alias("start_ts"), F.element_at("events", -1).ts.alias("end_ts"))
    per = per.withColumn("duration_us", micros("end_ts") - micros("start_ts"))
    whole = per.agg(
        F.count(F.lit(1)).alias("cases"),
        F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("events"),
        F.countDistinct("variant").alias("variants"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        # Microseconds of many long cases exceed a long.
        F.coalesce(F.sum(F.col("duration_us").cast("decimal(38,0)")), F.lit(0)).alias("total_us"),
    )
    names = log.agg(F.countDistinct("activity").alias("activities"), F.countDistinct(F.when(F.col("resource") != "", F.col("resource"))).alias("resources"))
    return whole.crossJoin(names).select(
        "cases",
        "events",
        "activities",
        "resources",
        "variants",
        "start_ts",
        "end_ts",
        F.coalesce(micros("end_ts") - micros("start_ts"), F.lit(0)).alias("span_us"),
        F.when(F.col("cases") > 0, F.col("events") / F.col("cases")).otherwise(F.lit(0.0)).alias("events_per_case"),
        F.when(F.col("cases") > 0, F.expr("total_us div cases")).otherwise(F.lit(0)).alias("mean_duration_us"),
    )


def sessions(df: DataFrame, key: str, ts: str, gap: str, seq: str) -> DataFrame:
    """``df`` with ``session``: per key, from 0, a new one after a silence longer than ``gap``."""
    w = Window.partitionBy(key).orderBy(ts, seq)
    silent = F.col(ts) - F.lag(ts).over(w) > F.expr(f"interval {gap}")
    return df.withColumn("__new", F.coalesce(silent, F.lit(False)).cast("int")).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
