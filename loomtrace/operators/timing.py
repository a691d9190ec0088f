"""Durations, inter-arrival times and rates of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .log import in_case, cases, micros

DEFAULT_RATE = 0.1


def durations(log: DataFrame) -> DataFrame:
    """``activity, seconds``: from each event to the next of its case; a case's last event has none."""
    gap = (micros(F.lead("ts").over(in_case())) - micros("ts")) / 1e6
    return log.select("activity", gap.alias("seconds")).where("seconds is not null")


def activity_timing(log: DataFrame) -> DataFrame:
    """``activity, events, n, mean_s, std_s, rate``: sample deviation, 0 for fewer than two; the rate is one over the
    mean, or 0.1 where the mean is not positive or there is none."""
    gap = (micros(F.lead("ts").over(in_case())) - micros("ts")) / 1e6
    per = log.select("activity", gap.alias("s")).groupBy("activity").agg(F.count(F.lit(1)).alias("events"), F.count("s").alias("n"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("mean_s"), F.coalesce(F.when(F.count("s") > 1, F.stddev_samp("s")), F.lit(0.0)).alias("std_s"))
    return per.withColumn("rate", F.when(F.col("mean_s") > 0, 1 / F.col("mean_s")).otherwise(F.lit(DEFAULT_RATE)))


def inter_arrivals(log: DataFrame) -> DataFrame:
    """``case_id, seconds`` between the starts of a case and of the one before it.

    Starts are dealt over ranges of time and case of about the same number of rows, so cases that start together are
    still spread; only the last start of each range meets the next range.
    """
    starts = cases(log).select("case_id", micros("start_ts").alias("us"))
    # Stored, as the ranges are drawn by sampling.
    dealt = cut(starts.repartitionByRange("us", "case_id").withColumn("part", F.spark_partition_id()))
    inside = dealt.withColumn("before", F.lag("us").over(Window.partitionBy("part").orderBy("us", "case_id")))
    lasts = dealt.groupBy("part").agg(F.max("us").alias("last"))
    edges = lasts.select("part", F.lag("last").over(Window.orderBy("part")).alias("edge"))  # a row for each range
    return inside.join(F.broadcast(edges), "part").select("case_id", ((F.col("us") - F.coalesce("before", "edge")) / 1e6).alias("seconds")).where("seconds is not null")


def timing_report(log: DataFrame) -> DataFrame:
    """One row: mean inter-arrival time and mean case duration in seconds, and how many of each."""
    gaps = inter_arrivals(log).agg(F.count(F.lit(1)).alias("arrivals"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean_inter_arrival_s"))
    lasting = cases(log).agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.avg(F.col("duration_us") / 1e6), F.lit(0.0)).alias("mean_case_s"))
    return gaps.crossJoin(lasting)


def rates_for(log: DataFrame, transitions: DataFrame) -> DataFrame:
    """``id, rate`` for each transition, by its id; 0.1 for those that the log does not have."""
    learned = activity_timing(log).select(F.col("activity").alias("id"), "rate")
    return transitions.select("id").join(learned, "id", "left").select("id", F.coalesce("rate", F.lit(DEFAULT_RATE)).alias("rate"))


def compare_to_log(simulated: DataFrame, log: DataFrame) -> DataFrame:
    """``activity, mean_diff, rmse``: simulated durations against those of a log, by activity, and a row with a null
    activity for all.

    ``simulated`` has ``activity, seconds``, a row per simulated event that has a next one in its run. ``mean_diff`` is
    the simulated mean less the log's; ``rmse`` compares quantiles, from 0 to 1 by twentieths, as neither side's events
    pair with the other's. Activities that only one side has are left out.
    """
    shares = F.array(*[F.lit(i / 20) for i in range(21)])
    per = lambda df, name: df.groupBy("activity").agg(F.avg("seconds").alias(f"{name}_mean"), F.percentile("seconds", shares).alias(f"{name}_q"))
    both = per(simulated.select("activity", "seconds"), "sim").join(per(durations(log), "log"), "activity")
    square = F.aggregate(F.zip_with("sim_q", "log_q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    rows = both.select("activity", (F.col("sim_mean") - F.col("log_mean")).alias("mean_diff"), (square / 21).alias("mse"))
    whole = rows.agg(F.lit(None).cast("string").alias("activity"), F.avg("mean_diff").alias("mean_diff"), F.avg("mse").alias("mse")).where("mse is not null")
    return rows.unionByName(whole).select("activity", "mean_diff", F.sqrt("mse").alias("rmse"))


def rate_functions(log: DataFrame, transitions: DataFrame) -> dict:
    """A constant rate function per transition."""
    return {r.id: (lambda state, t, rate=r.rate: rate) for r in rates_for(log, transitions).collect()}
