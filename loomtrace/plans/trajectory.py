"""Analytics of trajectories and other series, as window and aggregate expressions.

A series table has ``run_id, step, t, place, value``; windows run within a run's variable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _steps() -> WindowSpec:
    return Window.partitionBy("run_id", "place").orderBy("step")


def extrema(series: DataFrame) -> DataFrame:
    """``run_id, place, kind, t, value, prominence`` of strict local maxima and minima inside a series.

    A peak's prominence is its height above the higher of the least values on either side; troughs have none.
    """
    before, after = F.lag("value").over(_steps()), F.lead("value").over(_steps())
    low = F.greatest(F.min("value").over(_steps().rowsBetween(Window.unboundedPreceding, -1)), F.min("value").over(_steps().rowsBetween(1, Window.unboundedFollowing)))
    kind = F.when((F.col("value") > before) & (F.col("value") > after), "peak").when((F.col("value") < before) & (F.col("value") < after), "trough")
    out = series.withColumn("kind", kind).withColumn("prominence", F.col("value") - low).where("kind is not null")
    return out.select("run_id", "place", "kind", "t", "value", F.when(F.col("kind") == "peak", F.col("prominence")).alias("prominence"))


def downsample(series: DataFrame, points: int) -> DataFrame:
    """At most ``points`` evenly spread steps of each run, both ends among them, numbered anew."""
    k = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    sized = series.groupBy("run_id").agg((F.max("step") + 1).alias("n"))
    wanted = sized.where(F.col("n") > points).select("run_id", "n", k.alias("k"))
    wanted = wanted.select("run_id", "k", F.floor(F.col("k") * (F.col("n") - 1) / (points - 1) + 0.5).cast("int").alias("step"))
    all_ = sized.where(F.col("n") <= points).select("run_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select("run_id", "k", F.col("k").alias("step"))
    return series.join(wanted.union(all_), ["run_id", "step"]).select("run_id", F.col("k").alias("step"), "t", "place", "value")


def at_times(series: DataFrame, times: DataFrame) -> DataFrame:
    """The sample nearest to each of ``times`` (``run_id, at``), the first of those as near.

    Only the samples before and after a time are compared: they meet by one sort of samples and times.
    """
    return _around(series, times).select("run_id", "at", "place", F.when(F.col("t1").isNull() | (F.col("at") - F.col("t0") <= F.col("t1") - F.col("at")), F.col("v0")).otherwise(F.col("v1")).alias("value"))


def interpolate(series: DataFrame, times: DataFrame) -> DataFrame:
    """Values at ``times`` on straight lines between samples; those of the ends beyond them."""
    x = _around(series, times)
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0.0))
    return x.select("run_id", "at", "place", F.coalesce(line, "v0", "v1").alias("value"))


def _around(series: DataFrame, times: DataFrame) -> DataFrame:
    """The samples at or before and after each time, of each place."""
    places = series.select("run_id", "place").distinct()
    asked = times.join(places, "run_id").select("run_id", "place", F.col("at").alias("t"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("asked"))
    both = series.select("run_id", "place", "t", "value", F.lit(0).alias("asked")).unionByName(asked)
    w = Window.partitionBy("run_id", "place").orderBy("t", "asked")
    sample = F.when(F.col("asked") == 0, F.struct("t", "value"))
    both = both.withColumn("s", sample)
    both = both.withColumn("p", F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.first("s", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return both.where("asked = 1").select("run_id", "place", F.col("t").alias("at"), F.coalesce("p.t", "n.t").alias("t0"), F.coalesce("p.value", "n.value").alias("v0"), F.when(F.col("p").isNotNull(), F.col("n.t")).alias("t1"), F.when(F.col("p").isNotNull(), F.col("n.value")).alias("v1"))


def crossings(series: DataFrame) -> DataFrame:
    """``run_id, var1, var2, t, value`` where two variables change sides, by straight lines; a touch is none."""
    x, y = series.alias("x"), series.alias("y")
    both = x.join(y, (F.col("x.run_id") == F.col("y.run_id")) & (F.col("x.step") == F.col("y.step")) & (F.col("x.place") < F.col("y.place")))
    d = both.select(F.col("x.run_id"), F.col("x.step"), F.col("x.t"), F.col("x.place").alias("var1"), F.col("y.place").alias("var2"), F.col("x.value").alias("v1"), (F.col("x.value") - F.col("y.value")).alias("d"))
    w = Window.partitionBy("run_id", "var1", "var2").orderBy("step")
    d = d.withColumn("d2", F.lead("d").over(w)).withColumn("t2", F.lead("t").over(w)).withColumn("v2", F.lead("v1").over(w)).where("d * d2 < 0")
    at = F.col("t") + (F.col("t2") - F.col("t")) * (-F.col("d")) / (F.col("d2") - F.col("d"))
    d = d.withColumn("at", at)
    return d.select("run_id", "var1", "var2", F.col("at").alias("t"), (F.col("v1") + (F.col("v2") - F.col("v1")) * (F.col("at") - F.col("t")) / (F.col("t2") - F.col("t"))).alias("value"))


def steady_state(series: DataFrame, tolerance: float = 0.01, duration: float = 10.0) -> DataFrame:
    """``run_id, reached, t``: whether every variable comes to rest, and the earliest time at which one does.

    A variable rests at a step if none of the relative changes of the steps in the window before it reaches the
    tolerance; changes from zero do not count. The window has ``duration`` over the first step's length, at least 2 and
    at most half of the steps. The length differs by run, so running positions of the last large change decide, not a
    frame of fixed size.
    """
    per = series.groupBy("run_id").agg((F.max("step") + 1).alias("n"), (F.max(F.when(F.col("step") == 1, F.col("t"))) - F.max(F.when(F.col("step") == 0, F.col("t")))).alias("dt"), F.max("t").alias("last"))
    size = F.least(F.greatest(F.floor(F.lit(duration) / F.col("dt")), F.lit(2)), F.floor(F.col("n") / 2)).cast("int")
    per = per.withColumn("w", size)
    change = F.abs((F.col("value") - F.lag("value").over(_steps())) / F.nullif(F.lag("value").over(_steps()), F.lit(0.0)))
    marked = series.withColumn("big", F.when(change >= tolerance, F.col("step")))
    marked = marked.withColumn("last_big", F.max("big").over(_steps().rowsBetween(Window.unboundedPreceding, 0))).join(per, "run_id")
    # The window before step i holds the changes of steps i - w + 1 to i.
    rests = (F.col("step") >= F.col("w")) & (F.coalesce("last_big", F.lit(-1)) <= F.col("step") - F.col("w"))
    each = marked.groupBy("run_id", "place").agg(F.min(F.when(rests, F.col("t"))).alias("t"), F.max("last").alias("last"))
    out = each.groupBy("run_id").agg(F.bool_and(F.col("t").isNotNull()).alias("reached"), F.least(F.min("t"), F.max("last")).alias("t"))
    return out.withColumn("t", F.when(F.col("reached"), F.col("t")))


def conservation(series: DataFrame) -> DataFrame:
    """``run_id, initial, final, conserved``: totals at both ends, equal within a millionth."""
    ends = series.groupBy("run_id", "place").agg(F.min_by("value", "step").alias("a"), F.max_by("value", "step").alias("b"))
    out = ends.groupBy("run_id").agg(F.sum("a").alias("initial"), F.sum("b").alias("final"))
    return out.withColumn("conserved", F.abs(F.col("final") - F.col("initial")) < 1e-6)


def statistics(series: DataFrame) -> DataFrame:
    """``run_id, place, min, max, mean, median, std``, the deviation of the whole population."""
    return series.groupBy("run_id", "place").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"))


def metrics(series: DataFrame) -> DataFrame:
    """``run_id, max_peak, max_peak_place, max_peak_t, steady, steady_t, conserved``, for ranking runs."""
    peaks = extrema(series).where("kind = 'peak' and value > 0").groupBy("run_id").agg(F.max_by(F.struct("value", "place", "t"), F.struct("value", (-F.col("t")).alias("early"))).alias("p"))
    base = series.select("run_id").distinct()
    out = base.join(peaks, "run_id", "left").join(steady_state(series), "run_id", "left").join(conservation(series).select("run_id", "conserved"), "run_id", "left")
    return out.select("run_id", F.coalesce("p.value", F.lit(0.0)).alias("max_peak"), F.col("p.place").alias("max_peak_place"), F.col("p.t").alias("max_peak_t"), F.col("reached").alias("steady"), F.col("t").alias("steady_t"), "conserved")


def objective(name: str) -> Column:
    """The expression of an objective on rows that have ``final map<string,double>`` and the columns of
    :func:`metrics`; lower is better, null where it is not defined."""
    peak = F.when(F.col("max_peak_place").isNotNull(), F.col("max_peak"))
    through = F.coalesce(*[F.try_element_at("final", F.lit(k)) for k in ("Completed", "Output", "Done")])
    return {
        "minimize_peak": peak,
        "maximize_peak": -peak,
        "minimize_final": F.aggregate(F.map_values("final"), F.lit(0.0), lambda a, b: a + b),
        "maximize_throughput": -through,
        "minimize_time_to_steady": F.when(F.col("steady"), F.col("steady_t")).otherwise(F.lit(1.7976931348623157e308)),
    }[name]


def compare(base: DataFrame, variant: DataFrame) -> DataFrame:
    """``place, base, variant, difference, percent`` of two runs' final states."""
    end = lambda s, name: s.groupBy("place").agg(F.max_by("value", "step").alias(name))
    both = end(base, "base").join(end(variant, "variant"), "place", "full")
    d = F.coalesce("variant", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))
    return both.withColumn("difference", d).withColumn("percent", F.when(F.col("base") != 0, d / F.col("base") * 100))


def compare_runs(series: DataFrame, base: int, variant: int) -> DataFrame:
    """``measure, base, variant, difference`` of two runs' highest peak, its time, the time of rest and the total drift."""
    m = metrics(series).join(conservation(series).select("run_id", (F.col("final") - F.col("initial")).alias("drift")), "run_id")
    names = ("max_peak", "max_peak_t", "steady_t", "drift")
    long = m.select("run_id", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("run_id", "x.*")
    side = lambda run, name: long.where(F.col("run_id") == run).select("measure", F.col("value").alias(name))
    return side(base, "base").join(side(variant, "variant"), "measure", "full").withColumn("difference", F.col("variant") - F.col("base"))
