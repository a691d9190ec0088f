"""Token replay of logs on nets: fitness, precision and their harmonic mean.

Cases with the same variant replay alike. Over a whole log each distinct variant is replayed once, in Arrow batches, and
weighs as many cases as have it; case by case, a task replays each variant that it meets once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.net import Net
from .log import traces

_REPLAY = "produced long, consumed long, missing long, remaining long, fitness double, fitting boolean, fired array<string>, missing_activities array<string>"


class Replayer:
    """Arcs of a net in the form that replay needs; a later arc between the same nodes replaces an earlier one as input."""

    def __init__(self, net: Net):
        weight = lambda a: int(a.total) or 1
        self.transition = net.activity_map()
        self.inputs = {t: {a.source: weight(a) for a in net.arcs if a.target == t} for t in net.transitions}
        self.demands = {t: [(a.source, weight(a)) for a in net.arcs if a.target == t] for t in net.transitions}
        self.outputs = {t: [(a.target, weight(a)) for a in net.arcs if a.source == t] for t in net.transitions}
        self.initial = {k: n for k, p in net.places.items() if (n := sum(int(c) for c in p.initial)) > 0}
        self.has_end = "end" in net.places

    def replay(self, variant: list[str]) -> tuple:
        """Token counts of one trace.

        Activities that the net does not have count as one missing token. A transition that lacks tokens is fired all
        the same, on what there is. Tokens left count as remaining but in the place ``end``, which costs one if empty.
        A trace's fitness is never below 0, and 1 if nothing was consumed.
        """
        marking = dict(self.initial)
        produced, consumed, missing = sum(marking.values()), 0, 0
        fired, lacking = [], []
        for activity in variant:
            t = self.transition.get(activity)
            if t is None:
                missing += 1
                lacking.append(activity)
                continue
            short = 0
            for place, n in self.inputs[t].items():
                have = marking.get(place, 0)
                consumed += n
                short += max(0, n - have)
                marking[place] = max(0, have - n)
            for place, n in self.outputs[t]:
                marking[place] = marking.get(place, 0) + n
                produced += n
            missing += short
            (lacking if short else fired).append(activity if short else t)
        remaining = sum(n for p, n in marking.items() if p != "end" and n > 0)
        if self.has_end and marking.get("end", 0) <= 0:
            remaining += 1
        fitness = max(0.0, 0.5 * (1 - missing / consumed) + 0.5 * (1 - remaining / produced)) if consumed and produced else 1.0
        return produced, consumed, missing, remaining, fitness, missing == 0 and remaining == 0, fired, lacking

    def visits(self, variant: list[str]) -> list[tuple[str, list[str], str | None]]:
        """(marking before, transitions enabled in it, transition taken) of each event; here an input without enough
        tokens is left as it is."""
        marking, out = dict(self.initial), []
        for activity in variant:
            key = ",".join(f"{p}:{n}" for p, n in sorted(marking.items()) if n > 0)
            enabled = [t for t in sorted(self.demands) if all(marking.get(p, 0) >= n for p, n in self.demands[t])]
            t = self.transition.get(activity)
            out.append((key, enabled, t))
            if t is not None:
                for p, n in self.demands[t]:
                    if marking.get(p, 0) >= n:
                        marking[p] -= n
                for p, n in self.outputs[t]:
                    marking[p] = marking.get(p, 0) + n
        return out


def _replayed(net: Net, variant: str) -> Column:
    """The counts of a variant's replay; a task keeps those of the variants that it met last."""
    replayer = Replayer(net)

    @F.pandas_udf(_REPLAY)
    def replayed(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _REPLAY.split(", ")]
        known: dict[tuple, tuple] = {}
        for variants in it:
            out = []
            for v in map(tuple, variants):
                if v not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[v] = replayer.replay(list(v))
                out.append(known[v])
            yield pd.DataFrame(out, columns=names)

    return replayed(variant)


def replay_variants(log: DataFrame, net: Net) -> DataFrame:
    """``variant, cases`` and the counts of its replay."""
    per = traces(log).groupBy("variant").agg(F.count(F.lit(1)).alias("cases"))
    return per.withColumn("r", _replayed(net, "variant")).select("variant", "cases", "r.*")


def replay(log: DataFrame, net: Net) -> DataFrame:
    """``case_id, variant`` and the counts of its replay; the only shuffle is that of traces, by case."""
    return traces(log).select("variant", "case_id", _replayed(net, "variant").alias("r")).select("variant", "case_id", "r.*")


def fitness(log: DataFrame, net: Net) -> DataFrame:
    """One row on the whole log; its fitness is of the summed counts and may fall below 0."""
    per = replay_variants(log, net)
    weigh = lambda c: F.coalesce(F.sum(F.col(c) * F.col("cases")), F.lit(0)).alias(c)
    out = per.agg(
        F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"),
        F.coalesce(F.sum(F.when(F.col("fitting"), F.col("cases"))), F.lit(0)).alias("fitting_cases"),
        *[weigh(c) for c in ("produced", "consumed", "missing", "remaining")],
        F.coalesce(F.sum(F.col("fitness") * F.col("cases")) / F.sum("cases"), F.lit(0.0)).alias("mean_case_fitness"),
    )
    overall = 0.5 * (1 - F.col("missing") / F.col("consumed")) + 0.5 * (1 - F.col("remaining") / F.col("produced"))
    whole = F.when((F.col("consumed") > 0) & (F.col("produced") > 0), overall).when(F.col("cases") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    percent = F.when(F.col("cases") > 0, F.col("fitting_cases") / F.col("cases") * 100).otherwise(F.lit(0.0))
    return out.withColumn("fitness", whole).withColumn("fitting_percent", percent)


def precision(log: DataFrame, net: Net) -> DataFrame:
    """One row: ``states, enabled, escaping, precision``, over the distinct markings that replay visits."""
    replayer = Replayer(net)

    @F.pandas_udf("array<struct<state:string,enabled:array<string>,taken:string>>")
    def visited(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for variants in it:
            yield pd.Series([[{"state": s, "enabled": e, "taken": t} for s, e, t in replayer.visits(list(v))] for v in variants])

    per = traces(log).select("variant").distinct().select(F.explode(visited("variant")).alias("v")).select("v.*").distinct()
    states = per.groupBy("state").agg(F.first("enabled").alias("enabled"), F.collect_set("taken").alias("taken"))
    sizes = states.select(F.size("enabled").alias("n"), F.size(F.array_except("enabled", "taken")).alias("e"))
    out = sizes.agg(F.count(F.lit(1)).alias("states"), F.coalesce(F.sum("n"), F.lit(0)).alias("enabled"), F.coalesce(F.sum("e"), F.lit(0)).alias("escaping"))
    return out.withColumn("precision", F.when(F.col("enabled") > 0, 1 - F.col("escaping") / F.col("enabled")).otherwise(F.lit(1.0)))


def conformance(log: DataFrame, net: Net) -> DataFrame:
    """One row: ``fitness, precision, f_score``, the harmonic mean, 0 if their sum is not positive."""
    both = fitness(log, net).select("fitness").crossJoin(precision(log, net).select("precision"))
    total = F.col("fitness") + F.col("precision")
    return both.withColumn("f_score", F.when(total > 0, 2 * F.col("fitness") * F.col("precision") / total).otherwise(F.lit(0.0)))


def not_fitting(replayed: DataFrame) -> DataFrame:
    return replayed.where("not fitting")


def by_fitness(replayed: DataFrame) -> DataFrame:
    return replayed.orderBy("fitness", "case_id")
