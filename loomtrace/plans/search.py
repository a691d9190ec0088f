"""Sweeps, sensitivity and hypotheses: tables of runs, simulated by the kernel and ranked by DataFrame.

A scorer is a function of a :class:`~loomtrace.plans.ode.Trajectory`. Runs are independent rows, spread over tasks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .net import Net
from .ode import OPTIONS, Options, Trajectory, final_states, simulate, solve
from .trajectory import metrics, objective

Scorer = Callable[[Trajectory], float]

RUNS_SQL = "run_id long, state map<string,double>, rates map<string,double>, t0 double, t1 double"


def final_scorer(f: Callable[[dict[str, float]], float]) -> Scorer:
    return lambda path: f(path.final)


def place_scorer(place: str) -> Scorer:
    return lambda path: path.final.get(place, 0.0)


def difference_scorer(a: str, b: str) -> Scorer:
    return lambda path: path.final.get(a, 0.0) - path.final.get(b, 0.0)


def linspace(low: float, high: float, n: int) -> list[float]:
    """``n`` values from ``low`` to ``high``, both included; one value is ``low``."""
    return [low + (high - low) * i / (n - 1) for i in range(n)] if n > 1 else [low] * n


def parse_sweep(spec: str) -> dict[str, list[float]]:
    """``name=min:max:count`` items, parted by commas, as values by name; a count is at least 2."""
    out = {}
    for item in filter(None, (s.strip() for s in spec.split(","))):
        name, _, grid = item.partition("=")
        low, high, n = grid.split(":")
        if int(n) < 2:
            raise ValueError(f"{item}: a sweep takes two values or more")
        out[name.strip()] = linspace(float(low), float(high), int(n))
    return out


def grid(spark: SparkSession, parameters: Mapping[str, Sequence[float]]) -> DataFrame:
    """``combination long, parameters map<string,double>``: all combinations, the first name in order fastest.

    They are made from the numbers of combinations on executors, however many there are.
    """
    names = sorted(parameters)
    total = math.prod(len(parameters[n]) for n in names)
    entries, stride = [], 1
    for n in names:
        values = F.array(*[F.lit(float(v)) for v in parameters[n]])
        place = F.expr(f"cast((id div {stride}) % {len(parameters[n])} as int)")
        entries.append(F.struct(F.lit(n).alias("key"), F.get(values, place).alias("value")))
        stride *= len(parameters[n])
    cells = F.map_from_entries(F.array(*entries)) if entries else F.create_map().cast("map<string,double>")
    return spark.range(total).select(F.col("id").alias("combination"), cells.alias("parameters"))


def sweep(spark: SparkSession, net: Net, rates: Mapping[str, Sequence[float]], initials: Mapping[str, Sequence[float]], goal: str, t1: float = 100.0, points: int = 150, options: Options = OPTIONS["default"], method: str = "tsit5") -> DataFrame:
    """``run_id, parameters, score, rank`` and metrics of all combinations of rates and initial tokens.

    Trajectories are cut to ``points`` steps before they are analysed. Lower scores rank first, ties by run; runs for
    which the goal is not defined come last.
    """
    every = grid(spark, {**{f"r:{k}": v for k, v in rates.items()}, **{f"i:{k}": v for k, v in initials.items()}})
    pick = lambda prefix: F.map_from_entries(F.transform(F.filter(F.map_entries("parameters"), lambda e: e.key.startswith(prefix)), lambda e: F.struct(F.substring(e.key, 3, 1000).alias("key"), e.value.alias("value"))))
    base = F.create_map(*[F.lit(x) for kv in net.rates().items() for x in kv]) if net.transitions else F.create_map().cast("map<string,double>")
    merged = F.map_from_entries(F.transform(F.map_entries(base), lambda e: F.struct(e.key.alias("key"), F.coalesce(F.try_element_at(pick("r:"), e.key), e.value).alias("value"))))
    runs = every.select(F.col("combination").alias("run_id"), "parameters", pick("i:").alias("state"), merged.alias("rates"), F.lit(0.0).alias("t0"), F.lit(float(t1)).alias("t1"))
    paths = simulate(runs, net, method, options, points)
    ends = final_states(paths).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("final"))
    scored = runs.select("run_id", "parameters").join(metrics(paths), "run_id").join(ends, "run_id").withColumn("score", objective(goal))
    return rank(scored)


def rank(scored: DataFrame) -> DataFrame:
    """Rows with ``rank`` from 1 by rising score, numbered range by range."""
    return numbered(scored, [F.col("score").asc_nulls_last(), "run_id"], "rank").withColumn("rank", F.col("rank").cast("int"))


def recommendations(ranked: DataFrame) -> dict[str, str]:
    """What to change from the worst run to the best, by parameter, and how much lower the peak is."""
    rows = ranked.where("score is not null")
    best, worst = rows.orderBy("rank").first(), rows.orderBy(F.desc("rank")).first()
    if best is None:
        return {}
    out = {}
    for name, value in sorted(best.parameters.items()):
        old = worst.parameters[name]
        if value != old:
            percent = abs((value - old) / old * 100) if old else math.inf
            out[name[2:]] = f"{'increase' if value > old else 'decrease'} by {percent:.1f}% ({old:.6f} → {value:.6f})"
    if worst.max_peak:
        out["improvement"] = f"{(worst.max_peak - best.max_peak) / worst.max_peak * 100:.1f}% reduction in peak ({worst.max_peak:.2f} → {best.max_peak:.2f})"
    return out


def score_runs(runs: DataFrame, net: Net, scorer: Scorer, options: Options = OPTIONS["default"], method: str = "tsit5") -> DataFrame:
    """``runs`` (``run_id, state, rates, t0, t1`` and others) with ``score``, null where the scorer gives no number."""

    def scored(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            values = [float(scorer(solve(net, net.state(dict(r.state or {})), dict(r.rates or {}), (r.t0, r.t1), method, options))) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"run_id": batch["run_id"], "score": values})

    found = runs.select("run_id", "state", "rates", "t0", "t1").mapInPandas(scored, "run_id long, score double")
    return runs.join(found, "run_id")


class Sensitivity:
    """How a score answers to rates, one at a time or in grids."""

    def __init__(self, spark: SparkSession, net: Net, scorer: Scorer, state: Mapping[str, float] | None = None, rates: Mapping[str, float] | None = None, tspan: tuple[float, float] = (0.0, 10.0), options: Options = OPTIONS["default"], method: str = "tsit5"):
        self.spark, self.net, self.scorer, self.tspan, self.options, self.method = spark, net, scorer, tspan, options, method
        self.state, self.rates = net.state(state), net.rates(rates)

    def _scored(self, labelled: list[tuple[str, float | None, dict[str, float]]]) -> DataFrame:
        rows = [(i, name, value, self.state, rates, *map(float, self.tspan)) for i, (name, value, rates) in enumerate(labelled)]
        runs = self.spark.createDataFrame(rows, f"run_id long, transition string, rate double, {RUNS_SQL.partition(', ')[2]}")
        return score_runs(runs.repartition(max(1, min(len(rows), self.spark.sparkContext.defaultParallelism))), self.net, self.scorer, self.options, self.method)

    def knockouts(self) -> DataFrame:
        """``transition, score, impact, rank``: the score with each rate at 0, less that with all rates."""
        rows = [("", None, self.rates), *((t, 0.0, {**self.rates, t: 0.0}) for t in sorted(self.net.transitions))]
        scored = self._scored(rows)
        base = scored.where("transition = ''").select(F.col("score").alias("base"))
        out = scored.where("transition <> ''").crossJoin(base).select("transition", "score", (F.col("score") - F.col("base")).alias("impact"))
        return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("impact")), "transition")))

    def sweep(self, transition: str, values: Sequence[float]) -> DataFrame:
        """``rate, score, best, worst``: the first of the greatest and of the least score are marked."""
        scored = self._scored([(transition, float(v), {**self.rates, transition: float(v)}) for v in values])
        top, low = Window.orderBy(F.desc("score"), "run_id"), Window.orderBy("score", "run_id")
        return scored.select("run_id", "rate", "score", (F.row_number().over(top) == 1).alias("best"), (F.row_number().over(low) == 1).alias("worst"))

    def gradients(self, h: float = 0.0) -> DataFrame:
        """``transition, gradient`` by central differences of 2h; h is 1% of the rate, or 0.01 for a rate of 0."""
        rows = []
        for t in sorted(self.net.transitions):
            r = self.rates[t]
            step = h or (0.01 * r if r else 0.01)
            rows += [(t, step, {**self.rates, t: r + step}), (t, -step, {**self.rates, t: max(0.0, r - step)})]
        sides = self._scored(rows).groupBy("transition").agg(F.max_by("score", "rate").alias("up"), F.min_by("score", "rate").alias("down"), F.max("rate").alias("h"))
        return sides.select("transition", ((F.col("up") - F.col("down")) / (2 * F.col("h"))).alias("gradient"))

    def grid(self, parameters: Mapping[str, Sequence[float]]) -> DataFrame:
        """``combination, parameters, score, rank`` of all combinations of rates; the greatest score ranks first."""
        base = F.create_map(*[F.lit(x) for kv in self.rates.items() for x in kv])
        full = F.map_from_entries(F.transform(F.map_entries(base), lambda e: F.struct(e.key.alias("key"), F.coalesce(F.try_element_at("parameters", e.key), e.value).alias("value"))))
        state = F.create_map(*[F.lit(x) for kv in self.state.items() for x in kv])
        runs = grid(self.spark, parameters).select(F.col("combination").alias("run_id"), "parameters", state.alias("state"), full.alias("rates"), F.lit(float(self.tspan[0])).alias("t0"), F.lit(float(self.tspan[1])).alias("t1"))
        scored = score_runs(runs.repartition(self.spark.sparkContext.defaultParallelism), self.net, self.scorer, self.options, self.method)
        return numbered(scored.select(F.col("run_id").alias("combination"), "parameters", "score"), [F.desc("score"), "combination"], "rank").withColumn("rank", F.col("rank").cast("int"))


class Hypotheses:
    """Scores of changes to a state."""

    def __init__(self, spark: SparkSession, net: Net, rates: Mapping[str, float], scorer: Scorer, tspan: tuple[float, float] = (0.0, 5.0), options: Options = OPTIONS["fast"], infeasible: Callable[[dict[str, float]], bool] | None = None, infeasible_score: float = -math.inf):
        self.spark, self.net, self.rates, self.scorer, self.tspan, self.options = spark, net, dict(rates), scorer, tspan, options
        self.infeasible, self.infeasible_score = infeasible, infeasible_score

    def evaluate(self, base: Mapping[str, float], updates: Mapping[str, float] | None = None) -> float:
        state = {**base, **(updates or {})}
        if self.infeasible and self.infeasible(state):
            return self.infeasible_score
        return float(self.scorer(solve(self.net, state, self.rates, self.tspan, options=self.options)))

    def evaluate_many(self, base: Mapping[str, float], updates: Sequence[Mapping[str, float]]) -> DataFrame:
        """``index, score`` of each change, over tasks."""
        rows = [(i, {k: float(v) for k, v in {**base, **u}.items()}) for i, u in enumerate(updates)]
        evaluate = self._kernel()
        table = self.spark.createDataFrame(rows, "index long, state map<string,double>").repartition(max(1, min(len(rows), self.spark.sparkContext.defaultParallelism)))

        def scored(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in it:
                yield pd.DataFrame({"index": batch["index"], "score": [evaluate(dict(s)) for s in batch["state"]]})

        return table.mapInPandas(scored, "index long, score double")

    def _kernel(self) -> Callable[[dict[str, float]], float]:
        net, rates, scorer, tspan, options, infeasible, low = self.net, self.rates, self.scorer, self.tspan, self.options, self.infeasible, self.infeasible_score
        return lambda state: low if infeasible and infeasible(state) else float(scorer(solve(net, state, rates, tspan, options=options)))

    def best(self, base: Mapping[str, float], updates: Sequence[Mapping[str, float]]) -> tuple[int, float]:
        """The first change of greatest score, or (-1, -inf) if none scores above that."""
        if not updates:
            return -1, -math.inf
        top = self.evaluate_many(base, updates).where(F.col("score") > F.lit(-math.inf)).orderBy(F.desc("score"), "index").first()
        return (top["index"], top["score"]) if top else (-1, -math.inf)

    def compare(self, a: Mapping[str, float], b: Mapping[str, float]) -> int:
        x, y = self.evaluate(a), self.evaluate(b)
        return (x > y) - (x < y)

    def knockouts(self, state: Mapping[str, float]) -> dict[str, tuple[float, float]]:
        """(score, impact) with each transition's rate at 0."""
        base = self.evaluate(state)
        out = {}
        for t in sorted(self.net.transitions):
            other = Hypotheses(self.spark, self.net, {**self.rates, t: 0.0}, self.scorer, self.tspan, self.options, self.infeasible, self.infeasible_score)
            score = other.evaluate(state)
            out[t] = (score, score - base)
        return out


def combinations(parameters: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """All combinations on the driver, the first name in order fastest."""
    names = sorted(parameters)
    return [dict(zip(reversed(names), c, strict=True)) for c in itertools.product(*(parameters[n] for n in reversed(names)))]
