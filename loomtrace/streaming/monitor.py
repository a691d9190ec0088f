"""Monitoring of live cases: state estimates, forecasts and alerts, over streams and tables alike.

Events have ``case_id, activity, ts, seq`` and ``kind``: ``start`` opens a case, ``event`` is an activity, ``complete``
closes it. The time of an event is the clock; a case may be re-assessed at any other time by an event of kind ``tick``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.net import Net
from ..plans.ode import OPTIONS, Options, Trajectory, solve
from .keyed import Fold, fold_batch, fold_stream

HORIZON_S = 86_400.0
#: Steps of a minute at first, ten minutes at most.
FORECAST = Options(60.0, 0.1, 600.0, 1e-6, 1e-4, 10_000)

OUTPUT_SQL = "case_id string, ts timestamp, activity string, remaining_s double, confidence double, risk double, next_activity string, alert string, severity string, message string"


@dataclass(frozen=True)
class Config:
    sla_s: float = 0.0
    stuck_s: float = 3600.0
    predictions: bool = True
    alerts: bool = True


def estimate(net: Net, activities: list[str], state: Mapping[str, float] | None = None) -> dict[str, float]:
    """The marking after activities, from a token in ``start``; unknown ones are skipped, missing tokens are forgiven."""
    out = dict(state) if state else dict.fromkeys(net.places, 0.0) | {"start": 1.0}
    for a in activities:
        if a not in net.transitions:
            continue
        for arc in net.arcs:
            if arc.target == a and arc.source in net.places:
                out[arc.source] = max(0.0, out[arc.source] - arc.total)
            elif arc.source == a and arc.target in net.places:
                out[arc.target] = out.get(arc.target, 0.0) + arc.total
    return out


def enabled(net: Net, state: Mapping[str, float]) -> list[str]:
    return [t for t in sorted(net.transitions) if all(state.get(a.source, 0.0) >= a.total for a in net.inputs(t) if a.source in net.places)]


def next_activities(net: Net, rates: Mapping[str, float], state: Mapping[str, float]) -> list[tuple[str, float, int]]:
    """(activity, probability, expected whole seconds) of enabled transitions that race; a rate of 0 counts as 1."""
    flux = {}
    for t in enabled(net, state):
        f = rates.get(t, 0.0) or 1.0
        for a in net.inputs(t):
            if a.source in net.places:
                f *= max(0.0, state.get(a.source, 0.0))
        if f > 0:
            flux[t] = f
    whole = sum(flux.values())
    return [(t, f / whole, int(1 / f)) for t, f in flux.items()]


def remaining(net: Net, rates: Mapping[str, float], state: Mapping[str, float]) -> tuple[float, float]:
    """(seconds until ``end`` holds half a token, tokens in ``end`` at the horizon of a day)."""
    path = solve(net, state, rates, (0.0, HORIZON_S), options=FORECAST)
    if "end" not in path.labels:
        return HORIZON_S, 0.0
    end = path.variable("end")
    return next((float(t) for t, x in zip(path.t, end, strict=True) if x >= 0.5), HORIZON_S), float(end[-1])


def case_fold(net: Net, rates: Mapping[str, float], config: Config = Config()) -> Fold:
    """The fold of one case: an output row for each event after which the case is assessed, with an alert if there is
    one. Unknown cases and cases that start twice give a row with the alert ``rejected``."""

    known: dict[tuple, tuple] = {}  # forecasts of a worker by state, as cases share few states

    def forecast(state: dict[str, float]) -> tuple:
        key = tuple(sorted(state.items()))
        if key not in known:
            if len(known) > 10_000:
                known.clear()
            best = max(next_activities(net, rates, state), key=lambda x: (x[1], x[0]), default=(None,))[0]
            known[key] = (*remaining(net, rates, state), best)
        return known[key]

    def fold(key: tuple, held: dict | None, rows: list[dict]) -> tuple[dict | None, list[dict]]:
        out = []
        for r in rows:
            now = pd.Timestamp(r["ts"])
            row = {"case_id": key[0], "ts": now, "activity": r["activity"], "remaining_s": None, "confidence": None, "risk": None, "next_activity": None, "alert": None, "severity": None, "message": None}
            kind = r["kind"]
            if (kind == "start") == (held is not None):
                out.append(row | {"alert": "rejected", "severity": "warning", "message": "case is open already" if held else "case is not open"})
                continue
            if kind == "start":
                held = {"began": now.timestamp(), "last": now.timestamp(), "state": estimate(net, [])}
                continue
            if kind == "complete":
                held = None
                out.append(row)
                continue
            if kind == "event":
                held["state"] = estimate(net, [r["activity"]], held["state"])
            quiet = now.timestamp() - held["last"]
            if kind == "event":
                held["last"] = now.timestamp()
            if config.alerts and quiet > config.stuck_s:
                out.append(row | {"alert": "stuck", "severity": "warning", "message": f"inactive for {quiet / 60:.0f} minutes"})
            if config.predictions:
                left, sure, best = forecast(held["state"])
                row |= {"remaining_s": left, "confidence": sure, "next_activity": best}
                if config.sla_s > 0:
                    share = (now.timestamp() - held["began"] + left) / config.sla_s
                    row["risk"] = 0.9 if share > 1 else share
                    if config.alerts and share > 1:
                        row |= {"alert": "sla_violation", "severity": "critical", "message": f"expected to take {share * 100:.0f}% of its time"}
                    elif config.alerts and share > 0.8:
                        row |= {"alert": "delayed", "severity": "warning", "message": f"expected to take {share * 100:.0f}% of its time"}
            out.append(row)
        return held, out

    return fold


def monitor(events: DataFrame, net: Net, rates: Mapping[str, float], config: Config = Config(), every_s: float = 0.0) -> DataFrame:
    """Assessments of all cases of a table or a stream.

    On a stream, ``every_s`` seconds of processing time without an event make a case be assessed once more, at that
    time, and again after as long until it completes; 0 means never. A table has events of kind ``tick`` for that.
    """
    fold = case_fold(net, rates, config)
    if not events.isStreaming:
        return fold_batch(events, ["case_id"], ["ts", "seq"], fold, OUTPUT_SQL)

    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")

    def tick(key: tuple, held: dict, now_ms: int) -> tuple[dict | None, list[dict]]:
        now = pd.Timestamp(now_ms, unit="ms", tz="UTC").tz_convert(zone).tz_localize(None)
        return fold(key, held, [{"ts": now, "activity": None, "kind": "tick"}])

    return fold_stream(events, ["case_id"], ["ts", "seq"], fold, OUTPUT_SQL, every_s, tick if every_s > 0 else None)


def statistics(assessed: DataFrame) -> DataFrame:
    """``alert, severity, n``."""
    return assessed.where("alert is not null").groupBy("alert", "severity").agg(F.count(F.lit(1)).alias("n"))


def active_cases(events: DataFrame) -> DataFrame:
    """``case_id, started_at, last_ts, events`` of cases that are open."""
    n = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    out = events.groupBy("case_id").agg(F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("started_at"), F.max("ts").alias("last_ts"), n("event").cast("long").alias("events"), n("start").alias("opened"), n("complete").alias("closed"))
    return out.where("opened > closed").drop("opened", "closed")


# --- Rules over a running simulation --------------------------------------------

Condition = Callable[[Mapping[str, float]], bool]


def above(place: str, threshold: float) -> Condition:
    return lambda state: state.get(place, 0.0) > threshold


def below(place: str, threshold: float) -> Condition:
    return lambda state: state.get(place, 0.0) < threshold


def all_of(*conditions: Condition) -> Condition:
    return lambda state: all(c(state) for c in conditions)


def any_of(*conditions: Condition) -> Condition:
    return lambda state: any(c(state) for c in conditions)


class RuleEngine:
    """A net's state stepped through time, with rules looked at after each step. Actions get a copy of the state."""

    def __init__(self, net: Net, state: Mapping[str, float] | None = None, rates: Mapping[str, float] | None = None):
        self.net, self.state, self.rates = net, net.state(state), net.rates(rates)
        self.rules: list[tuple[str, Condition, Callable[[dict[str, float]], None]]] = []
        self.time = 0.0

    def set_state(self, changes: Mapping[str, float]) -> None:
        """Tokens of the places named become these."""
        self.state |= {k: float(v) for k, v in changes.items()}

    def update_rates(self, changes: Mapping[str, float]) -> None:
        self.rates |= {k: float(v) for k, v in changes.items()}

    def simulate(self, duration: float, options: Options = OPTIONS["default"]) -> Trajectory:
        """A run from the present state, which stays as it is."""
        return solve(self.net, self.state, self.rates, (0.0, duration), options=options)

    def rule(self, name: str, condition: Condition, action: Callable[[dict[str, float]], None]) -> RuleEngine:
        self.rules.append((name, condition, action))
        return self

    def step(self, dt: float) -> list[str]:
        """One step; the names of the rules that applied."""
        self.state = solve(self.net, self.state, self.rates, (self.time, self.time + dt)).final
        self.time += dt
        applied = [(n, a) for n, c, a in self.rules if c(dict(self.state))]
        for _, action in applied:
            action(dict(self.state))
        return [n for n, _ in applied]

    def run(self, ticks: DataFrame, dt: float) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that takes one step for each row of a stream of ticks."""
        def batch(rows: DataFrame, _: int) -> None:
            for _ in range(rows.count()):
                self.step(dt)

        return batch


def rule_column(conditions: Mapping[str, Column]) -> Column:
    """Names of the conditions that hold on a row of states."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
