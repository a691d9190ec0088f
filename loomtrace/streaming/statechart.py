"""Statecharts with parallel regions and nested states, as ordered folds per key."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..plans.net import Net
from .keyed import Fold, fold_batch, fold_stream

Action = Callable[[dict[str, float]], None]
Guard = Callable[[Mapping[str, float]], bool]


def increment(name: str, by: float = 1.0) -> Action:
    def act(counters: dict[str, float]) -> None:
        counters[name] = counters.get(name, 0.0) + by

    return act


def assign(name: str, value: float) -> Action:
    def act(counters: dict[str, float]) -> None:
        counters[name] = value

    return act


def callback(name: str, f: Callable[[Mapping[str, float]], None]) -> Action:
    return lambda counters: f(dict(counters))


@dataclass
class Move:
    event: str
    source: str
    target: str
    guard: Guard | None = None
    actions: list[Action] = field(default_factory=list)


@dataclass
class Chart:
    """Regions hold states by path (``region:state.substate``); a region starts in its first state, a state with
    substates in the first of them."""

    name: str
    regions: dict[str, list[str]] = field(default_factory=dict)
    moves: list[Move] = field(default_factory=list)
    counters: dict[str, float] = field(default_factory=dict)

    def region(self, name: str, *states: str) -> Chart:
        self.regions[name] = list(states)
        return self

    def counter(self, name: str, initial: float = 0.0) -> Chart:
        self.counters[name] = initial
        return self

    def when(self, event: str, source: str, target: str, guard: Guard | None = None, *actions: Action) -> Chart:
        """A move between states of one region, each as ``region:path``."""
        if source.partition(":")[0] != target.partition(":")[0]:
            raise ValueError("a move stays in its region")
        self.moves.append(Move(event, source, target, guard, list(actions)))
        return self

    def inner(self, region: str, path: str) -> str:
        """The state that entering a path leads to: the path itself, or its first substate, and so on."""
        while True:
            below = next((s for s in self.regions[region] if s.startswith(f"{path}.") and "." not in s[len(path) + 1 :]), None)
            if below is None:
                return path
            path = below

    def start(self) -> dict[str, str]:
        return {r: self.inner(r, states[0]) for r, states in self.regions.items() if states}

    def net(self) -> Net:
        """A place for each state and counter and a transition for each move."""
        out, first = Net(), self.start()
        for r, states in self.regions.items():
            for s in states:
                out.place(f"{r}:{s}", 1.0 if first.get(r) == s else 0.0)
        for c, n in self.counters.items():
            out.place(c, n)
        for i, m in enumerate(self.moves):
            region, _, path = m.target.partition(":")
            out.transition(f"{m.event}_{i}", "event", m.event)
            out.arc(m.source, f"{m.event}_{i}").arc(f"{m.event}_{i}", f"{region}:{self.inner(region, path)}")
        return out


class Machine:
    """A chart's current states and counters."""

    def __init__(self, chart: Chart, held: Mapping | None = None):
        self.chart = chart
        self.states = dict(held["states"]) if held else chart.start()
        self.counters = dict(held["counters"]) if held else dict(chart.counters)

    def send(self, event: str) -> bool:
        """In each region the first move that fits is made: from the current state or one that holds it. Whether any
        was."""
        moved = False
        for region in self.chart.regions:
            for m in self.chart.moves:
                r, _, path = m.source.partition(":")
                if m.event == event and r == region and self.is_in(m.source) and (m.guard is None or m.guard(dict(self.counters))):
                    self.states[region] = self.chart.inner(region, m.target.partition(":")[2])
                    for action in m.actions:
                        action(self.counters)
                    moved = True
                    break
        return moved

    def state(self, region: str) -> str:
        """The outermost state."""
        return self.states[region].partition(".")[0]

    def substate(self, region: str, state: str) -> str:
        """What lies below a state that is active, else an empty string."""
        full = self.states[region]
        return full[len(state) + 1 :] if full.startswith(f"{state}.") else ""

    def full_state(self, region: str) -> str:
        return self.states[region]

    def is_in(self, path: str) -> bool:
        region, _, state = path.partition(":")
        return self.states.get(region) == state or self.states.get(region, "").startswith(f"{state}.")

    def counter(self, name: str) -> int:
        return int(self.counters.get(name, 0))


def chart_fold(chart: Chart) -> Fold:
    def fold(key: tuple, held: dict | None, rows: list[dict]) -> tuple[dict | None, list[dict]]:
        machine = Machine(chart, held)
        out = []
        for r in rows:
            moved = machine.send(r["event"])
            out.append({"key": str(key[0]), "seq": int(r["seq"]), "event": r["event"], "moved": moved, "state": ";".join(f"{k}:{v}" for k, v in sorted(machine.states.items()))})
        return {"states": machine.states, "counters": machine.counters}, out

    return fold


def run_chart(events: DataFrame, chart: Chart) -> DataFrame:
    """``key, seq, event, moved, state`` for events (``key, seq, event``) of a table or a stream."""
    run = fold_stream if events.isStreaming else fold_batch
    return run(events.select("key", "seq", "event"), ["key"], ["seq"], chart_fold(chart), "key string, seq long, event string, moved boolean, state string")
