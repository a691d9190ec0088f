"""Petri nets as small driver-side models and as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

PLACES_SQL = "id string, initial array<double>, capacity array<double>, x double, y double, label string"
TRANSITIONS_SQL = "id string, role string, x double, y double, label string"
ARCS_SQL = "arc_no int, source string, target string, weight array<double>, inhibit boolean"


def floats(value: Any) -> list[float]:
    """Numbers and lists of numbers as a list of floats; anything else is empty."""
    if isinstance(value, bool) or value is None:
        return []
    if isinstance(value, (int, float)):
        return [float(value)]
    if isinstance(value, Sequence) and not isinstance(value, str):
        return [float(v) for v in value if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return []


@dataclass
class Place:
    id: str
    initial: list[float] = field(default_factory=list)
    capacity: list[float] = field(default_factory=list)
    x: float = 0.0
    y: float = 0.0
    label: str | None = None

    @property
    def tokens(self) -> float:
        return sum(self.initial)


@dataclass
class Transition:
    id: str
    role: str = "default"
    x: float = 0.0
    y: float = 0.0
    label: str | None = None


@dataclass
class Arc:
    source: str
    target: str
    weight: list[float] = field(default_factory=lambda: [1.0])
    inhibit: bool = False

    @property
    def total(self) -> float:
        """The weight over all colours; an arc without weights weighs 1."""
        return sum(self.weight) if self.weight else 1.0


@dataclass
class Net:
    """A net; methods that build return it, so that they can be chained. Adding an id again replaces it."""

    places: dict[str, Place] = field(default_factory=dict)
    transitions: dict[str, Transition] = field(default_factory=dict)
    arcs: list[Arc] = field(default_factory=list)
    colours: list[str] = field(default_factory=list)

    def place(self, id: str, initial: Any = 0.0, capacity: Any = None, label: str | None = None) -> Net:
        self.places[id] = Place(id, floats(initial), floats(capacity), label=label)
        return self

    def transition(self, id: str, role: str = "default", label: str | None = None) -> Net:
        self.transitions[id] = Transition(id, role, label=label)
        return self

    def arc(self, source: str, target: str, weight: Any = 1.0, inhibit: bool = False) -> Net:
        self.arcs.append(Arc(source, target, floats(weight), inhibit))
        return self

    def inhibitor(self, source: str, target: str, weight: Any = 1.0) -> Net:
        return self.arc(source, target, weight, True)

    def flow(self, source: str, transition: str, target: str, weight: Any = 1.0) -> Net:
        """An arc into a transition and one out of it."""
        return self.arc(source, transition, weight).arc(transition, target, weight)

    def chain(self, tokens: float, *elements: str) -> Net:
        """Places and transitions in turn, linked in order; the first place gets ``tokens``."""
        for i, e in enumerate(elements):
            if i % 2:
                self.transition(e)
            else:
                self.place(e, tokens if i == 0 else 0.0)
            if i:
                self.arc(elements[i - 1], e)
        return self

    def sir(self, susceptible: float, infected: float, recovered: float) -> Net:
        """Susceptible, infected and recovered, with infection and recovery."""
        self.place("S", susceptible).place("I", infected).place("R", recovered).transition("infection").transition("recovery")
        return self.arc("S", "infection").arc("I", "infection").arc("infection", "I", 2.0).arc("I", "recovery").arc("recovery", "R")

    def inputs(self, transition: str) -> list[Arc]:
        return [a for a in self.arcs if a.target == transition]

    def outputs(self, transition: str) -> list[Arc]:
        return [a for a in self.arcs if a.source == transition]

    def state(self, overrides: Mapping[str, float] | None = None) -> dict[str, float]:
        """Tokens of each place, by ``overrides`` where they name it; other names are not used."""
        return {k: float((overrides or {}).get(k, p.tokens)) for k, p in self.places.items()}

    def rates(self, overrides: Mapping[str, float] | None = None, default: float = 1.0) -> dict[str, float]:
        """A rate for each transition; names that are no transition are not used."""
        return {k: float((overrides or {}).get(k, default)) for k in self.transitions}

    def activity_map(self) -> dict[str, str]:
        """Transition of each activity, by label where there is one, else by id; of equal labels the last id in order."""
        return {(self.transitions[k].label or k): k for k in sorted(self.transitions)}

    def incidence(self, inhibitors: bool = False) -> tuple[list[str], list[str], list[list[float]]]:
        """Places and transitions in order, and what each transition adds to each place."""
        ps, ts = sorted(self.places), sorted(self.transitions)
        at_p, at_t = {p: i for i, p in enumerate(ps)}, {t: i for i, t in enumerate(ts)}
        m = [[0.0] * len(ts) for _ in ps]
        for a in self.arcs:
            if a.inhibit and not inhibitors:
                continue
            if a.source in at_p and a.target in at_t:
                m[at_p[a.source]][at_t[a.target]] -= a.total
            elif a.source in at_t and a.target in at_p:
                m[at_p[a.target]][at_t[a.source]] += a.total
        return ps, ts, m

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Places, transitions and arcs as DataFrames."""
        return (
            spark.createDataFrame([(p.id, p.initial, p.capacity, p.x, p.y, p.label) for p in self.places.values()], PLACES_SQL),
            spark.createDataFrame([(t.id, t.role, t.x, t.y, t.label) for t in self.transitions.values()], TRANSITIONS_SQL),
            spark.createDataFrame([(i, a.source, a.target, a.weight, a.inhibit) for i, a in enumerate(self.arcs)], ARCS_SQL),
        )


def from_frames(places: DataFrame, transitions: DataFrame, arcs: DataFrame) -> Net:
    """A net from its three frames, which are of the size of a model."""
    net = Net()
    for r in places.orderBy("id").collect():
        net.places[r.id] = Place(r.id, list(r.initial or []), list(r.capacity or []), r.x, r.y, r.label)
    for r in transitions.orderBy("id").collect():
        net.transitions[r.id] = Transition(r.id, r.role, r.x, r.y, r.label)
    net.arcs = [Arc(r.source, r.target, list(r.weight or []), r.inhibit) for r in arcs.orderBy("arc_no").collect()]
    return net


def from_json(text: str) -> Net:
    """A net from its JSON document; missing fields take their defaults, numbers may stand for lists."""
    doc = json.loads(text)
    net = Net(colours=[str(c) for c in doc.get("token") or []])
    for k, p in (doc.get("places") or {}).items():
        net.places[k] = Place(k, floats(p.get("initial")), floats(p.get("capacity")), float(p.get("x") or 0), float(p.get("y") or 0), p.get("label"))
    for k, t in (doc.get("transitions") or {}).items():
        net.transitions[k] = Transition(k, t.get("role") or "default", float(t.get("x") or 0), float(t.get("y") or 0), t.get("label"))
    for a in doc.get("arcs") or []:
        net.arcs.append(Arc(a["source"], a["target"], floats(a.get("weight", 1.0)), bool(a.get("inhibitTransition"))))
    return net


def to_json(net: Net) -> str:
    """The JSON document that :func:`from_json` reads."""
    doc = {
        "@type": "PetriNet",
        "token": net.colours,
        "places": {k: {"initial": p.initial, "capacity": p.capacity, "x": p.x, "y": p.y, "label": p.label} for k, p in net.places.items()},
        "transitions": {k: {"role": t.role, "x": t.x, "y": t.y, "label": t.label} for k, t in net.transitions.items()},
        "arcs": [{"source": a.source, "target": a.target, "weight": a.weight, "inhibitTransition": a.inhibit} for a in net.arcs],
    }
    return json.dumps(doc, indent=2)
