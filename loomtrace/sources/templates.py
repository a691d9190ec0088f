"""Nets made from parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from ..plans.net import Net


def sir(population: float = 1000.0, infected: float = 10.0) -> tuple[Net, dict[str, float]]:
    net = Net().sir(population - infected, infected, 0.0)
    return net, {"infection": 0.3 / population, "recovery": 0.1}


def seir(population: float = 1000.0, exposed: float = 0.0, infected: float = 10.0) -> tuple[Net, dict[str, float]]:
    net = Net().place("S", population - exposed - infected).place("E", exposed).place("I", infected).place("R", 0.0)
    net.transition("exposure").transition("incubation").transition("recovery")
    net.arc("S", "exposure").arc("I", "exposure").arc("exposure", "I").arc("exposure", "E").flow("E", "incubation", "I").flow("I", "recovery", "R")
    return net, {"exposure": 0.3 / population, "incubation": 0.2, "recovery": 0.1}


def queue(servers: float = 1.0, arrival_rate: float = 1.0, service_rate: float = 1.2, capacity: float | None = None) -> tuple[Net, dict[str, float]]:
    """Customers wait, are served by a free server and leave; ``capacity`` bounds the queue."""
    net = Net().place("Queue", 0.0, capacity).place("Servers", servers).place("InService").place("Done")
    net.transition("arrive").transition("begin").transition("finish")
    net.arc("arrive", "Queue").flow("Queue", "begin", "InService").arc("Servers", "begin").flow("InService", "finish", "Done").arc("finish", "Servers")
    return net, {"arrive": arrival_rate, "begin": 10.0, "finish": service_rate}


def producer_consumer(buffer: float = 10.0, produce_rate: float = 1.0, consume_rate: float = 0.8) -> tuple[Net, dict[str, float]]:
    net = Net().place("Free", buffer).place("Buffer", 0.0, buffer).place("Consumed")
    net.transition("produce").transition("consume")
    net.flow("Free", "produce", "Buffer").flow("Buffer", "consume", "Free").arc("consume", "Consumed")
    return net, {"produce": produce_rate, "consume": consume_rate}


def workflow(steps: int = 3, cases: float = 1.0, rate: float = 1.0) -> tuple[Net, dict[str, float]]:
    """Steps in a row from ``start`` to ``end``."""
    places = ["start", *(f"after_{i}" for i in range(1, steps)), "end"]
    net = Net().place("start", cases)
    for i in range(steps):
        if i:
            net.place(places[i])
        net.transition(f"step_{i + 1}")
    net.place("end")
    for i in range(steps):
        net.flow(places[i], f"step_{i + 1}", places[i + 1])
    return net, {f"step_{i + 1}": rate for i in range(steps)}


TEMPLATES: dict[str, Callable[..., tuple[Net, dict[str, float]]]] = {"sir": sir, "seir": seir, "queue": queue, "producer-consumer": producer_consumer, "workflow": workflow}


def names() -> list[str]:
    return sorted(TEMPLATES)


def generate(name: str, parameters: Mapping[str, Any] | None = None) -> tuple[Net, dict[str, float]]:
    if name not in TEMPLATES:
        raise KeyError(f"no template {name}; there are {', '.join(names())}")
    return TEMPLATES[name](**(parameters or {}))
