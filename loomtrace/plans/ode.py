"""Mass-action simulation of nets: a numpy kernel, fanned out over a table of runs.

The flux of a transition is its rate times the product of its input places' tokens, 0 if any is not positive; weights
act on what is consumed and produced, not on the flux. Inhibitors and capacities are not used, and a transition without
a rate does not fire.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .net import Net


@dataclass(frozen=True)
class Options:
    dt: float = 0.01
    dtmin: float = 1e-6
    dtmax: float = 0.1
    abstol: float = 1e-6
    reltol: float = 1e-3
    maxiters: int = 100_000
    adaptive: bool = True


@dataclass(frozen=True)
class Equilibrium:
    tolerance: float = 1e-6
    consecutive: int = 5
    min_time: float = 0.1
    interval: int = 10


# Presets by purpose.
OPTIONS = {
    "default": Options(),
    "parity": Options(dtmax=1.0),
    "fast": Options(0.1, 1e-4, 1.0, 1e-2, 1e-2, 1000),
    "accurate": Options(0.001, 1e-8, 0.1, 1e-9, 1e-6, 1_000_000),
    "stiff": Options(0.001, 1e-10, 0.01, 1e-8, 1e-5, 500_000),
    "game": Options(0.1, 1e-3, 1.0, 1e-2, 1e-2, 500),
    "epidemic": Options(0.01, 1e-6, 0.5, 1e-6, 1e-4, 200_000),
    "workflow": Options(0.1, 1e-4, 10.0, 1e-4, 1e-3, 50_000),
    "long": Options(0.1, 1e-4, 10.0, 1e-5, 1e-3, 500_000),
}
EQUILIBRIA = {
    "default": Equilibrium(),
    "fast": Equilibrium(1e-4, 3, 0.01, 5),
    "strict": Equilibrium(1e-9, 10, 1.0, 1),
    "game": Equilibrium(1e-3, 2, 0.01, 3),
    "workflow": Equilibrium(1e-4, 3, 0.5, 5),
}
#: Options and equilibrium presets that go together.
PAIRS = {"game": ("game", "game"), "epidemic": ("epidemic", "default"), "workflow": ("workflow", "workflow"), "long": ("long", "strict")}


@dataclass(frozen=True)
class Method:
    """A Runge-Kutta method; ``error`` are the weights of its error estimate."""

    order: int
    c: tuple[float, ...]
    a: tuple[tuple[float, ...], ...]
    b: tuple[float, ...]
    error: tuple[float, ...]


# Published tableaux.
METHODS = {
    "tsit5": Method(
        5,
        (0, 0.161, 0.327, 0.9, 0.9800255409045097, 1, 1),
        (
            (),
            (0.161,),
            (-0.008480655492356924, 0.335480655492357),
            (2.8971530571054935, -6.359448489975075, 4.362295432869581),
            (5.325864828439257, -11.748883564062828, 7.4955393428898365, -0.09249506636175525),
            (5.86145544294642, -12.92096931784711, 8.159367898576159, -0.071584973281401, -0.028269050394068383),
            (0.09646076681806523, 0.01, 0.4798896504144996, 1.379008574103742, -3.290069515436081, 2.324710524099774),
        ),
        (0.09646076681806523, 0.01, 0.4798896504144996, 1.379008574103742, -3.290069515436081, 2.324710524099774, 0),
        (0.001780011052226, 0.000816434459657, -0.007880878010262, 0.144711007173263, -0.582357165452555, 0.458082105929187, 1 / 66),
    ),
    "rk45": Method(
        5,
        (0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1),
        (
            (),
            (1 / 5,),
            (3 / 40, 9 / 40),
            (44 / 45, -56 / 15, 32 / 9),
            (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729),
            (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656),
            (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84),
        ),
        (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0),
        (71 / 57600, 0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40),
    ),
    "bs32": Method(3, (0, 1 / 2, 3 / 4, 1), ((), (1 / 2,), (0, 3 / 4), (2 / 9, 1 / 3, 4 / 9)), (2 / 9, 1 / 3, 4 / 9, 0), (2 / 9 - 7 / 24, 1 / 3 - 1 / 4, 4 / 9 - 1 / 3, -1 / 8)),
    "rk4": Method(4, (0, 1 / 2, 1 / 2, 1), ((), (1 / 2,), (0, 1 / 2), (0, 0, 1)), (1 / 6, 1 / 3, 1 / 3, 1 / 6), (0, 0, 0, 0)),
    "heun": Method(2, (0, 1), ((), (1,)), (1 / 2, 1 / 2), (0, 0)),
    "midpoint": Method(2, (0, 1 / 2), ((), (1 / 2,)), (0, 1), (0, 0)),
    "euler": Method(1, (0,), ((),), (1,), (0,)),
}


class Dynamics:
    """A net's derivative on dense states, in the order of ``labels``."""

    def __init__(self, net: Net):
        self.labels = sorted(net.places)
        self.transitions = sorted(net.transitions)
        at = {p: i for i, p in enumerate(self.labels)}
        n, m = len(self.labels), len(self.transitions)
        self.change = np.zeros((n, m))
        inputs = []
        for j, t in enumerate(self.transitions):
            mine = [a for a in net.arcs if a.target == t and a.source in at]
            inputs.append([at[a.source] for a in mine])
            for a in mine:
                self.change[at[a.source], j] -= a.total
            for a in net.arcs:
                if a.source == t and a.target in at:
                    self.change[at[a.target], j] += a.total
        # One more state entry, always 1, fills up transitions with fewer inputs.
        width = max(map(len, inputs), default=0)
        self.inputs = np.array([x + [n] * (width - len(x)) for x in inputs], np.int64).reshape(m, width)

    def dense(self, state: Mapping[str, float]) -> np.ndarray:
        return np.array([float(state.get(p, 0.0)) for p in self.labels])

    def rates(self, rates: Mapping[str, float]) -> np.ndarray:
        return np.array([float(rates.get(t, 0.0)) for t in self.transitions])

    def flux(self, u: np.ndarray, rates: np.ndarray) -> np.ndarray:
        if not self.inputs.shape[1]:
            return np.maximum(rates, 0.0)
        factors = np.append(u, 1.0)[self.inputs]
        return np.where((factors > 0).all(axis=1), np.maximum(rates, 0.0) * factors.prod(axis=1), 0.0)

    def derivative(self, rates: np.ndarray | Callable[[float, np.ndarray], np.ndarray]) -> Callable[[float, np.ndarray], np.ndarray]:
        if callable(rates):
            return lambda t, u: self.change @ self.flux(u, rates(t, u))
        return lambda t, u: self.change @ self.flux(u, rates)


@dataclass
class Trajectory:
    labels: list[str]
    t: np.ndarray
    u: np.ndarray

    def variable(self, place: str | int) -> np.ndarray:
        return self.u[:, place if isinstance(place, int) else self.labels.index(place)]

    def state(self, i: int) -> dict[str, float]:
        return dict(zip(self.labels, self.u[i].tolist(), strict=True))

    @property
    def final(self) -> dict[str, float]:
        return self.state(-1)


def _stepper(f, u0: np.ndarray, tspan: tuple[float, float], method: Method, o: Options):
    """Yields (time, state, derivative at the step's start) after each accepted step."""
    t, end = map(float, tspan)
    u, dt, steps = u0.copy(), o.dt, 0
    power = 1.0 / (method.order + 1)
    b, error = np.array(method.b, float), np.array(method.error, float)
    k = np.zeros((len(method.c), u.size))
    while t < end and steps < o.maxiters:
        dt = min(dt, end - t) if t + dt > end else dt
        k[0] = f(t, u)
        for s in range(1, len(method.c)):
            k[s] = f(t + method.c[s] * dt, u + dt * (np.array(method.a[s]) @ k[: len(method.a[s])]))
        after = u + dt * (b @ k)
        err = 0.0
        if o.adaptive and u.size:
            scale = o.abstol + o.reltol * np.maximum(np.abs(u), np.abs(after))
            err = float((np.abs(dt * (error @ k)) / scale).max())
        factor = 0.9 * (1.0 / err) ** power if err > 0 else None
        if o.adaptive and err > 1.0 and dt > o.dtmin:
            dt = max(o.dtmin, dt * max(factor, 0.1))
            continue
        t, u, steps = t + dt, after, steps + 1
        yield t, u, k[0].copy()
        if o.adaptive and factor is not None:
            dt = min(o.dtmax, max(o.dtmin, dt * min(factor, 5.0)))


def solve(net: Net, state: Mapping[str, float], rates, tspan: tuple[float, float], method: str = "tsit5", options: Options = OPTIONS["default"]) -> Trajectory:
    """The trajectory of one run, all accepted steps and the start. ``rates`` by transition, or a function of time and
    dense state."""
    d = Dynamics(net)
    u0 = d.dense(state)
    f = d.derivative(rates if callable(rates) else d.rates(rates))
    ts, us = [float(tspan[0])], [u0]
    for t, u, _ in _stepper(f, u0, tspan, METHODS[method], options):
        ts.append(t)
        us.append(u)
    return Trajectory(d.labels, np.array(ts), np.array(us))


def _settled(step: Callable[[np.ndarray], np.ndarray], guess: np.ndarray, tolerance: float) -> np.ndarray:
    """A fixed point of ``step`` by at most 50 rounds; the last value is taken even if it has not settled."""
    for _ in range(50):
        new = step(guess)
        moved = float(np.abs(new - guess).max()) if new.size else 0.0
        guess = new
        if moved < tolerance:
            break
    return guess


def solve_implicit(net: Net, state: Mapping[str, float], rates: Mapping[str, float], tspan: tuple[float, float], method: str = "implicit_euler", options: Options = OPTIONS["stiff"]) -> Trajectory:
    """Backward Euler or TR-BDF2 with fixed steps."""
    d = Dynamics(net)
    f, o, tolerance = d.derivative(d.rates(rates)), options, 10 * options.abstol
    t, end = map(float, tspan)
    u = d.dense(state)
    ts, us = [t], [u]
    g = 2 - 2**0.5
    w1, w0, wf = 1 / (g * (2 - g)), -((1 - g) ** 2) / (g * (2 - g)), (1 - g) / (2 - g)
    while t < end and len(ts) <= o.maxiters:
        dt = min(o.dt, end - t)
        slope, now = f(t, u), u
        if method == "implicit_euler":
            u = _settled(lambda x: now + dt * f(t + dt, x), now + dt * slope, tolerance)
        elif method == "trbdf2":
            mid = _settled(lambda x: now + 0.5 * g * dt * (slope + f(t + g * dt, x)), now + g * dt * slope, tolerance)
            u = _settled(lambda x: w1 * mid + w0 * now + wf * dt * f(t + dt, x), mid + (1 - g) * dt * f(t + g * dt, mid), tolerance)
        else:
            raise ValueError(f"no implicit method {method}")
        t += dt
        ts.append(t)
        us.append(u)
    return Trajectory(d.labels, np.array(ts), np.array(us))


def is_stiff(net: Net, state: Mapping[str, float], rates: Mapping[str, float], t: float = 0.0) -> bool:
    """Whether derivatives at the start, other than zero, differ by more than 1000 times."""
    d = Dynamics(net)
    du = np.abs(d.derivative(d.rates(rates))(t, d.dense(state)))
    du = du[du > 1e-10]
    return bool(du.size and du.max() / du.min() > 1000)


def solve_any(net: Net, state: Mapping[str, float], rates: Mapping[str, float], tspan: tuple[float, float], options: Options = OPTIONS["default"]) -> Trajectory:
    """Backward Euler if the run looks stiff, else the adaptive method."""
    if is_stiff(net, state, rates, tspan[0]):
        return solve_implicit(net, state, rates, tspan, options=replace(options, adaptive=False))
    return solve(net, state, rates, tspan, options=options)


@dataclass
class Rest:
    """Where a search for equilibrium ended."""

    reached: bool
    time: float
    state: dict[str, float]
    max_change: float
    steps: int
    reason: str


def solve_until_rest(net: Net, state: Mapping[str, float], rates: Mapping[str, float], tspan: tuple[float, float], method: str = "tsit5", options: Options = OPTIONS["default"], rest: Equilibrium = EQUILIBRIA["default"]) -> tuple[Trajectory, Rest]:
    """A run up to equilibrium: derivatives, taken at the start of a step, below the tolerance at several checks in a
    row. Checks begin after ``min_time`` and come every ``interval`` steps."""
    d = Dynamics(net)
    f = d.derivative(d.rates(rates))
    u0 = d.dense(state)
    ts, us = [float(tspan[0])], [u0]
    quiet = since = 0
    found = None
    for t, u, slope in _stepper(f, u0, tspan, METHODS[method], options):
        ts.append(t)
        us.append(u)
        since += 1
        if t >= tspan[0] + rest.min_time and since >= rest.interval:
            since = 0
            change = float(np.abs(slope).max()) if slope.size else 0.0
            quiet = quiet + 1 if change < rest.tolerance else 0
            if quiet >= rest.consecutive:
                found = change
                break
    path = Trajectory(d.labels, np.array(ts), np.array(us))
    steps = len(ts) - 1
    if found is not None:
        return path, Rest(True, ts[-1], path.final, found, steps, "equilibrium_reached")
    change = float(np.abs(f(ts[-1], us[-1])).max()) if us[-1].size else 0.0
    return path, Rest(False, ts[-1], path.final, change, steps, "max_iterations" if steps >= options.maxiters else "time_exhausted")


def find_rest(net: Net, state: Mapping[str, float], rates: Mapping[str, float], tspan: tuple[float, float], preset: str = "default") -> tuple[dict[str, float], bool]:
    """State at equilibrium, or at the end, and whether it was reached; presets ``default``, ``fast``, ``accurate``."""
    rest = EQUILIBRIA["strict" if preset == "accurate" else preset]
    _, out = solve_until_rest(net, state, rates, tspan, options=OPTIONS[preset], rest=rest)
    return out.state, out.reached


def at_rest(net: Net, state: Mapping[str, float], rates: Mapping[str, float], tolerance: float) -> bool:
    d = Dynamics(net)
    du = d.derivative(d.rates(rates))(0.0, d.dense(state))
    return not du.size or float(np.abs(du).max()) < tolerance


TRAJECTORY_SQL = "run_id long, step int, t double, place string, value double"


def simulate(runs: DataFrame, net: Net, method: str = "tsit5", options: Options = OPTIONS["default"], points: int | None = None) -> DataFrame:
    """Long trajectories of a table of runs.

    ``runs`` has ``run_id long, state map<string,double>, rates map<string,double>, t0 double, t1 double``. Places and
    transitions that a map does not name take the net's tokens and a rate of 0. Equal runs in a batch are solved once.
    With ``points`` a trajectory is cut to that many steps by :func:`spread`.
    """

    def solved(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            known: dict = {}
            parts = []
            for r in batch.itertuples(index=False):
                state, rates = dict(r.state or {}), dict(r.rates or {})
                key = (tuple(sorted(state.items())), tuple(sorted(rates.items())), r.t0, r.t1)
                if key not in known:
                    known[key] = solve(net, net.state(state), rates, (r.t0, r.t1), method, options)
                path = known[key]
                keep = spread(len(path.t), points) if points else range(len(path.t))
                n = len(path.labels)
                parts.append(pd.DataFrame({"run_id": r.run_id, "step": np.repeat(np.arange(len(keep)), n), "t": np.repeat(path.t[list(keep)], n), "place": path.labels * len(keep), "value": path.u[list(keep)].ravel()}))
            if parts:
                yield pd.concat(parts)

    return runs.select("run_id", "state", "rates", "t0", "t1").mapInPandas(solved, TRAJECTORY_SQL)


def spread(n: int, points: int) -> list[int]:
    """Indices of ``points`` evenly spread steps of ``n``, both ends among them; halves round up."""
    if n <= points or points < 2:
        return list(range(n))
    step = (n - 1) / (points - 1)
    return [0, *(int(np.floor(i * step + 0.5)) for i in range(1, points - 1)), n - 1]


def timed(run: Callable[[], Trajectory]) -> tuple[Trajectory, float]:
    began = time.perf_counter()
    out = run()
    return out, time.perf_counter() - began


def final_states(trajectories: DataFrame) -> DataFrame:
    """``run_id, place, value`` at each run's last step."""
    return trajectories.groupBy("run_id", "place").agg(F.max_by("value", "step").alias("value"))


def states_at(trajectories: DataFrame, step: int) -> DataFrame:
    return trajectories.where(F.col("step") == step)
