"""Workflows: definitions, readiness, deadlines and metrics as relations, and an engine for single cases."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.net import Net
from ..plans.ode import OPTIONS, Trajectory, solve

FS, SS, FF, SF = "finish_to_start", "start_to_start", "finish_to_finish", "start_to_finish"
DONE = ("completed", "skipped")
Condition = Callable[[Mapping[str, Any]], bool]


# --- Definitions --------------------------------------------------------------


@dataclass
class Task:
    id: str
    name: str = ""
    join: str = "all"
    join_count: int = 1
    condition: Condition | None = None
    on_failure: str = "abort"
    retries: int = 0
    estimated_s: float = 0.0
    sla_s: float = 0.0
    needs: dict[str, float] = field(default_factory=dict)
    gives: dict[str, float] = field(default_factory=dict)


@dataclass
class Dependency:
    source: str
    target: str
    kind: str = FS
    lag_s: float = 0.0


@dataclass
class Workflow:
    id: str
    tasks: dict[str, Task] = field(default_factory=dict)
    dependencies: list[Dependency] = field(default_factory=list)
    resources: dict[str, float] = field(default_factory=dict)
    deadlines_s: dict[str, float] = field(default_factory=dict)
    default_deadline_s: float = 0.0
    warning_at: float = 0.8
    critical_at: float = 1.0

    # Methods that build return the workflow.
    def task(self, id: str, **options: Any) -> Workflow:
        self.tasks[id] = Task(id, **options)
        return self

    def connect(self, source: str, target: str, kind: str = FS, lag_s: float = 0.0) -> Workflow:
        self.dependencies.append(Dependency(source, target, kind, lag_s))
        return self

    def sequence(self, *ids: str) -> Workflow:
        for a, b in zip(ids, ids[1:], strict=False):
            self.connect(a, b)
        return self

    def parallel(self, source: str, *targets: str) -> Workflow:
        for t in targets:
            self.connect(source, t)
        return self

    def merge(self, target: str, *sources: str) -> Workflow:
        for s in sources:
            self.connect(s, target)
        return self

    def branch(self, source: str, conditions: Mapping[str, Condition]) -> Workflow:
        for target, condition in conditions.items():
            self.tasks[target].condition = condition
            self.connect(source, target)
        return self

    def resource(self, id: str, capacity: float) -> Workflow:
        self.resources[id] = capacity
        return self

    def starts(self) -> list[str]:
        return sorted(self.tasks.keys() - {d.target for d in self.dependencies})

    def ends(self) -> list[str]:
        return sorted(self.tasks.keys() - {d.source for d in self.dependencies})

    def problems(self) -> list[str]:
        out = [] if self.tasks else ["no tasks"]
        out += [f"{d.source} -> {d.target}: unknown task" for d in self.dependencies if not {d.source, d.target} <= self.tasks.keys()]
        out += [f"{t.id} needs unknown resource {r}" for t in self.tasks.values() for r in t.needs if r not in self.resources]
        left = {t: {d.source for d in self.dependencies if d.target == t} for t in self.tasks}
        while ready := [t for t, before in left.items() if not before]:
            for t in ready:
                del left[t]
            for before in left.values():
                before.difference_update(ready)
        if left:
            out.append(f"cycle among {', '.join(sorted(left))}")
        return out

    def net(self) -> Net:
        """Places for ready, running and completed tasks, transitions that start and complete them; finish-to-start
        dependencies hand on tokens."""
        out = Net()
        for r, n in self.resources.items():
            out.place(f"resource_{r}", n)
        first = set(self.starts())
        for t in self.tasks.values():
            out.place(f"{t.id}_ready", 1.0 if t.id in first else 0.0).place(f"{t.id}_running").place(f"{t.id}_completed")
            out.transition(f"start_{t.id}").transition(f"complete_{t.id}")
            out.flow(f"{t.id}_ready", f"start_{t.id}", f"{t.id}_running").flow(f"{t.id}_running", f"complete_{t.id}", f"{t.id}_completed")
            for r, n in t.needs.items():
                out.arc(f"resource_{r}", f"start_{t.id}", n).arc(f"complete_{t.id}", f"resource_{r}", n)
        for d in self.dependencies:
            if d.kind == FS:
                out.arc(f"complete_{d.source}", f"{d.target}_ready")
        return out

    def rates(self) -> dict[str, float]:
        """Starts at once, completions at one over the estimated time."""
        return {f"start_{t}": 1.0 for t in self.tasks} | {f"complete_{t.id}": 1 / t.estimated_s if t.estimated_s > 0 else 0.1 for t in self.tasks.values()}


def when_var(name: str, sign: str, value: Any) -> Condition:
    """A predicate on a variable; a missing one is false, and only numbers have an order."""
    def test(variables: Mapping[str, Any]) -> bool:
        if name not in variables:
            return False
        x = variables[name]
        if sign in ("==", "!="):
            return (x == value) == (sign == "==")
        if isinstance(x, (int, float)) and isinstance(value, (int, float)):
            return {"<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}[sign]
        return False

    return test


def when_true(name: str) -> Condition:
    return lambda v: v.get(name) is True


def when_false(name: str) -> Condition:
    return lambda v: v.get(name) is False


def always(variables: Mapping[str, Any]) -> bool:
    return True


def never(variables: Mapping[str, Any]) -> bool:
    return False


# --- Relations over many cases -------------------------------------------------
# Task instances have case_id, task_id, status, ready_at, started_at, completed_at, attempts; cases have case_id, status,
# priority, started_at, completed_at, deadline.


def with_deadlines(cases: DataFrame, sla: DataFrame, default_s: float) -> DataFrame:
    """Cases with ``deadline``: the start and the seconds of their priority (``priority, seconds``) or the default."""
    s = F.coalesce(F.col("seconds"), F.lit(default_s))
    return cases.drop("deadline").join(sla, "priority", "left").withColumn("deadline", F.timestamp_micros(F.unix_micros("started_at") + (s * 1e6).cast("long"))).drop("seconds")


def ready_tasks(instances: DataFrame, dependencies: DataFrame, tasks: DataFrame) -> DataFrame:
    """``case_id, task_id`` of pending tasks whose dependencies are met.

    ``dependencies`` has ``source, target, kind``, ``tasks`` has ``task_id, join, join_count``. Finish-to-start needs the
    source done, start-to-start begun, the others nothing at the start; joins are ``all``, ``any`` or ``count``.
    """
    sources = instances.select("case_id", F.col("task_id").alias("source"), F.col("status").alias("source_status"))
    met = F.when(F.col("kind") == FS, F.col("source_status").isin(*DONE)).when(F.col("kind") == SS, F.col("source_status").isin("running", *DONE)).otherwise(F.lit(True))
    counted = sources.join(dependencies, "source").groupBy("case_id", F.col("target").alias("task_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(met, 1).otherwise(0)).alias("met"))
    pending = instances.where("status = 'pending'").select("case_id", "task_id").join(tasks, "task_id").join(counted, ["case_id", "task_id"], "left")
    enough = F.when(F.col("join") == "any", F.col("met") >= 1).when(F.col("join") == "count", F.col("met") >= F.col("join_count")).otherwise(F.col("met") == F.col("n"))
    return pending.where(F.coalesce(enough, F.lit(True))).select("case_id", "task_id")


def complete_cases(instances: DataFrame, end_tasks: Sequence[str]) -> DataFrame:
    """``case_id`` of cases whose end tasks are all done."""
    ends = instances.where(F.col("task_id").isin(list(end_tasks)))
    return ends.groupBy("case_id").agg(F.bool_and(F.col("status").isin(*DONE)).alias("done")).where("done").select("case_id")


def sla_alerts(cases: DataFrame, as_of: str | Column, warning_at: float = 0.8, critical_at: float = 1.0) -> DataFrame:
    """``case_id, level, share`` of running cases: ``breach`` or ``warning`` by the share of their time that is used."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    share = (F.unix_micros(now) - F.unix_micros("started_at")) / F.nullif(F.unix_micros("deadline") - F.unix_micros("started_at"), F.lit(0).cast("long"))
    rows = cases.where("status = 'running' and deadline is not null").select("case_id", share.alias("share"))
    return rows.select("case_id", F.when(F.col("share") >= critical_at, "breach").when(F.col("share") >= warning_at, "warning").alias("level"), "share").where("level is not null")


def task_sla_alerts(instances: DataFrame, tasks: DataFrame, as_of: str, warning_at: float = 0.8, critical_at: float = 1.0) -> DataFrame:
    """As :func:`sla_alerts` for ready and running tasks (``task_id, sla_s``), from their start, else from ready."""
    began = F.coalesce("started_at", "ready_at")
    share = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(began)) / 1e6 / F.col("sla_s")
    rows = instances.where("status in ('ready', 'running')").join(tasks.where("sla_s > 0").select("task_id", "sla_s"), "task_id").select("case_id", "task_id", share.alias("share"))
    return rows.withColumn("level", F.when(F.col("share") >= critical_at, "breach").when(F.col("share") >= warning_at, "warning")).where("level is not null")


def case_metrics(cases: DataFrame) -> DataFrame:
    """One row: cases by status, mean and quantiles of the duration of completed ones in seconds."""
    took = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    done = F.when(F.col("status") == "completed", took)
    count = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("long").alias(s)
    return cases.agg(F.count(F.lit(1)).alias("cases"), *[count(s) for s in ("running", "completed", "failed", "cancelled", "suspended")], F.coalesce(F.avg(done), F.lit(0.0)).alias("mean_s"), F.percentile(done, 0.5).alias("p50_s"), F.percentile(done, 0.95).alias("p95_s"))


def task_metrics(instances: DataFrame) -> DataFrame:
    """``task_id, executions, successes, failures, retries, mean_wait_s, mean_work_s``."""
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    return instances.groupBy("task_id").agg(
        n(F.col("started_at").isNotNull(), "executions"),
        n(F.col("status") == "completed", "successes"),
        n(F.col("status") == "failed", "failures"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).cast("long").alias("retries"),
        F.avg(seconds("ready_at", "started_at")).alias("mean_wait_s"),
        F.avg(seconds("started_at", "completed_at")).alias("mean_work_s"),
    )


def utilisation(reservations: DataFrame, capacities: DataFrame) -> DataFrame:
    """``resource_id, used, capacity, utilisation`` from what is reserved now (``resource_id, quantity``)."""
    used = reservations.groupBy("resource_id").agg(F.sum("quantity").alias("used"))
    return capacities.join(used, "resource_id", "left").withColumn("used", F.coalesce("used", F.lit(0.0))).withColumn("utilisation", F.when(F.col("capacity") > 0, F.col("used") / F.col("capacity")).otherwise(F.lit(0.0)))


def bottlenecks(instances: DataFrame, used: DataFrame, as_of: str, wait_s: float = 3600.0) -> DataFrame:
    """``kind, id, value`` of tasks that have waited longer than ``wait_s`` and resources used over 90 %."""
    waited = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("ready_at")) / 1e6
    slow = instances.where("status = 'ready'").groupBy("task_id").agg(F.max(waited).alias("value")).where(F.col("value") > wait_s)
    busy = used.where("utilisation > 0.9")
    return slow.select(F.lit("task").alias("kind"), F.col("task_id").alias("id"), "value").union(busy.select(F.lit("resource").alias("kind"), F.col("resource_id").alias("id"), F.col("utilisation").alias("value")))


def dashboard(cases: DataFrame, instances: DataFrame, alerts: DataFrame) -> dict[str, DataFrame]:
    """Queue depths by task, the last ten alerts (``at`` and others) and one row with the compliance."""
    depth = instances.where("status = 'ready'").groupBy("task_id").agg(F.count(F.lit(1)).alias("waiting"))
    breaches = alerts.agg(F.sum(F.when(F.col("level") == "breach", 1).otherwise(0)).alias("breaches"))
    total = cases.agg(F.count(F.lit(1)).alias("cases"))
    share = F.when(F.col("cases") > 0, (F.col("cases") - F.coalesce("breaches", F.lit(0))) / F.col("cases")).otherwise(F.lit(1.0))
    return {"queues": depth, "recent": alerts.orderBy(F.desc("at")).limit(10), "compliance": total.crossJoin(breaches).withColumn("compliance", share)}


# --- One case at a time -------------------------------------------------------------


@dataclass
class Case:
    id: str
    priority: str
    started: float
    deadline: float | None
    variables: dict[str, Any]
    status: str = "running"
    completed: float | None = None
    tasks: dict[str, dict[str, Any]] = field(default_factory=dict)


class Engine:
    """Cases of one workflow, on a clock that is passed in."""

    def __init__(self, workflow: Workflow, clock: Callable[[], float]):
        self.workflow, self.clock = workflow, clock
        self.cases: dict[str, Case] = {}
        self.available = dict(workflow.resources)

    def start_case(self, id: str, variables: Mapping[str, Any] | None = None, priority: str = "normal") -> Case:
        if id in self.cases:
            raise KeyError(f"{id} exists")
        now = self.clock()
        seconds = self.workflow.deadlines_s.get(priority, self.workflow.default_deadline_s)
        case = Case(id, priority, now, now + seconds if seconds else None, dict(variables or {}))
        case.tasks = {t: {"status": "pending", "attempts": 0, "ready": None, "started": None, "completed": None, "assignee": None} for t in self.workflow.tasks}
        self.cases[id] = case
        self._enable(case)
        return case

    def _met(self, case: Case, task: Task) -> bool:
        before = [d for d in self.workflow.dependencies if d.target == task.id]
        ok = 0
        for d in before:
            s = case.tasks[d.source]["status"]
            ok += s in DONE if d.kind == FS else s in ("running", *DONE) if d.kind == SS else True
        return ok >= 1 if task.join == "any" and before else ok >= task.join_count if task.join == "count" and before else ok == len(before)

    def _enable(self, case: Case) -> None:
        """Make tasks ready, or skip those whose condition is false, until nothing changes."""
        changed = True
        while changed:
            changed = False
            for id in sorted(self.workflow.tasks):
                task, held = self.workflow.tasks[id], case.tasks[id]
                if held["status"] == "pending" and self._met(case, task):
                    skip = task.condition is not None and not task.condition(case.variables)
                    held["status"], held["ready"], changed = ("skipped" if skip else "ready"), self.clock(), True
        if case.status == "running" and all(case.tasks[t]["status"] in DONE for t in self.workflow.ends()):
            case.status, case.completed = "completed", self.clock()

    def assign(self, case_id: str, task_id: str, assignee: str) -> None:
        self.cases[case_id].tasks[task_id]["assignee"] = assignee

    def start(self, case_id: str, task_id: str) -> None:
        case, task = self.cases[case_id], self.workflow.tasks[task_id]
        held = case.tasks[task_id]
        if case.status != "running" or held["status"] != "ready":
            raise ValueError(f"{task_id} is {held['status']}")
        short = [r for r, n in task.needs.items() if self.available.get(r, 0.0) < n]
        if short:
            raise ValueError(f"{', '.join(short)} not available")
        for r, n in task.needs.items():
            self.available[r] -= n
        held |= {"status": "running", "started": self.clock(), "attempts": held["attempts"] + 1}
        self._enable(case)

    def complete(self, case_id: str, task_id: str, output: Mapping[str, Any] | None = None) -> None:
        case, task = self.cases[case_id], self.workflow.tasks[task_id]
        held = case.tasks[task_id]
        if held["status"] != "running":
            raise ValueError(f"{task_id} is {held['status']}")
        held |= {"status": "completed", "completed": self.clock()}
        case.variables.update(output or {})
        self._release(task)
        for r, n in task.gives.items():
            self.available[r] = self.available.get(r, 0.0) + n
        self._enable(case)

    def _release(self, task: Task) -> None:
        for r, n in task.needs.items():
            self.available[r] += n

    def fail(self, case_id: str, task_id: str) -> None:
        """A retry if any is left, else the task's failure action: ``skip``, ``escalate`` or ``abort``."""
        case, task = self.cases[case_id], self.workflow.tasks[task_id]
        held = case.tasks[task_id]
        self._release(task)
        if held["attempts"] <= task.retries:
            held["status"] = "ready"
        elif task.on_failure == "skip":
            held["status"] = "skipped"
            self._enable(case)
        elif task.on_failure == "escalate":
            held["status"] = "escalated"
        else:
            held["status"], case.status, case.completed = "failed", "failed", self.clock()

    def cancel(self, case_id: str) -> None:
        case = self.cases[case_id]
        for t, held in case.tasks.items():
            if held["status"] == "running":
                self._release(self.workflow.tasks[t])
            if held["status"] not in DONE:
                held["status"] = "cancelled"
        case.status, case.completed = "cancelled", self.clock()

    def suspend(self, case_id: str) -> None:
        self.cases[case_id].status = "suspended"

    def resume(self, case_id: str) -> None:
        self.cases[case_id].status = "running"

    def ready(self) -> list[tuple[str, str]]:
        return [(c.id, t) for c in self.cases.values() if c.status == "running" for t, h in sorted(c.tasks.items()) if h["status"] == "ready"]


# --- Forecasts ---------------------------------------------------------------------


def case_state(workflow: Workflow, statuses: Mapping[str, str]) -> dict[str, float]:
    """The net's state of a case by its tasks' statuses."""
    state = dict.fromkeys(workflow.net().places, 0.0) | {f"resource_{r}": n for r, n in workflow.resources.items()}
    for t, s in statuses.items():
        place = {"ready": f"{t}_ready", "running": f"{t}_running"}.get(s, f"{t}_completed" if s in DONE else None)
        if place:
            state[place] = 1.0
    return state


def forecast(workflow: Workflow, statuses: Mapping[str, str], horizon_s: float = 86_400.0, rates: Mapping[str, float] | None = None) -> tuple[float, float]:
    """(seconds to completion, probability of completion): when the end tasks hold half of their tokens, and how many
    they hold at the horizon."""
    path: Trajectory = solve(workflow.net(), case_state(workflow, statuses), dict(rates or workflow.rates()), (0.0, horizon_s), options=OPTIONS["workflow"])
    ends = workflow.ends()
    done = sum(path.variable(f"{t}_completed") for t in ends) / max(1, len(ends))
    late = next((float(t) for t, x in zip(path.t, done, strict=True) if x >= 0.5), horizon_s)
    return late, float(min(1.0, done[-1]))


def risk(predicted_s: float, remaining_s: float) -> float:
    return 1.0 if remaining_s <= 0 or predicted_s > remaining_s else predicted_s / remaining_s


def what_if(workflow: Workflow, statuses: Mapping[str, str], quantity: float) -> tuple[float, float]:
    """Seconds to completion now, and with rates raised by ``quantity``."""
    base = forecast(workflow, statuses)[0]
    return base, forecast(workflow, statuses, rates={k: r * (1 + quantity) for k, r in workflow.rates().items()})[0]
