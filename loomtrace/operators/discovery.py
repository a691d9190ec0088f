"""Process discovery: relations by DataFrame, nets from the small relations on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.net import Net
from .footprint import directly_follows, end_activities, start_activities
from .log import activities, variants

MAX_SET = 5


def dependency_matrix(pairs: DataFrame) -> DataFrame:
    """``a, b, score`` for all pairs of a footprint: (ab - ba) / (ab + ba + 1)."""
    return pairs.select("a", "b", ((F.col("ab") - F.col("ba")) / (F.col("ab") + F.col("ba") + 1)).alias("score"))


def loop_scores(pairs: DataFrame) -> DataFrame:
    """``activity, score`` of self-loops: aa / (aa + 1)."""
    return pairs.where("a = b").select(F.col("a").alias("activity"), (F.col("ab") / (F.col("ab") + 1)).alias("score"))


def loop2_scores(pairs: DataFrame) -> DataFrame:
    """``a, b, score`` of loops of two: (ab + ba) / (ab + ba + 1) where both follow each other, else 0."""
    both = F.col("ab") + F.col("ba")
    return pairs.where("a <> b").select("a", "b", F.when((F.col("ab") > 0) & (F.col("ba") > 0), both / (both + 1)).otherwise(F.lit(0.0)).alias("score"))


def dependency_graph(pairs: DataFrame, dependency: float = 0.5, loop: float = 0.5) -> DataFrame:
    """``a, b, score``: edges of different activities and self-loops that reach their thresholds."""
    edges = dependency_matrix(pairs).where((F.col("a") != F.col("b")) & (F.col("score") >= dependency) & (F.col("score") != 0))
    loops = loop_scores(pairs).where((F.col("score") >= loop) & (F.col("score") > 0)).select(F.col("activity").alias("a"), F.col("activity").alias("b"), "score")
    return edges.union(loops)


def top_edges(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` edges of greatest positive score between different activities."""
    return dependency_matrix(pairs).where("a <> b and score > 0").orderBy(F.desc("score"), "a", "b").limit(n)


def subsets(items: list[str], size: int) -> list[tuple[str, ...]]:
    return list(combinations(sorted(items), size))


@dataclass(frozen=True)
class Candidate:
    """A place between sets of activities."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]

    @property
    def id(self) -> str:
        return f"p_{'_'.join(sorted(self.inputs))}_{'_'.join(sorted(self.outputs))}"

    def within(self, other: Candidate) -> bool:
        return set(self.inputs) <= set(other.inputs) and set(self.outputs) <= set(other.outputs)


class Relation:
    """A log's directly-follows counts on the driver: of the size of its activities squared."""

    def __init__(self, log: DataFrame):
        self.activities = [r.activity for r in activities(log).collect()]
        self.counts = {(r.a, r.b): r.n for r in directly_follows(log).collect()}
        self.starts = sorted(r.activity for r in start_activities(log).collect())
        self.ends = sorted(r.activity for r in end_activities(log).collect())

    def causal(self, a: str, b: str) -> bool:
        return (a, b) in self.counts and (b, a) not in self.counts

    def choice(self, a: str, b: str) -> bool:
        return (a, b) not in self.counts and (b, a) not in self.counts


def place_candidates(rel: Relation, most: int = MAX_SET) -> list[Candidate]:
    """Pairs of sets, of up to ``most`` activities, unrelated inside and causal across, by size and name.

    Sets grow from smaller ones that fit, as every part of such a pair is such a pair.
    """
    after = {a: {b for b in rel.activities if rel.causal(a, b)} for a in rel.activities}
    free = {a: {b for b in rel.activities if b != a and rel.choice(a, b)} for a in rel.activities}

    def grow(members: tuple[str, ...], allowed: list[str]):
        if members:
            yield members
        if len(members) < most:
            for i, x in enumerate(allowed):
                yield from grow((*members, x), [y for y in allowed[i + 1 :] if y in free[x]])

    found = []
    for left in grow((), [a for a in rel.activities if after[a]]):
        common = sorted(set.intersection(*(after[a] for a in left)))
        found += [Candidate(left, right) for right in grow((), common)]
    return sorted(found, key=lambda c: (len(c.inputs), c.inputs, len(c.outputs), c.outputs))


def maximal(candidates: list[Candidate]) -> list[Candidate]:
    """Candidates that are within no other."""
    return [c for c in candidates if not any(o is not c and o.id != c.id and c.within(o) for o in candidates)]


def _with_ends(net: Net, rel: Relation) -> Net:
    if rel.starts:
        net.place("start", 1.0, label="start")
        for a in rel.starts:
            net.arc("start", a)
    if rel.ends:
        net.place("end", 0.0, label="end")
        for a in rel.ends:
            net.arc(a, "end")
    return net


def alpha(log: DataFrame) -> Net:
    """A net with one place for each maximal candidate."""
    rel, net = Relation(log), Net()
    for a in rel.activities:
        net.transition(a, label=a)
    for c in maximal(place_candidates(rel)):
        net.place(c.id)
        for a in c.inputs:
            net.arc(a, c.id)
        for b in c.outputs:
            net.arc(c.id, b)
    return _with_ends(net, rel)


def heuristic(log: DataFrame, dependency: float = 0.5, loop: float = 0.5) -> Net:
    """A net with one place for each dependency edge, and one with a token for each self-loop; places are numbered in
    the order of their edges."""
    rel, net = Relation(log), Net()
    for a in rel.activities:
        net.transition(a, label=a)
    edges = []
    for a in rel.activities:
        for b in rel.activities:
            ab, ba = rel.counts.get((a, b), 0), rel.counts.get((b, a), 0)
            if a != b and ab + ba and (ab - ba) / (ab + ba + 1) >= dependency:
                edges.append((a, b))
    for i, (a, b) in enumerate(edges):
        net.place(f"p{i}").arc(a, f"p{i}").arc(f"p{i}", b)
    for a in rel.activities:
        n = rel.counts.get((a, a), 0)
        if n and n / (n + 1) >= loop:
            net.place(f"loop_{a}", 1.0).arc(a, f"loop_{a}").arc(f"loop_{a}", a)
    return _with_ends(net, rel)


def _linear(path: list[str]) -> Net:
    net = Net()
    if not path:
        return net
    steps = ["start", *(f"p{i}" for i in range(1, len(path))), "end"]
    for i, p in enumerate(steps):
        net.place(p, 1.0 if i == 0 else 0.0)
    for i, a in enumerate(path):
        net.transition(a, label=a).arc(steps[i], a).arc(a, steps[i + 1])
    return net


def sequential(log: DataFrame) -> Net:
    """A linear net over all activities in alphabetical order."""
    return _linear([r.activity for r in activities(log).collect()])


def common_path(log: DataFrame) -> Net:
    """A linear net of the most frequent variant, the first in order of those that tie."""
    top = variants(log).orderBy(F.desc("cases"), "variant").head(1)
    return _linear(list(top[0].variant) if top else [])


METHODS = {"sequential": sequential, "common-path": common_path, "alpha": alpha, "heuristic": heuristic}


@dataclass
class Discovery:
    net: Net
    method: str
    variants: int
    most_common: int
    coverage_percent: float


def coverage(log: DataFrame) -> DataFrame:
    """One row: ``variants, most_common, coverage_percent``."""
    per = variants(log).agg(F.count(F.lit(1)).alias("variants"), F.coalesce(F.max("cases"), F.lit(0)).alias("most_common"), F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"))
    return per.select("variants", "most_common", F.when(F.col("cases") > 0, F.col("most_common") / F.col("cases") * 100).otherwise(F.lit(0.0)).alias("coverage_percent"))


def discover(log: DataFrame, method: str) -> Discovery:
    """A net by one of ``METHODS``, with the coverage of the most common variant."""
    if method not in METHODS:
        raise ValueError(f"no discovery method {method}; there are {', '.join(METHODS)}")
    c = coverage(log).first()
    return Discovery(METHODS[method](log), method, c.variants, c.most_common, c.coverage_percent)
