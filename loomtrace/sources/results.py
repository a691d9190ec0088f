"""Results documents of simulations."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans.net import Net
from ..plans.ode import Trajectory, spread

RESULTS_SQL = (
    "version string, metadata struct<timestamp:string,solver:string,status:string,error:string,computeTime:double>, "
    "model struct<name:string,places:array<string>,transitions:array<string>,arcs:int>, "
    "simulation struct<timespan:array<double>,initialState:map<string,double>,rates:map<string,double>>, "
    "results struct<summary:struct<points:int,finalTime:double,finalState:map<string,double>>,"
    "timeseries:struct<time:struct<downsampled:array<double>>,variables:map<string,struct<downsampled:array<double>>>>>"
)


class Builder:
    """Puts a document together; each part is optional."""

    def __init__(self):
        self.document: dict[str, Any] = {"version": "1.0.0", "metadata": {"timestamp": datetime.now(UTC).isoformat(), "status": "success"}}

    def model(self, net: Net, name: str) -> Builder:
        self.document["model"] = {"name": name, "places": sorted(net.places), "transitions": sorted(net.transitions), "arcs": len(net.arcs)}
        return self

    def simulation(self, state: Mapping[str, float], rates: Mapping[str, float], tspan: tuple[float, float]) -> Builder:
        self.document["simulation"] = {"timespan": list(tspan), "initialState": dict(state), "rates": dict(rates)}
        return self

    def solution(self, path: Trajectory, solver: str, seconds: float, points: int = 150) -> Builder:
        """The end and the series cut to ``points`` steps."""
        keep = spread(len(path.t), points)
        self.document["metadata"] |= {"solver": solver, "computeTime": seconds}
        series = {"time": {"downsampled": path.t[keep].tolist()}, "variables": {p: {"downsampled": path.u[keep, i].tolist()} for i, p in enumerate(path.labels)}}
        self.document["results"] = {"summary": {"points": len(path.t), "finalTime": float(path.t[-1]), "finalState": path.final}, "timeseries": series}
        return self

    def error(self, message: str) -> Builder:
        self.document["metadata"] |= {"status": "error", "error": message}
        return self

    def build(self) -> dict[str, Any]:
        return self.document


def to_json(document: Mapping[str, Any]) -> str:
    return json.dumps(document, indent=2)


def from_json(text: str) -> dict[str, Any]:
    return json.loads(text)


def write(spark: SparkSession, documents: list[Mapping[str, Any]], path: str) -> None:
    """Documents as JSON lines in a folder."""
    spark.read.schema(RESULTS_SQL).json(spark.sparkContext.parallelize([json.dumps(d) for d in documents])).write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file or folder, one a file or one a line."""
    return spark.read.schema(RESULTS_SQL).option("multiLine", True).json(path)


def series(documents: DataFrame) -> DataFrame:
    """The long series ``run_id, step, t, place, value`` of documents with ``run_id``."""
    return documents.selectExpr("run_id", "results.timeseries.time.downsampled as ts", "explode(results.timeseries.variables) as (place, v)").selectExpr("run_id", "place", "posexplode(arrays_zip(ts, v.downsampled)) as (step, x)").selectExpr("run_id", "step", "x.ts as t", "place", "x.downsampled as value")
