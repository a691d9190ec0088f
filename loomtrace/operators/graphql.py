"""A small GraphQL surface over event-sourced nets: queries and mutations of instances, schemas from models."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.net import Net
from .events import page_of

_TOKEN = re.compile(r'\s*(?:#[^\n]*\n?)*\s*(?:,\s*)*(\.\.\.|"(?:[^"\\]|\\.)*"|-?\d+\.\d+(?:[eE][+-]?\d+)?|-?\d+|[A-Za-z_]\w*|[{}()\[\]:!$=@|])')


class GraphQLError(ValueError):
    """A request that does not parse or asks for what is not there."""


@dataclass
class Field:
    name: str
    alias: str
    arguments: dict[str, Any] = field(default_factory=dict)
    selections: list[Field] = field(default_factory=list)


@dataclass
class Operation:
    kind: str
    name: str
    fields: list[Field]


class _Reader:
    def __init__(self, text: str, variables: Mapping[str, Any]):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                rest = re.sub(r"#[^\n]*", "", text[at:]).strip().strip(",").strip()
                if rest:
                    raise GraphQLError(f"unexpected {rest[0]!r}")
                break
            self.tokens.append(m[1])
            at = m.end()
        self.at, self.variables = 0, dict(variables)

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        found = self.peek()
        if not found or want is not None and found != want:
            raise GraphQLError(f"expected {want or 'more'}, found {found or 'the end'}")
        self.at += 1
        return found

    def operation(self) -> Operation:
        kind, name = "query", ""
        if self.peek() in ("query", "mutation"):
            kind = self.take()
            if self.peek() not in ("{", "("):
                name = self.take()
            if self.peek() == "(":
                self.take()
                while self.peek() != ")":
                    self.take("$")
                    variable = self.take()
                    self.take(":")
                    while self.peek() not in ("$", ")", "="):
                        self.take()
                    if self.peek() == "=":
                        self.take()
                        self.variables.setdefault(variable, self.value())
                self.take(")")
        return Operation(kind, name, self.selections())

    def selections(self) -> list[Field]:
        out = []
        self.take("{")
        while self.peek() != "}":
            name = alias = self.take()
            if self.peek() == ":":
                self.take()
                name = self.take()
            f = Field(name, alias)
            if self.peek() == "(":
                self.take()
                while self.peek() != ")":
                    key = self.take()
                    self.take(":")
                    f.arguments[key] = self.value()
                self.take(")")
            if self.peek() == "{":
                f.selections = self.selections()
            out.append(f)
        self.take("}")
        return out

    def value(self) -> Any:
        t = self.take()
        if t == "$":
            return self.variables.get(self.take())
        if t == "[":
            out = []
            while self.peek() != "]":
                out.append(self.value())
            self.take("]")
            return out
        if t == "{":
            held = {}
            while self.peek() != "}":
                key = self.take()
                self.take(":")
                held[key] = self.value()
            self.take("}")
            return held
        if t[0] == '"':
            return json.loads(t)
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if re.fullmatch(r"-?\d+\.\d+(?:[eE][+-]?\d+)?", t):
            return float(t)
        return {"true": True, "false": False, "null": None}.get(t, t)


def parse(query: str, variables: Mapping[str, Any] | None = None) -> Operation:
    """An operation with its variables put in."""
    reader = _Reader(query, variables or {})
    out = reader.operation()
    if reader.peek():
        raise GraphQLError(f"unexpected {reader.peek()}")
    return out


def type_name(name: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in re.split(r"[^A-Za-z0-9]+", name) if w)


def schema(net: Net, name: str, prefix: str = "") -> str:
    """Schema text of a model: its instances, their marking, and a mutation per transition."""
    t = type_name(name)
    p = f"{prefix}_" if prefix else ""
    places = "\n".join(f"  {x}: Float!" for x in sorted(net.places))
    moves = "\n".join(f"  {p}{x}(id: ID!, input: JSON): {t}Instance!" for x in sorted(net.transitions))
    one, many = (f"{prefix}Instance", f"{prefix}Instances") if prefix else ("instance", "instances")
    return (
        f"scalar JSON\n\ntype {t}Marking {{\n{places}\n}}\n\n"
        f"type {t}Instance {{\n  id: ID!\n  version: Int!\n  marking: {t}Marking!\n  enabled: [String!]!\n}}\n\n"
        f"type {t}Page {{\n  items: [{t}Instance!]!\n  total: Int!\n  page: Int!\n  perPage: Int!\n}}\n\n"
        f"type Query {{\n  {one}(id: ID!): {t}Instance\n  {many}(place: String, page: Int, perPage: Int): {t}Page!\n}}\n\n"
        f"type Mutation {{\n  {p}create: {t}Instance!\n{moves}\n}}\n"
    )


def unified_schema(models: Mapping[str, Net], others: Mapping[str, str] | None = None) -> str:
    """One schema of several models, fields named by model; types of other schemas get their service's name."""
    bodies: dict[str, list[str]] = {"Query": [], "Mutation": []}
    out = ["scalar JSON"]
    texts = [(schema(net, name, name), "") for name, net in sorted(models.items())] + [(text, service) for service, text in sorted((others or {}).items())]
    for text, service in texts:
        names = re.findall(r"^type (\w+)", text, re.M)
        for kind, body in re.findall(r"^type (\w+) \{\n(.*?)\n\}", text, re.M | re.S):
            if service:
                for n in names:
                    if n not in bodies:
                        body = re.sub(rf"\b{n}\b", f"{type_name(service)}{n}", body)
            if kind in bodies:
                bodies[kind].append(re.sub(r"^  (\w+)", rf"  {service}_\1", body, flags=re.M) if service else body)
            else:
                out.append(f"type {type_name(service) if service else ''}{kind} {{\n{body}\n}}")
    out += [f"type {k} {{\n" + "\n".join(v) + "\n}" for k, v in bodies.items() if v]
    return "\n\n".join(out) + "\n"


def introspection(text: str) -> dict[str, Any]:
    """Types and fields of a schema text."""
    types = []
    for kind, body in re.findall(r"^type (\w+) \{\n(.*?)\n\}", text, re.M | re.S):
        fields = [{"name": n, "type": t} for n, t in re.findall(r"^  (\w+)(?:\([^)]*\))?: (.+)$", body, re.M)]
        types.append({"kind": "OBJECT", "name": kind, "fields": fields})
    return {"__schema": {"queryType": {"name": "Query"}, "mutationType": {"name": "Mutation"}, "types": types}}


def select(value: Any, fields: list[Field]) -> Any:
    """A value cut to the fields that were asked for."""
    if not fields or value is None:
        return value
    if isinstance(value, list):
        return [select(v, fields) for v in value]
    return {f.alias: select(value.get(f.name), f.selections) for f in fields}


class Server:
    """Executes operations over instances of models.

    ``load`` gives the events of a model; ``append`` stores an event ``(model, id, type, data)``, after it was found
    enabled; ``resolvers`` take fields of other services by their prefix.
    """

    def __init__(self, models: Mapping[str, Net], load: Callable[[str], DataFrame], append: Callable[[str, str, str, Any], None], new_id: Callable[[], str], resolvers: Mapping[str, Callable[[Field], Any]] | None = None):
        self.models, self.load, self.append, self.new_id, self.resolvers = dict(models), load, append, new_id, dict(resolvers or {})

    def states(self, model: str) -> DataFrame:
        """``id, version, marking`` of a model's instances, by summing what their events add and take."""
        net = self.models[model]
        ps, ts, m = net.incidence()
        events = self.load(model)
        effects = [(t, p, float(m[i][j])) for j, t in enumerate(ts) for i, p in enumerate(ps) if m[i][j]]
        table = events.sparkSession.createDataFrame(effects, "type string, place string, change double")
        heads = events.groupBy("stream_id").agg(F.max("version").alias("version"))
        base = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(p).alias("key"), F.lit(net.places[p].tokens).alias("value")) for p in ps])))
        start = heads.select("stream_id", base.alias("place", "tokens"))
        moved = events.join(table, "type").select("stream_id", "place", F.col("change").alias("tokens"))
        summed = start.union(moved).groupBy("stream_id", "place").agg(F.sum("tokens").alias("tokens"))
        maps = summed.groupBy("stream_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("place", "tokens")))).alias("marking"))
        return heads.join(maps, "stream_id").select(F.col("stream_id").alias("id"), "version", "marking")

    def instance(self, model: str, id: str) -> dict[str, Any] | None:
        row = self.states(model).where(F.col("id") == id).first()
        if row is None:
            return None
        return {"id": row.id, "version": row.version, "marking": row.marking, "enabled": self.enabled(model, row.marking)}

    def enabled(self, model: str, marking: Mapping[str, float]) -> list[str]:
        net = self.models[model]
        return [t for t in sorted(net.transitions) if all((marking.get(a.source, 0) <= 0) if a.inhibit else marking.get(a.source, 0) >= a.total for a in net.inputs(t))]

    def instances(self, model: str, place: str | None = None, page: int = 1, per_page: int = 20) -> dict[str, Any]:
        rows = self.states(model)
        if place:
            rows = rows.where(F.try_element_at("marking", F.lit(place)) > 0)
        items = [{"id": r.id, "version": r.version, "marking": r.marking, "enabled": self.enabled(model, r.marking)} for r in page_of(rows, ["id"], page, per_page).collect()]
        return {"items": items, "total": rows.count(), "page": page, "perPage": per_page}

    def fire(self, model: str, id: str, transition: str, data: Any = None) -> dict[str, Any]:
        found = self.instance(model, id)
        if found is None or transition not in found["enabled"]:
            raise GraphQLError(f"{transition} cannot fire")
        self.append(model, id, transition, data)
        return self.instance(model, id)

    def create(self, model: str) -> dict[str, Any]:
        id = self.new_id()
        self.append(model, id, "created", None)
        return self.instance(model, id)

    def execute(self, query: str, variables: Mapping[str, Any] | None = None) -> dict[str, Any]:
        """The response to a request: data by alias, cut to the selections, and errors."""
        try:
            operation = parse(query, variables)
        except GraphQLError as e:
            return {"errors": [{"message": str(e)}]}
        data, errors = {}, []
        for f in operation.fields:
            try:
                data[f.alias] = select(self._resolve(f, operation.kind == "mutation"), f.selections)
            except (GraphQLError, KeyError, ValueError) as e:
                errors.append({"message": str(e), "path": [f.alias]})
        return {"data": data, **({"errors": errors} if errors else {})}

    def _resolve(self, f: Field, mutation: bool) -> Any:
        if f.name in ("__schema", "__type"):
            return introspection(unified_schema(self.models))["__schema"]
        for service, resolver in self.resolvers.items():
            if f.name.startswith(f"{service}_"):
                return resolver(f)
        a = f.arguments
        for model in sorted(self.models, key=len, reverse=True):
            alone = len(self.models) == 1
            if mutation:
                for prefix in (f"{model}_", "" if alone else None):
                    if prefix is not None and f.name.startswith(prefix):
                        action = f.name[len(prefix) :]
                        if action == "create":
                            return self.create(model)
                        if action in self.models[model].transitions:
                            return self.fire(model, str(a.get("id")), action, a.get("input"))
            elif f.name == f"{model}Instance" or alone and f.name == "instance":
                return self.instance(model, str(a.get("id")))
            elif f.name == f"{model}Instances" or alone and f.name == "instances":
                return self.instances(model, a.get("place"), a.get("page") or 1, a.get("perPage") or 20)
        raise GraphQLError(f"no field {f.name}")
