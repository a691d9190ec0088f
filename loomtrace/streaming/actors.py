"""Signals between actors as tables and streams.

Signals have ``id, type, source, target, payload map<string,string>, ts, correlation_id``. All operators but the keyed
ones are stateless expressions and run on streams as on tables; nothing is dropped under load.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.net import Net
from .keyed import Fold, fold_batch, fold_stream

SIGNAL_SQL = "id string, type string, source string, target string, payload map<string,string>, ts timestamp, correlation_id string"


def dispatch(signals: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``actor_id, priority`` and the signal for every subscription (``actor_id, type, priority``) that it meets: of its
    type or ``*``, and of its target if it has one. Each signal asks for both its type and ``*``, so the join is one of
    equals, which is hashed or broadcast."""
    s = subscriptions.withColumnRenamed("type", "__wanted")
    asked = signals.withColumn("__wanted", F.explode(F.array_distinct(F.array(F.coalesce("type", F.lit("")), F.lit("*")))))
    to = F.coalesce(F.col("target"), F.lit("")).isin("") | (F.col("target") == F.col("actor_id"))
    return asked.join(s, "__wanted").where(to).drop("__wanted")


def unsubscribe(subscriptions: DataFrame, actor_id: str, type: str | None = None) -> DataFrame:
    gone = F.col("actor_id") == actor_id
    return subscriptions.where(~(gone if type is None else gone & (F.col("type") == type)))


def delivery_order(delivered: DataFrame) -> DataFrame:
    """Deliveries of a table in the order in which handlers run: by signal, then by falling priority."""
    return delivered.orderBy("ts", "id", F.desc("priority"), "actor_id")


def middleware(signals: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda df, f: f(df), steps, signals)


def keep(condition: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.where(condition)


def change(**columns: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns(columns)


def tap(name: str) -> Callable[[DataFrame], DataFrame]:
    """Counts signals by the way, under ``name`` in the query's metrics."""
    return lambda df: df.observe(name, F.count(F.lit(1)).alias("signals"))


def dedupe_fold(window_s: float) -> Fold:
    """Passes a signal if none of its type and source passed in the window before it."""

    def fold(key: tuple, held: dict | None, rows: list[dict]) -> tuple[dict | None, list[dict]]:
        last = held["last"] if held else None
        out = []
        for r in rows:
            now = pd.Timestamp(r["ts"]).timestamp()
            if last is None or now - last >= window_s:
                last = now
                out.append(r)
        return ({"last": last} if last is not None else None), out

    return fold


def dedupe(signals: DataFrame, window_s: float) -> DataFrame:
    """Signals without those that follow one of their type and source that passed, within the window.

    In a table, a signal after a silence as long as the window always passes, so runs between silences are folded on
    their own, and a busy source is spread over tasks.
    """
    flat = signals.withColumn("payload", F.to_json("payload"))
    schema = SIGNAL_SQL.replace("payload map<string,string>", "payload string")
    if signals.isStreaming:
        out = fold_stream(flat, ["type", "source"], ["ts", "id"], dedupe_fold(window_s), schema)
    else:
        order = Window.partitionBy("type", "source").orderBy("ts", "id")
        silent = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) >= F.lit(int(window_s * 1_000_000))
        runs = flat.withColumn("run", F.sum(F.when(silent, 1).otherwise(0)).over(order))
        out = fold_batch(runs, ["type", "source", "run"], ["ts", "id"], dedupe_fold(window_s), schema)
    return out.withColumn("payload", F.from_json("payload", "map<string,string>"))


def broadcast(buses: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, buses)


def bus_stats(signals: DataFrame, delivered: DataFrame) -> DataFrame:
    """One row: ``published, delivered, types``."""
    a = signals.agg(F.count(F.lit(1)).alias("published"), F.countDistinct("type").alias("types"))
    return a.crossJoin(delivered.agg(F.count(F.lit(1)).alias("delivered")))


def counter(signals: DataFrame, type: str) -> DataFrame:
    """Signals of a type with ``count``, how many of its source there are up to each."""
    w = Window.partitionBy("source").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return signals.where(F.col("type") == type).withColumn("count", F.count(F.lit(1)).over(w))


def forward(signals: DataFrame, type: str, to: str) -> DataFrame:
    return signals.where(F.col("type") == type).withColumn("type", F.lit(to))


def throttle(signals: DataFrame, type: str, per_second: int) -> DataFrame:
    """The first ``per_second`` signals of a type in each second; other types pass."""
    w = Window.partitionBy("type", F.date_trunc("second", "ts")).orderBy("ts", "id")
    return signals.withColumn("__n", F.row_number().over(w)).where((F.col("type") != type) | (F.col("__n") <= per_second)).drop("__n")


def process(signals: DataFrame, type: str, to: str, payload: Column) -> DataFrame:
    return signals.where(F.col("type") == type).withColumn("payload", payload).withColumn("type", F.lit(to))


def route(signals: DataFrame, type: str, routes: Mapping[str, str]) -> DataFrame:
    """Signals of a type become the type that their payload's ``route`` leads to; others go nowhere."""
    table = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])
    to = F.try_element_at(table, F.try_element_at("payload", F.lit("route")))
    return signals.where(F.col("type") == type).withColumn("type", to).where("type is not null")


def split(signals: DataFrame, type: str, types: Sequence[str]) -> DataFrame:
    return signals.where(F.col("type") == type).withColumn("type", F.explode(F.array(*[F.lit(t) for t in types])))


def filtered(signals: DataFrame, type: str, to: str, condition: Column) -> DataFrame:
    return signals.where((F.col("type") == type) & condition).withColumn("type", F.lit(to))


def batches_fold(n: int, to: str) -> Fold:
    """A signal after every ``n``, with the ids of those that it stands for."""

    def fold(key: tuple, held: dict | None, rows: list[dict]) -> tuple[dict | None, list[dict]]:
        ids = list(held["ids"]) if held else []
        out = []
        for r in rows:
            ids.append(r["id"])
            if len(ids) == n:
                out.append({"source": key[0], "type": to, "ts": r["ts"], "ids": ",".join(ids), "n": n})
                ids = []
        return ({"ids": ids} if ids else None), out

    return fold


def aggregate(signals: DataFrame, type: str, to: str, n: int) -> DataFrame:
    """A signal for every ``n`` of a type and source, in order; those left over give none (yet)."""
    rows = signals.where(F.col("type") == type).select("source", "id", "ts")
    if signals.isStreaming:
        return fold_stream(rows, ["source"], ["ts", "id"], batches_fold(n, to), "source string, type string, ts timestamp, ids string, n int")
    place = F.row_number().over(Window.partitionBy("source").orderBy("ts", "id")) - 1
    batches = rows.withColumn("batch", F.floor(place / n)).groupBy("source", "batch").agg(F.array_sort(F.collect_list(F.struct("ts", "id"))).alias("all"))
    return batches.where(F.size("all") == n).select("source", F.lit(to).alias("type"), F.element_at("all", -1).ts.alias("ts"), F.array_join("all.id", ",").alias("ids"), F.lit(n).alias("n"))


def request(signals: DataFrame, type: str, reply_type: str) -> DataFrame:
    """Signals of a type as requests: each gets a correlation id, its own id, and says in ``reply_to`` of which type an
    answer is to be."""
    return signals.where(F.col("type") == type).withColumn("correlation_id", F.col("id")).withColumn("reply_to", F.lit(reply_type))


def reply(requests: DataFrame, actor: str, payload: Column) -> DataFrame:
    """What ``actor`` answers to requests: a signal of the type asked for, to the source, with the same correlation id."""
    return requests.select(F.concat("id", F.lit("/reply")).alias("id"), F.col("reply_to").alias("type"), F.lit(actor).alias("source"), F.col("source").alias("target"), payload.alias("payload"), "ts", "correlation_id")


def answered(requests: DataFrame, signals: DataFrame) -> DataFrame:
    """``correlation_id, source, asked_at, reply_id, replied_at`` of requests; nulls where there is no answer (yet). Of
    several answers the first counts."""
    answers = signals.where("correlation_id is not null").groupBy("correlation_id", F.col("type").alias("reply_to")).agg(F.min(F.struct("ts", "id")).alias("first"))
    met = requests.join(answers, ["correlation_id", "reply_to"], "left")
    return met.select("correlation_id", "source", F.col("ts").alias("asked_at"), F.col("first.id").alias("reply_id"), F.col("first.ts").alias("replied_at"))


def net_fold(net: Net, transition_of: Mapping[str, str], emits: Mapping[str, str]) -> Fold:
    """An actor that is a net: signals fire transitions where they can, which emit signals. Its marking is kept."""

    def fold(key: tuple, held: dict | None, rows: list[dict]) -> tuple[dict | None, list[dict]]:
        marking = dict(held or net.state())
        out = []
        for r in rows:
            t = transition_of.get(r["type"])
            if t is None or any((marking[a.source] > 0) if a.inhibit else marking[a.source] < a.total for a in net.inputs(t)):
                continue
            for a in net.inputs(t):
                if not a.inhibit:
                    marking[a.source] -= a.total
            for a in net.outputs(t):
                marking[a.target] += a.total
            if t in emits:
                out.append({"source": key[0], "type": emits[t], "ts": r["ts"], "transition": t})
        return marking, out

    return fold


def net_actor(signals: DataFrame, net: Net, transition_of: Mapping[str, str], emits: Mapping[str, str]) -> DataFrame:
    """Signals that the nets of all sources emit, one net a source."""
    run = fold_stream if signals.isStreaming else fold_batch
    rows = signals.where(F.col("type").isin(list(transition_of))).select("source", "type", "id", "ts")
    return run(rows, ["source"], ["ts", "id"], net_fold(net, transition_of, emits), "source string, type string, ts timestamp, transition string")
