"""An append-only event store as DataFrames: streams, replay, instances, statistics, snapshots and search.

Events have ``id, stream_id, type, version, timestamp, data`` (JSON) and ``metadata``; versions of a stream count from 0.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

EVENTS_SQL = "id string, stream_id string, type string, version int, timestamp timestamp, data string, metadata map<string,string>"


class ConcurrencyConflict(RuntimeError):
    """The stream is not at the version that the writer expected."""


def event_filter(stream_id: str | None = None, types: Sequence[str] = (), from_version: int = 0, to_version: int = 0, since: str | None = None, until: str | None = None) -> Column:
    """The condition of a filter; 0 means no bound on versions, times include their bounds."""
    out = F.lit(True)
    if stream_id:
        out = out & (F.col("stream_id") == stream_id)
    if types:
        out = out & F.col("type").isin(list(types))
    if from_version > 0:
        out = out & (F.col("version") >= from_version)
    if to_version > 0:
        out = out & (F.col("version") <= to_version)
    if since:
        out = out & (F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until:
        out = out & (F.col("timestamp") <= F.lit(until).cast("timestamp"))
    return out


def read_stream(events: DataFrame, stream_id: str, from_version: int = 0) -> DataFrame:
    return events.where((F.col("stream_id") == stream_id) & (F.col("version") >= from_version)).orderBy("version")


def read_all(events: DataFrame, condition: Column | None = None, limit: int = 0) -> DataFrame:
    """Filtered events by time, stream and version."""
    out = (events if condition is None else events.where(condition)).orderBy("timestamp", "stream_id", "version")
    return out.limit(limit) if limit > 0 else out


def stream_versions(events: DataFrame) -> DataFrame:
    return events.groupBy("stream_id").agg(F.max("version").alias("version"))


def stream_version(events: DataFrame, stream_id: str) -> int:
    """The stream's last version, -1 if it has none."""
    return events.where(F.col("stream_id") == stream_id).agg(F.coalesce(F.max("version"), F.lit(-1)).alias("v")).first().v


def with_versions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New events (``stream_id, type, timestamp, seq, data, metadata``) with ids and the versions after the last of
    their streams, in the order of ``seq``."""
    last = stream_versions(existing).withColumnRenamed("version", "last")
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq"))
    numbered = new.join(last, "stream_id", "left").withColumn("version", (F.coalesce("last", F.lit(-1)) + place).cast("int"))
    return numbered.select(F.uuid().alias("id"), "stream_id", "type", "version", "timestamp", "data", "metadata")


class EventStore:
    """A store in a folder of Parquet files, partitioned by a hash of the stream; reading one stream reads one partition.

    Writers claim the first version that they write by creating a file that must not exist, so of two that expect the
    same version one is refused. A writer that is lost before it has written leaves its claim: :meth:`recover` drops it.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._file("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _all(self) -> DataFrame:
        if not self._fs().exists(self._file("events")):
            return self.spark.createDataFrame([], EVENTS_SQL + ", bucket int")
        return self.spark.read.schema(EVENTS_SQL + ", bucket int").parquet(f"{self.path}/events")

    def events(self) -> DataFrame:
        self._settle()
        return self._all().drop("bucket")

    def stream(self, stream_id: str) -> DataFrame:
        """Events of one stream, from its partition alone."""
        self._settle()
        return self._all().where((F.col("bucket") == self._bucket(F.lit(stream_id))) & (F.col("stream_id") == stream_id)).drop("bucket")

    def _bucket(self, stream: Column) -> Column:
        return F.pmod(F.hash(stream), F.lit(self.BUCKETS))

    def _claim(self, stream_id: str, version: int):
        return self._file(f"claims/{hashlib.sha256(stream_id.encode()).hexdigest()}/{version}")

    def recover(self, stream_id: str) -> None:
        """Drop claims of versions that no event has; to be called when no writer of the stream is at work."""
        fs, claims = self._fs(), self._claim(stream_id, 0).getParent()
        current = stream_version(self.stream(stream_id), stream_id)
        for f in fs.listStatus(claims) if fs.exists(claims) else []:
            if int(f.getPath().getName()) > current:
                fs.delete(f.getPath(), False)

    def append(self, stream_id: str, expected_version: int, new: DataFrame) -> int:
        """Append events (``type, timestamp, seq, data, metadata``) and return the new version; a negative expected
        version is not compared."""
        current = stream_version(self.stream(stream_id), stream_id)
        if expected_version >= 0 and expected_version != current:
            raise ConcurrencyConflict(f"{stream_id} is at {current}, not {expected_version}")
        claim = self._claim(stream_id, current + 1)
        try:
            self._fs().create(claim, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            raise ConcurrencyConflict(f"{stream_id}: version {current + 1} is being written") from e
        try:
            place = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq"))
            rows = new.withColumn("stream_id", F.lit(stream_id)).withColumn("version", (F.lit(current) + place).cast("int"))
            rows = rows.select(F.uuid().alias("id"), "stream_id", "type", "version", "timestamp", "data", "metadata", self._bucket(F.col("stream_id")).alias("bucket"))
            written = Observation()
            rows.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/events")
        except BaseException:
            self._fs().delete(claim, False)
            raise
        if not written.get["n"]:
            self._fs().delete(claim, False)
        return current + written.get["n"]

    def delete_stream(self, stream_id: str) -> None:
        """Write the stream's bucket anew without it, beside the old one, and then put it in its place.

        If the driver is lost in between, the next reader finds either the old bucket or the new one whole.
        """
        self._settle()
        bucket = self.spark.range(1).select(self._bucket(F.lit(stream_id))).first()[0]
        fs, old = self._fs(), self._file(f"events/bucket={bucket}")
        if not fs.exists(old):
            return
        self.spark.read.schema(EVENTS_SQL).parquet(old.toString()).where(F.col("stream_id") != stream_id).write.mode("overwrite").parquet(f"{self.path}/writing/bucket={bucket}")
        fs.mkdirs(self._file("ready"))
        fs.rename(self._file(f"writing/bucket={bucket}"), self._file(f"ready/bucket={bucket}"))
        self._settle()
        fs.delete(self._claim(stream_id, 0).getParent(), True)

    def _settle(self) -> None:
        """Put buckets that were written anew, and are whole, in the place of the old ones."""
        fs, ready = self._fs(), self._file("ready")
        if not fs.exists(ready):
            return
        for f in fs.listStatus(ready):
            name = f.getPath().getName()
            fs.delete(self._file(f"events/{name}"), True)
            fs.rename(f.getPath(), self._file(f"events/{name}"))
        fs.delete(ready, False)

    def subscribe(self, stream_id: str | None = None, types: Sequence[str] = ()) -> DataFrame:
        """New events as a streaming DataFrame, filtered by stream and type; nothing is dropped."""
        source = self.spark.readStream.schema(EVENTS_SQL + ", bucket int").parquet(f"{self.path}/events")
        return source.drop("bucket").where(event_filter(stream_id, types))


def _places(events: DataFrame) -> DataFrame:
    """``data.state`` of events in long form: ``stream_id, version, place, tokens``."""
    state = F.from_json(F.get_json_object("data", "$.state"), "map<string,double>")
    return events.select("stream_id", "version", F.explode(state).alias("place", "tokens"))


def instance_states(events: DataFrame) -> DataFrame:
    """``stream_id, place, tokens``: each place's value in the last event that states it."""
    return _places(events).groupBy("stream_id", "place").agg(F.max_by("tokens", "version").alias("tokens"))


def instances(events: DataFrame, place: str | None = None) -> DataFrame:
    """``stream_id, version, updated_at, state``, those with tokens in ``place`` if it is given."""
    states = instance_states(events)
    maps = states.groupBy("stream_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("place", "tokens")))).alias("state"))
    heads = events.groupBy("stream_id").agg(F.max("version").alias("version"), F.max("timestamp").alias("updated_at"))
    out = heads.join(maps, "stream_id", "left")
    if place:
        out = out.join(states.where((F.col("place") == place) & (F.col("tokens") > 0)).select("stream_id"), "stream_id", "left_semi")
    return out


def page_of(rows: DataFrame, order: Sequence[str | Column], page: int = 1, per_page: int = 50) -> DataFrame:
    """One page of rows in an order; pages count from 1."""
    return rows.orderBy(*order).offset((max(page, 1) - 1) * per_page).limit(per_page)


def recent_instances(events: DataFrame, since: str | None = None, until: str | None = None, page: int = 1, per_page: int = 50) -> DataFrame:
    """Instances by last update, the latest first."""
    heads = events.groupBy("stream_id").agg(F.max("version").alias("version"), F.max("timestamp").alias("updated_at"))
    if since:
        heads = heads.where(F.col("updated_at") >= F.lit(since).cast("timestamp"))
    if until:
        heads = heads.where(F.col("updated_at") <= F.lit(until).cast("timestamp"))
    return page_of(heads, [F.desc("updated_at"), "stream_id"], page, per_page)


def store_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("stream_id").alias("instances"), F.count(F.lit(1)).alias("events"))


def stats_by_place(events: DataFrame) -> DataFrame:
    """``place, events``: how many events state tokens in a place."""
    return _places(events).where("tokens > 0").groupBy("place").agg(F.count(F.lit(1)).alias("events"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The snapshot of greatest version of each stream."""
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("version")))
    return snapshots.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def save_snapshot(snapshots: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Snapshots with those of ``snapshot``'s streams replaced."""
    return snapshots.join(snapshot.select("stream_id"), "stream_id", "left_anti").unionByName(snapshot)


def delete_snapshots(snapshots: DataFrame, stream_id: str) -> DataFrame:
    return snapshots.where(F.col("stream_id") != stream_id)


def index_events(events: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``stream_id, field, value, updated_at``: the latest value of each field of the data, arrays of text joined."""
    def value(f: str) -> Column:
        raw = F.get_json_object("data", f"$.{f}")
        parts = F.from_json(raw, "array<string>")
        return F.when(raw.startswith("["), F.array_join(parts, " ")).otherwise(raw)

    long = events.select("stream_id", "version", "timestamp", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields])).alias("f")).where("f.value is not null")
    return long.groupBy("stream_id", F.col("f.field").alias("field")).agg(F.max_by("f.value", "version").alias("value"), F.max_by("timestamp", "version").alias("updated_at"))


def search(index: DataFrame, query: str, field: str | None = None, limit: int = 50) -> DataFrame:
    """``stream_id, hits, matches, updated_at``: streams whose values contain the query in any case, by the number of
    occurrences, then the latest."""
    rows = index if not field else index.where(F.col("field") == field)
    needle = query.lower()
    count = (F.length("value") - F.length(F.replace(F.lower("value"), F.lit(needle), F.lit("")))) / F.lit(max(1, len(needle)))
    found = rows.where(F.lower("value").contains(needle)).withColumn("hits", count)
    out = found.groupBy("stream_id").agg(F.sum("hits").cast("long").alias("hits"), F.sort_array(F.collect_list(F.struct("field", "value"))).alias("matches"), F.max("updated_at").alias("updated_at"))
    return out.orderBy(F.desc("hits"), F.desc("updated_at"), "stream_id").limit(limit)


def replay_linear(events: DataFrame, effects: DataFrame) -> DataFrame:
    """``stream_id, place, tokens``: the sum of what events' transitions add and take.

    ``effects`` has ``type, place, change``. As firing only adds and subtracts, no order is needed, and streams of any
    length are summed in parallel.
    """
    return events.join(effects, "type").groupBy("stream_id", "place").agg(F.sum("change").alias("tokens"))


def replay_guarded(events: DataFrame, transitions: Sequence[tuple[str, dict[str, int], dict[str, int]]], initial: dict[str, int]) -> DataFrame:
    """``stream_id, version, state, fired, refused``: each stream's state machine, where a transition that lacks tokens
    does not fire. ``transitions`` are (type, taken, given). One ordered fold per stream, in the JVM."""
    names = sorted({*initial, *(p for _, a, b in transitions for p in (*a, *b))})
    tokens = F.array(*[F.lit(int(initial.get(p, 0))).cast("long") for p in names])
    vector = lambda d: F.array(*[F.lit(int(d.get(p, 0))).cast("long") for p in names])
    zero = vector({})
    need, change = F.lit(None).cast("array<bigint>"), zero
    for kind, taken, given in transitions:
        need = F.when(F.col("type") == kind, vector(taken)).otherwise(need)
        change = F.when(F.col("type") == kind, vector({p: given.get(p, 0) - taken.get(p, 0) for p in names})).otherwise(change)
    steps = events.select("stream_id", "version", need.alias("need"), change.alias("change"))
    folded = steps.groupBy("stream_id").agg(F.max("version").alias("version"), F.array_sort(F.collect_list(F.struct("version", "need", "change"))).alias("steps"))
    start = F.struct(tokens.alias("m"), F.lit(0).cast("long").alias("fired"), F.lit(0).cast("long").alias("refused"))

    def step(acc: Column, s: Column) -> Column:
        known = s.need.isNotNull()
        can = known & F.forall(F.zip_with(acc.m, F.coalesce(s.need, zero), lambda m, n: m >= n), lambda ok: ok)
        return F.struct(
            F.when(can, F.zip_with(acc.m, s.change, lambda m, c: m + c)).otherwise(acc.m).alias("m"),
            (acc.fired + F.when(can, 1).otherwise(0)).cast("long").alias("fired"),
            (acc.refused + F.when(can, 0).otherwise(1)).cast("long").alias("refused"),
        )

    out = folded.withColumn("r", F.aggregate("steps", start, step))
    return out.select("stream_id", "version", F.map_from_arrays(F.array(*[F.lit(p) for p in names]), F.col("r.m")).alias("state"), F.col("r.fired").alias("fired"), F.col("r.refused").alias("refused"))


@dataclass
class Aggregate:
    """One stream's state on the driver: handlers by event type fold its events."""

    id: str
    state: Any
    handlers: dict[str, Callable[[Any, dict], Any]] = field(default_factory=dict)
    version: int = -1

    def on(self, type: str, handler: Callable[[Any, dict], Any]) -> Aggregate:
        self.handlers[type] = handler
        return self

    def apply(self, type: str, data: dict, version: int) -> None:
        """Events of a type without a handler only count."""
        if type in self.handlers:
            self.state = self.handlers[type](self.state, data)
        self.version = version


class Repository:
    """Aggregates of a store: loaded by replay, saved by appending at the version that was loaded."""

    def __init__(self, store: EventStore, make: Callable[[str], Aggregate]):
        self.store, self.make = store, make

    def load(self, id: str) -> Aggregate:
        out = self.make(id)
        for r in read_stream(self.store.stream(id), id).select("type", "data", "version").collect():  # one stream
            out.apply(r.type, json.loads(r.data or "{}"), r.version)
        return out

    def save(self, aggregate: Aggregate, new: Sequence[tuple[str, dict]], timestamp: str) -> int:
        rows = [(t, i, json.dumps(d)) for i, (t, d) in enumerate(new)]
        df = self.store.spark.createDataFrame(rows, "type string, seq long, data string").withColumn("timestamp", F.lit(timestamp).cast("timestamp")).withColumn("metadata", F.lit(None).cast("map<string,string>"))
        if aggregate.version < 0 and stream_version(self.store.stream(aggregate.id), aggregate.id) >= 0:
            raise ConcurrencyConflict(f"{aggregate.id} exists")
        for i, (t, d) in enumerate(new, aggregate.version + 1):
            aggregate.apply(t, d, i)
        return self.store.append(aggregate.id, aggregate.version - len(new), df)

    def execute(self, id: str, command: Callable[[Any], Sequence[tuple[str, dict]]], timestamp: str) -> Aggregate:
        """Load, ask the command for events, and save them."""
        aggregate = self.load(id)
        self.save(aggregate, command(aggregate.state), timestamp)
        return aggregate
