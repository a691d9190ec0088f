"""Streams give what the same operators give over tables."""

import time

from pyspark.sql import functions as F

from loomtrace import queries
from loomtrace.plans.net import Net
from loomtrace.streaming import actors, keyed, monitor, statechart

DIR = "/root/testdata/sf0.001"


def streamed(spark, table, operator, tmp_path, name):
    """The rows of an operator over a table read as a stream, in two files."""
    ordered = table.orderBy("ts", "id") if "id" in table.columns else table
    path = str(tmp_path / name)
    ordered.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    q = operator(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def as_set(df):
    return sorted(map(str, df.collect()))


def test_dedupe_stream_equals_table(spark, tmp_path):
    signals = queries.signals(spark, DIR).where("source < '4'")
    f = lambda df: actors.dedupe(df, 86_400.0).select("id", "type", "source")
    assert as_set(streamed(spark, signals, f, tmp_path, "deduped")) == as_set(f(signals))


def test_stateless_stream(spark, tmp_path):
    signals = queries.signals(spark, DIR)
    f = lambda df: actors.split(actors.forward(df, "click", "tap"), "tap", ["l", "r"]).select("id", "type")
    assert as_set(streamed(spark, signals, f, tmp_path, "splits")) == as_set(f(signals))


def test_monitor(spark):
    net = queries.talk_net()
    rows = [("c", "start", "", 0, 0), ("c", "event", "user", 60, 1), ("c", "event", "assistant", 9000, 2), ("c", "complete", "", 9001, 3), ("x", "event", "user", 5, 4)]
    events = spark.createDataFrame([(c, a, k, s, i) for c, k, a, s, i in rows], "case_id string, activity string, kind string, s long, seq long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    out = monitor.monitor(events, net, {"user": 0.05, "assistant": 0.05}, monitor.Config(sla_s=1000.0))
    by_alert = {r.alert: r for r in out.collect() if r.alert}
    assert set(by_alert) == {"rejected", "stuck", "sla_violation"}
    first = out.where("activity = 'user' and case_id = 'c'").first()
    assert first.next_activity == "assistant" and 0 < first.remaining_s < 100 and first.confidence > 0.9
    assert monitor.active_cases(events).count() == 0
    p = monitor.next_activities(net, {"user": 1.0, "assistant": 3.0}, {"start": 1.0, "asked": 1.0, "end": 0.0})
    assert {a: round(x, 2) for a, x, _ in p} == {"user": 0.25, "assistant": 0.75}


def test_rules():
    from loomtrace.plans.net import Net

    seen = []
    engine = monitor.RuleEngine(Net().chain(10, "A", "t", "B")).rule("half", monitor.all_of(monitor.above("B", 5), monitor.below("A", 5)), seen.append)
    while not engine.step(0.1):
        assert engine.time < 5
    assert seen and seen[0]["B"] > 5


def test_statechart():
    chart = statechart.Chart("c").region("power", "off", "on", "on.low", "on.high").region("lid", "shut", "open").counter("n")
    chart.when("press", "power:off", "power:on", None, statechart.increment("n"))
    chart.when("up", "power:on.low", "power:on.high", lambda c: c["n"] >= 1).when("press", "power:on", "power:off")
    m = statechart.Machine(chart)
    assert not m.send("up") and m.send("press")
    assert m.full_state("power") == "on.low" and m.state("power") == "on" and m.substate("power", "on") == "low"
    assert m.send("up") and m.is_in("power:on") and m.counter("n") == 1
    assert m.send("press") and m.state("power") == "off" and m.state("lid") == "shut"
    assert len(chart.net().transitions) == 3


def test_statechart_over_events(spark):
    chart = statechart.Chart("lamp").region("lamp", "off", "on").when("t", "lamp:off", "lamp:on").when("t", "lamp:on", "lamp:off")
    e = spark.createDataFrame([("k", i, "t" if i != 1 else "x") for i in range(4)], "key string, seq long, event string")
    assert [r.state for r in statechart.run_chart(e, chart).orderBy("seq").collect()] == ["lamp:on", "lamp:on", "lamp:off", "lamp:on"]


def test_dispatch_is_a_join_of_equals(spark):
    signals = spark.createDataFrame([("1", "click", "s", None, None, None, None), ("2", None, "s", "b", None, None, None)], actors.SIGNAL_SQL)
    subs = spark.createDataFrame([("a", "click", 1), ("b", "*", 2), ("c", "*", 3), ("d", "view", 4)], "actor_id string, type string, priority int")
    out = actors.dispatch(signals, subs)
    assert {(r.id, r.actor_id) for r in out.collect()} == {("1", "a"), ("1", "b"), ("1", "c"), ("2", "b")}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_folds_of_a_hot_key_and_null_keys(spark):
    """A key's rows reach the fold batch by batch, in order; missing keys are one key."""
    rows = spark.range(30_000).select(F.lit("hot").alias("k"), F.col("id").alias("i")).unionByName(spark.createDataFrame([(None, 1), (None, 2)], "k string, i long"))

    def fold(key, held, rows):
        n = (held or {"n": 0})["n"]
        out = []
        for r in rows:
            n += 1
            out.append({"k": key[0], "i": r["i"], "n": n})
        return {"n": n}, out

    got = keyed.fold_batch(rows, ["k"], ["i"], fold, "k string, i long, n long")
    assert got.where("k = 'hot' and n <> i + 1").count() == 0 and got.where("k is null").count() == 2
    assert got.where("k is null").agg(F.max("n")).first()[0] == 2


def test_silent_cases_are_assessed_by_a_timer(spark, tmp_path):
    """A case without events is found stuck when processing time goes on, without any further event."""
    source = tmp_path / "in"
    rows = [("c", "", "2024-01-01 00:00:00", 0, "start"), ("c", "user", "2024-01-01 00:01:00", 1, "event")]
    make = lambda r: spark.createDataFrame(r, "case_id string, activity string, at string, seq long, kind string").withColumn("ts", F.col("at").cast("timestamp")).drop("at")
    make(rows).coalesce(1).write.parquet(str(source))
    events = spark.readStream.schema(make(rows).schema).parquet(str(source))
    net = Net().place("start", 1.0).place("end").transition("user").flow("start", "user", "end")
    out = monitor.monitor(events, net, {"user": 0.1}, monitor.Config(predictions=False), every_s=0.5)
    q = out.writeStream.format("memory").queryName("silent").outputMode("append").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        end = time.time() + 60
        while time.time() < end and not spark.sql("select * from silent where alert = 'stuck'").count():
            time.sleep(0.5)
        assert spark.sql("select * from silent where alert = 'stuck'").count() >= 1
    finally:
        q.stop()
