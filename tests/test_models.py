"""Kernels, state spaces, guards, tokens, workflows and stores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.functions import guard
from loomtrace.operators import events, graphql, learn, statespace, tokens, workflow
from loomtrace.plans import ode, patterns, search
from loomtrace.plans.net import Net
from loomtrace.sources import results, templates


def decay():
    return Net().place("A", 100).transition("t").arc("A", "t")


@pytest.mark.parametrize("method", sorted(ode.METHODS))
def test_decay(method):
    path = ode.solve(decay(), {"A": 100}, {"t": 0.1}, (0, 10), method)
    assert path.final["A"] == pytest.approx(100 / math.e, rel=1e-2)


@pytest.mark.parametrize("method", ["implicit_euler", "trbdf2"])
def test_implicit(method):
    path = ode.solve_implicit(decay(), {"A": 100}, {"t": 0.1}, (0, 10), method, ode.Options(dt=0.01))
    assert path.final["A"] == pytest.approx(100 / math.e, rel=1e-2)


def test_conservation_and_rest():
    net, rates = templates.generate("sir")
    path = ode.solve(net, net.state(), rates, (0, 50))
    assert np.allclose(path.u.sum(axis=1), 1000)
    _, rest = ode.solve_until_rest(decay(), {"A": 100}, {"t": 1.0}, (0, 100))
    assert rest.reached and rest.state["A"] < 1e-4
    assert ode.find_rest(decay(), {"A": 100}, {"t": 0.01}, (0, 1))[1] is False


def test_sensitivity(spark):
    net, rates = templates.generate("sir")
    s = search.Sensitivity(spark, net, search.place_scorer("R"), rates=rates)
    impact = {r.transition: r.impact for r in s.knockouts().collect()}
    assert impact["recovery"] < 0 and abs(impact["recovery"]) > abs(impact["infection"])
    assert {r.transition: r.gradient for r in s.gradients().collect()}["recovery"] > 0
    best = s.grid({"recovery": [0.05, 0.1], "infection": [rates["infection"]]}).orderBy("rank").first()
    assert best.parameters["recovery"] == 0.1
    assert [r.best for r in s.sweep("recovery", [0.05, 0.1]).orderBy("rate").collect()] == [False, True]
    h = search.Hypotheses(spark, net, rates, search.place_scorer("R"), infeasible=lambda x: x["I"] > 50)
    assert h.best(net.state(), [{"I": 5}, {"I": 20}, {"I": 80}])[0] == 1
    assert h.evaluate(net.state(), {"I": 80}) == -math.inf


def test_state_spaces(spark):
    simple = Net().place("A", 2).place("B").transition("t1").flow("A", "t1", "B")
    f = statespace.StateSpace(simple).findings()
    assert (f.states, f.edges, f.bounded, f.has_cycle, len(f.deadlocks)) == (3, 2, True, False, 1)
    stuck = Net().place("start", 1).place("working").place("resource", 1).place("done").transition("begin").transition("finish")
    stuck.flow("start", "begin", "working").arc("resource", "begin").arc("begin", "resource").arc("working", "finish").arc("resource", "finish", 2).arc("finish", "done")
    f = statespace.StateSpace(stuck).verified()
    assert f.states == 2 and f.dead == ["finish"]
    cyclic = Net().place("idle", 1).place("working").transition("start").transition("finish").flow("idle", "start", "working").flow("working", "finish", "idle")
    space = statespace.StateSpace(cyclic)
    f = space.findings()
    assert (f.states, f.edges, f.live, f.has_cycle, f.cycles) == (2, 2, True, True, [["start", "finish"]])
    assert space.path_to({"working": 1}) == ["start"] and space.reaches({"idle": 1}) and space.can_fire("finish") == (True, ["start", "finish"])
    assert space.run(["start", "start"])[0] is False
    levels = statespace.explore(spark, simple)
    assert sorted((tuple(r.marking), r.depth) for r in levels.collect()) == [((0, 2), 2), ((1, 1), 1), ((2, 0), 0)]
    assert statespace.place_invariants(Net().sir(10, 1, 0)) == [({"I": 1.0, "R": 1.0, "S": 1.0}, 11.0)]
    assert statespace.conserves(cyclic) and statespace.verify_group(cyclic, statespace.conservation_groups(cyclic)[0])
    grows = Net().place("A", 1).transition("t").arc("A", "t").arc("t", "A", 2)
    assert not statespace.StateSpace(grows, max_states=5000).findings().bounded
    c = statespace.matrix_centrality(["a", "b", "c"], np.array([[0, 1, 1], [1, 0, 1], [1, 1, 0]]))
    assert c.eigenvalue == pytest.approx(2) and c.converged


@pytest.mark.parametrize(
    ("text", "want"),
    [("", True), ("a >= 3 && b == 'x'", True), ("!(a > 3) || missing", True), ("m['k'] == 0", True), ("m['u']['v'] + 2 * 3 == 13", True), ("-7 / 2 == -3", True), ("r.f < 2", True), ("a == '3'", True), ("sum('p') == 5 && count('p') == 2 && max('q') == 0", True), ("a % 2 == 0", False)],
)
def test_guards(text, want):
    bindings = {"a": 3, "b": "x", "m": {"u": {"v": 7}}, "r": {"f": 1}}
    assert guard.evaluate(text, bindings, guard.marking_functions({"p1": 2, "p2": 3})) is want


@pytest.mark.parametrize("text", ["a >", "1 < 2 < 3", "unknown", "f(1)", "r.g", "1 / 0", "(1", "#"])
def test_bad_guards(text):
    with pytest.raises(guard.GuardError):
        guard.evaluate(text, {"a": 1, "r": {}})


def test_guard_numbers_and_columns(spark):
    assert guard.evaluate_node(guard.parse("a - 1"), {"a": guard.U256(0)}, {}) == 2**256 - 1
    assert guard.evaluate("a + 1 < 0", {"a": 2**63 - 1})
    assert guard.holds("sum('') == 3 && tokens('b') == 2", {"a": 1, "b": 2})
    df = spark.createDataFrame([(7, -2, {"k": 5}), (8, 2, {})], "a long, b long, m map<string,long>")
    assert [r[0] for r in df.select(guard.to_column("a / b == -3 || m['k'] == 0 && a > 7").alias("x")).collect()] == [True, True]


def test_token_schemas():
    s = tokens.Schema("coin").token("ready", 1).data("balances", "map[address]uint256", exported=True).action("mint").action("transfer", "balances[from] >= amount")
    s.arc("ready", "mint").arc("mint", "balances", ["to"], "amount").arc("balances", "transfer", ["from"]).arc("transfer", "balances", ["to"]).constraint("one", "ready <= 1")
    assert s.problems() == [] and tokens.parse_schema(tokens.to_text(s)).same_structure(s)
    r = tokens.Runtime(s)
    r.execute("mint", {"to": "x", "amount": 10})
    with pytest.raises(tokens.NotEnabled):
        r.execute("transfer", {"from": "x", "to": "y", "amount": 11})
    r.execute("transfer", {"from": "x", "to": "y", "amount": 4})
    assert r.data["balances"] == {"x": 6, "y": 4} and not r.enabled("mint")
    assert tokens.Runtime(s).can_reach({"ready": 0}, 10)
    with pytest.raises(ValueError):
        tokens.parse_schema("(schema x (states (state a :colour red)))")


def test_equivalence(spark):
    a, b = Net().chain(1, "p", "t", "q"), Net().chain(1, "x", "u", "y")
    assert tokens.same_signature(a, b)
    assert tokens.check_mapping(a, b, {"p": "x", "t": "u", "q": "y"}) == []
    assert tokens.check_mapping(a, b, {"p": "y", "t": "u", "q": "y"})
    mapping, sure = tokens.mapping_by_trajectory(a, b, {"t": 0.3}, {"u": 0.3})
    assert mapping == {"p": "x", "q": "y"} and sure == 1.0
    assert tokens.behaviour_difference(a, b, mapping, {"t": 0.3}, {"u": 0.3})[1] < 1e-9
    assert [x[0] for x in tokens.rate_sensitivity(a, {"t": 0.3})] == ["t"]
    assert len(tokens.marking_sensitivity(a, {"t": 0.3})) == 2


def test_learning():
    net = Net().chain(100, "A", "t", "B")
    times = learn.uniform_times(0, 20, 11)
    seen = learn.Observations(times, {"A": [100 * math.exp(-0.2 * t) for t in times]})
    problem = learn.Problem(net, net.state(), (0, 20), {"t": learn.Linear([], np.array([0.05]))})
    fitted = learn.fit(problem, seen, max_iterations=60)
    assert fitted.final_loss < fitted.initial_loss and fitted.params[0] == pytest.approx(0.2, rel=0.02)


def test_workflow_engine():
    now = [0.0]
    w = workflow.Workflow("w", default_deadline_s=100).task("a").task("b", needs={"r": 1}).task("c", condition=workflow.when_var("x", ">", 1)).task("d", join="all", retries=1).resource("r", 1)
    w.parallel("a", "b", "c").merge("d", "b", "c")
    assert w.problems() == [] and w.starts() == ["a"] and w.ends() == ["d"]
    e = workflow.Engine(w, lambda: now[0])
    e.start_case("1", {"x": 0})
    e.start("1", "a")
    e.complete("1", "a")
    assert e.ready() == [("1", "b")] and e.cases["1"].tasks["c"]["status"] == "skipped"
    e.start("1", "b")
    assert e.available["r"] == 0
    e.complete("1", "b")
    e.start("1", "d")
    e.fail("1", "d")
    e.start("1", "d")
    e.complete("1", "d")
    assert e.cases["1"].status == "completed" and e.available["r"] == 1
    late, sure = workflow.forecast(w, {"a": "completed", "b": "running", "c": "skipped"})
    assert 0 < late < 86_400 and sure > 0.5 and workflow.risk(2, 1) == 1.0
    assert Net is type(w.net())


def test_event_store(spark, tmp_path):
    store = events.EventStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1, '{"state": {"p": 1}}'), ("b", 2, "{}")], "type string, seq long, data string").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    assert events.stream_version(store.events(), "s") == -1
    assert store.append("s", -1, rows) == 1 and store.append("s", 1, rows) == 3
    with pytest.raises(events.ConcurrencyConflict):
        store.append("s", 5, rows)
    assert [r.version for r in events.read_stream(store.events(), "s", 2).collect()] == [2, 3]
    store.append("other", -1, rows)
    store.delete_stream("s")
    assert {r.stream_id for r in store.events().collect()} == {"other"}


def test_event_store_scans_and_claims(spark, tmp_path):
    store = events.EventStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1, "{}")], "type string, seq long, data string").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    for s in "pqrs":
        store.append(s, -1, rows)
    plan = store.stream("p")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "SelectedBuckets" not in plan
    # Another writer is at work on version 1, and is lost.
    store._fs().create(store._claim("p", 1), False).close()
    with pytest.raises(events.ConcurrencyConflict):
        store.append("p", 0, rows)
    store.recover("p")
    assert store.append("p", 0, rows) == 1
    assert store.append("q", 0, rows.limit(0)) == 0 and store.append("q", 0, rows) == 1
    # A driver lost between writing a bucket anew and moving it leaves it ready; the next reader puts it in place.
    bucket = spark.range(1).select(store._bucket(F.lit("r"))).first()[0]
    kept = spark.read.schema(events.EVENTS_SQL).parquet(f"{store.path}/events/bucket={bucket}").where("stream_id <> 'r'")
    kept.write.parquet(f"{store.path}/ready/bucket={bucket}")
    assert {r.stream_id for r in store.events().collect()} == {"p", "q", "s"}


def test_numbers_by_ranges(spark):
    from loomtrace.functions.numbering import numbered

    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    out = numbered(df, [F.desc("x"), "id"], "place")
    assert out.where("place <> 1000 - x").count() == 0 and out.count() == 1000
    assert numbered(df.limit(0), ["id"], "place").count() == 0


def test_levels_are_not_cut_silently(spark):
    with pytest.raises(RuntimeError):
        statespace.explore(spark, Net().chain(4.0, "A", "t", "B"), max_levels=2)


def test_repository(spark, tmp_path):
    store = events.EventStore(spark, str(tmp_path / "store"))
    repo = events.Repository(store, lambda id: events.Aggregate(id, 0).on("add", lambda s, d: s + d["n"]))
    assert repo.execute("s", lambda s: [("add", {"n": 2}), ("note", {})], "2024-01-01").state == 2
    stale = repo.load("s")
    assert (stale.state, stale.version) == (2, 1)
    assert repo.execute("s", lambda s: [("add", {"n": s})], "2024-01-02").state == 4
    with pytest.raises(events.ConcurrencyConflict):
        repo.save(stale, [("add", {"n": 1})], "2024-01-03")


def test_remembered_states(spark):
    from loomtrace.plans import cache, trajectory

    e = cache.RememberedEvaluator(decay(), {"t": 0.1}, most=1)
    assert e.evaluate({"A": 5.0}, lambda s: s["A"]) == e.evaluate({"A": 5.0}, lambda s: s["A"])
    e.simulate({"A": 6.0})
    assert (e.memory.stats.hits, e.memory.stats.misses, e.memory.stats.size) == (1, 2, 1)
    rows = [(r, i, float(i), "A", float(v)) for r, vs in enumerate(([1, 3, 1, 1, 1], [1, 5, 1, 1, 2])) for i, v in enumerate(vs)]
    out = {r.measure: r.difference for r in trajectory.compare_runs(spark.createDataFrame(rows, "run_id long, step int, t double, place string, value double"), 0, 1).collect()}
    assert out["max_peak"] == 2.0 and out["drift"] == 1.0


def test_graphql(spark):
    net = Net().place("open", 1).place("closed").transition("close").flow("open", "close", "closed")
    held = []
    schema = "stream_id string, type string, version int"
    server = graphql.Server({"door": net}, lambda m: spark.createDataFrame(held, schema), lambda m, i, t, data: held.append((i, t, sum(1 for x in held if x[0] == i))), lambda: f"d{len(held)}")
    made = server.execute("mutation { x: door_create { id enabled } }")["data"]["x"]
    assert made == {"id": "d0", "enabled": ["close"]}
    done = server.execute("mutation M($i: ID!) { door_close(id: $i, input: {by: [1, true]}) { marking { closed } } }", {"i": "d0"})
    assert done["data"]["door_close"]["marking"]["closed"] == 1.0
    assert server.execute('{ door_nothing }')["errors"]
    page = server.execute('query { doorInstances(place: "closed", page: 1) { total items { id } } }')["data"]["doorInstances"]
    assert page == {"total": 1, "items": [{"id": "d0"}]}
    assert "doorInstance(id: ID!)" in graphql.schema(net, "door", "door")
    assert graphql.introspection(graphql.unified_schema({"door": net}))["__schema"]["types"]


def test_patterns_results_and_templates(spark, tmp_path):
    m = patterns.StateMachine("m", "a").move("go", "a", "b")
    m.fire("go")
    assert m.state == "b" and not m.can("go")
    assert patterns.EventSourced("s", 5, lambda x, e: x + e, 0).replay([1, 2]) == 3
    for name in templates.names():
        net, rates = templates.generate(name)
        assert set(rates) == set(net.transitions)
    net, rates = templates.generate("sir")
    path = ode.solve(net, net.state(), rates, (0, 10))
    doc = results.Builder().model(net, "sir").simulation(net.state(), rates, (0, 10)).solution(path, "tsit5", 0.1, 20).build()
    file = tmp_path / "r.json"
    file.write_text(results.to_json(doc))
    back = results.read(spark, str(file))
    assert back.first().results.summary.points == len(path.t)
    assert results.series(back.withColumn("run_id", F.lit(1).cast("long"))).count() == 60
