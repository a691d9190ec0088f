"""Logs from files, and the worked examples of miners and replay."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from loomtrace.operators import conformance, discovery, footprint, log, timing
from loomtrace.plans.net import Net, from_json, to_json
from loomtrace.sources.log import LogColumns, read_csv_log, read_jsonl_log


def make(spark, traces):
    rows = [(c, a, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i), "", "", None, i) for c, t in traces.items() for i, a in enumerate(t)]
    return spark.createDataFrame(rows, "case_id string, activity string, ts timestamp, resource string, lifecycle string, attributes map<string,struct<number:double,text:string>>, seq long")


def chain():
    return Net().place("start", 1).place("p1").place("p2").place("end").transition("t_a", label="A").transition("t_b", label="B").transition("t_c", label="C").flow("start", "t_a", "p1").flow("p1", "t_b", "p2").flow("p2", "t_c", "end")


@pytest.mark.parametrize(
    ("trace", "produced", "consumed", "missing", "remaining", "fitness"),
    [("ABC", 4, 3, 0, 0, 1.0), ("AC", 3, 2, 1, 1, 0.583333), ("ABDC", 4, 3, 1, 0, 0.833333)],
)
def test_replay(spark, trace, produced, consumed, missing, remaining, fitness):
    r = conformance.replay(make(spark, {"c": trace}), chain()).first()
    assert (r.produced, r.consumed, r.missing, r.remaining) == (produced, consumed, missing, remaining)
    assert r.fitness == pytest.approx(fitness, abs=1e-6)
    assert r.fitting == (fitness == 1.0)


def test_conformance_of_whole_and_empty_logs(spark):
    assert conformance.conformance(make(spark, {"c": "ABC"}), chain()).first().precision == 1.0
    empty = make(spark, {"c": "A"}).limit(0)
    assert conformance.fitness(empty, chain()).first().fitness == 1.0
    assert log.summary(empty).first().cases == 0


def test_relations_of_synthetic_logs(spark):
    sequential = make(spark, {f"c{i}": "ABC" for i in range(10)})
    pairs = footprint.footprint(footprint.directly_follows(sequential), log.activities(sequential))
    scores = {(r.a, r.b): r.score for r in discovery.dependency_matrix(pairs).collect()}
    assert scores["A", "B"] == pytest.approx(10 / 11)
    assert footprint.unrelated(pairs, ["A", "C"]) and not footprint.unrelated(pairs, ["A", "B"])
    assert footprint.causally_connected(pairs, ["A"], ["B"]) and not footprint.causally_connected(pairs, ["A"], ["B", "C"])
    parallel = make(spark, {f"c{i}": "ABCD" if i % 2 else "ACBD" for i in range(10)})
    places = {c.id for c in discovery.maximal(discovery.place_candidates(discovery.Relation(parallel)))}
    assert places == {"p_A_B", "p_A_C", "p_B_D", "p_C_D"}
    loops = make(spark, {f"c{i}": "A" + "B" * (i % 3 + 1) + "C" for i in range(10)})
    pairs = footprint.footprint(footprint.directly_follows(loops), log.activities(loops))
    assert {r.activity: r.score for r in discovery.loop_scores(pairs).collect()}["B"] == pytest.approx(0.9)
    assert "loop_B" in discovery.discover(loops, "heuristic").net.places
    with pytest.raises(ValueError):
        discovery.discover(loops, "other")


def test_hospital_log(spark, tmp_path):
    text = "case_id,Activity , timestamp,resource,cost\nP1,Register,2024-01-15 08:00:00,Ann,50.0\nP1,See,2024-01-15T08:15:30.5Z,,x\nP2,Register,2024-01-15,Bob,\n"
    path = tmp_path / "log.csv"
    path.write_text(text)
    rows = {(r.case_id, r.activity): r for r in read_csv_log(spark, str(path)).collect()}
    assert rows["P1", "Register"].attributes["cost"].number == 50.0
    assert rows["P1", "See"].attributes["cost"].text == "x" and rows["P1", "See"].resource == ""
    assert rows["P2", "Register"].attributes == {}
    path.write_text("skip this\ncase;activity;time\nC1;A;2024-01-01 00:00:00\n")
    again = read_csv_log(spark, str(path), LogColumns(case="case", ts="time", delimiter=";", skip_rows=1)).first()
    assert (again.case_id, again.activity, again.seq) == ("C1", "A", 2)


@pytest.mark.parametrize("line", [",A,2024-01-01", "c,,2024-01-01", "c,A,soon", "c,A", "c,A,2024-01-01,x,y"])
def test_bad_rows_fail(spark, tmp_path, line):
    path = tmp_path / "log.csv"
    path.write_text(f"case_id,activity,timestamp\n{line}\n")
    with pytest.raises(PySparkException):
        read_csv_log(spark, str(path)).collect()


def test_json_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"case_id": 42, "activity": "A", "timestamp": 1705305600, "cost": 2.5, "who": "x"}\n\n{"case_id": "c", "activity": "B", "timestamp": 1705305600000, "resource": "r"}\n{"case_id": "c", "activity": "C", "timestamp": "2024-01-15T08:00:00Z"}\n')
    rows = {r.activity: r for r in read_jsonl_log(spark, str(path)).collect()}
    assert rows["A"].case_id == "42" and rows["A"].ts == rows["B"].ts == rows["C"].ts - dt.timedelta(0)
    assert rows["A"].attributes["cost"].number == 2.5 and rows["A"].attributes["who"].text == "x"
    for bad in ("{", '{"case_id": "c", "activity": "A"}', '{"case_id": "", "activity": "A", "timestamp": 1}', '{"case_id": "c", "activity": "A", "timestamp": "soon"}'):
        path.write_text(bad + "\n")
        with pytest.raises(PySparkException):
            read_jsonl_log(spark, str(path)).collect()


def test_timing(spark):
    t = {r.activity: r for r in timing.activity_timing(make(spark, {"c": "AAB"})).collect()}
    assert (t["A"].mean_s, t["A"].std_s, t["A"].rate, t["B"].rate) == (600.0, 0.0, 1 / 600, 0.1)


def test_net_documents(spark):
    net = Net().sir(990, 10, 0).inhibitor("R", "infection", [1, 2])
    again = from_json(to_json(net))
    assert again == net
    assert from_json('{"places": {"A": {"initial": 3}}, "transitions": {"t": {}}, "arcs": [{"source": "A", "target": "t"}]}').state() == {"A": 3.0}
