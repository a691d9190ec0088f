"""More queries with SQL: files, nets, solvers, searches, state spaces, token schemas, workflows and streams.

What is computed on the driver is of the size of a model; SQL states the same by rule or closed form.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import guard, marking, statemap
from .operators import events, graphql, learn, log, statespace, timing, tokens, workflow
from .plans import cache, net as nets, ode, patterns, search, trajectory
from .plans.net import Net
from .queries import DAILY, GAPS, MAPS, SIGNALS, STORE, TALKS, USERS, daily, query, read, ring_net, signals, store, talk_log, talk_net, user_log, user_maps
from .sources import log as logs
from .sources import results, templates
from .sources.scratch import fresh_path
from .streaming import actors, monitor, statechart

#: Fixed steps, short enough for the digits that are compared.
ACCURATE = ode.Options(dt=0.05, adaptive=False)


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- Files -----------------------------------------------------------------------


@query("select user_id::varchar as case_id, event_type as activity, epoch_us(ts) as ts_us, 'u' || user_id % 3 as resource, round(value, 2) as amount from events")
def log_from_csv(spark, d):
    """Events written as a CSV file with a header, and read as a log."""
    path = fresh_path(spark, "csv")
    rows = read(spark, d, "events").select(F.col("user_id").alias("Case_ID"), F.col("event_type").alias("activity"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("resource"), F.round("value", 2).alias("amount"))
    rows.coalesce(1).write.option("header", True).csv(path)
    out = logs.read_csv_log(spark, path)
    return out.select("case_id", "activity", F.unix_micros("ts").alias("ts_us"), "resource", F.col("attributes")["amount"]["number"].alias("amount"))


@query("select user_id::varchar as case_id, event_type as activity, epoch_us(ts) // 1000 // (case when user_id % 2 = 0 then 1 else 1000 end) * (case when user_id % 2 = 0 then 1000 else 1000000 end) as ts_us, event_id as seq from events")
def log_from_jsonl(spark, d):
    """Events as JSON texts with numeric times, in milliseconds and in seconds."""
    e = read(spark, d, "events")
    at = F.col("ts").cast("timestamp")
    stamp = F.when(F.col("user_id") % 2 == 0, F.unix_millis(at)).otherwise(F.unix_seconds(at))
    lines = e.select(F.to_json(F.struct(F.col("user_id").alias("case_id"), F.col("event_type").alias("activity"), stamp.alias("timestamp"))).alias("value"), F.col("event_id").alias("seq"))
    return logs.jsonl_to_log(lines).select("case_id", "activity", F.unix_micros("ts").alias("ts_us"), "seq")


@query("select o_orderkey, case when o_orderkey % 5 < 4 then epoch_us(o_orderdate) + case o_orderkey % 5 when 1 then 3723000000 when 2 then 3723500000 else 0 end else -1 end as ts_us from orders")
def parsed_timestamps(spark, d):
    """Dates in several layouts, and texts that are none."""
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.date_format(day, "yyyy/MM/dd"), F.lit(" 01:02:03")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T01:02:03.500")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T02:00:00+02:00")))
        .otherwise(F.lit("soon"))
    )
    return read(spark, d, "orders").select("o_orderkey", F.coalesce(F.unix_micros(logs.parse_timestamp(text, logs.CSV_LAYOUTS)), F.lit(-1).cast("long")).alias("ts_us"))


@query("select 'a' as side, count(*)::bigint as events, count(distinct user_id)::bigint as cases from events where event_id % 2 = 0 union all select 'both', count(*), count(distinct user_id) from events")
def log_added(spark, d):
    lg = user_log(spark, d)
    even = lg.where("seq % 2 = 0")
    both = log.add_events(even, lg.where("seq % 2 = 1").drop("attributes"))
    return log.counts(even).withColumn("side", F.lit("a")).union(log.counts(both).withColumn("side", F.lit("both"))).select("side", "events", "cases")


# --- Nets -----------------------------------------------------------------------


def area_net(spark: SparkSession, d: str) -> Net:
    """Regions as places with a token for each nation, nations as transitions that take from their region."""
    out = Net()
    regions = {r.r_regionkey: r.r_name.replace(" ", "_") for r in read(spark, d, "region").collect()}
    nations = read(spark, d, "nation").orderBy("n_nationkey").collect()
    for k, name in sorted(regions.items()):
        out.place(name, float(sum(n.n_regionkey == k for n in nations)))
    for n in nations:
        out.transition(n.n_name).arc(regions[n.n_regionkey], n.n_name, float(n.n_nationkey % 3 + 1))
    return out


AREA = "area as (select replace(r_name, ' ', '_') as r_name, n_name, n_nationkey, n_regionkey from region join nation on n_regionkey = r_regionkey)"


@query(f"with {AREA} select 'place' as kind, r_name as id, count(*)::double as amount from area group by r_name union all select 'transition', n_name, 0 from area union all select 'arc', r_name || '->' || n_name, n_nationkey % 3 + 1 from area")
def net_roundtrip(spark, d):
    """A net as JSON, read again, as DataFrames and back."""
    net = nets.from_frames(*nets.from_json(nets.to_json(area_net(spark, d))).frames(spark))
    rows = [("place", p.id, p.tokens) for p in net.places.values()] + [("transition", t, 0.0) for t in net.transitions]
    rows += [("arc", f"{a.source}->{a.target}", a.total) for t in net.transitions for a in net.inputs(t)]
    return table(spark, rows, "kind string, id string, amount double")


@query(f"with {AREA} select 'state' as kind, r_name as id, case r_name when 'ASIA' then 7.5 else count(*) end::double as amount from area group by r_name union all select 'rate', n_name, case n_nationkey when 3 then 0.25 else 1.0 end from area union all select 'floats', k, v from (values ('number', 2.0), ('list', 3.0), ('text', 0.0), ('flag', 0.0)) t(k, v)")
def net_state_and_rates(spark, d):
    net = area_net(spark, d)
    rows = [("state", p, n) for p, n in net.state({"ASIA": 7.5, "nowhere": 1.0}).items()]
    rows += [("rate", t, r) for t, r in net.rates({"NATION_3": 0.25, "none": 9.0}).items()]
    rows += [("floats", k, float(sum(nets.floats(v)))) for k, v in {"number": 2, "list": [1, 2.0], "text": "5", "flag": True}.items()]
    return table(spark, rows, "kind string, id string, amount double")


@query("""with recursive r as (select 0 as step, 100.0::double as a union all select step + 1, a + 0.01 * (-0.1 * a) from r where step < 1000)
select (step // 10)::int as step, round(a, 6)::double as value, 1001::int as points, 'A' as places, 0.1::double as rate from r where step % 10 = 0""")
def results_document(spark, d):
    """A results document with a series cut to 101 steps, written and read again."""
    net = Net().place("A", 100.0).transition("t").arc("A", "t")
    run = (0.0, 10.0 - 1e-9)
    path = ode.solve(net, net.state(), {"t": 0.1}, run, "euler", ode.Options(dt=0.01, adaptive=False))
    doc = results.Builder().model(net, "decay").simulation(net.state(), {"t": 0.1}, run).solution(path, "euler", 0.0, 101).build()
    where = fresh_path(spark, "results")
    results.write(spark, [results.from_json(results.to_json(doc))], where)
    back = results.read(spark, where).withColumn("run_id", F.lit(0).cast("long"))
    head = back.select("run_id", F.col("results.summary.points").alias("points"), F.array_join("model.places", ",").alias("places"), F.col("simulation.rates")["t"].alias("rate"))
    return results.series(back).join(head, "run_id").select("step", F.round("value", 6).alias("value"), "points", "places", "rate")


# --- GraphQL -----------------------------------------------------------------------


def shop_net() -> Net:
    net = Net().place("seen").place("clicked").place("bought").transition("view").transition("click").transition("purchase")
    return net.arc("view", "seen").flow("seen", "click", "clicked").flow("clicked", "purchase", "bought")


SHOP = STORE + ", items as (select stream_id as id, max(version) as version, count(*) filter (where type = 'view') - count(*) filter (where type = 'click') as seen, count(*) filter (where type = 'click') - count(*) filter (where type = 'purchase') as clicked, count(*) filter (where type = 'purchase') as bought from st group by stream_id)"
ENABLED = "(case when clicked >= 1 and seen >= 1 then 'click,purchase,view' when seen >= 1 then 'click,view' when clicked >= 1 then 'purchase,view' else 'view' end)"
ITEM_SQL = "id string, version int, seen double, clicked double, bought double, enabled string"


def _server(spark: SparkSession, d: str, held: list[tuple]) -> graphql.Server:
    base = store(spark, d).select("stream_id", "type", "version")

    def load(model: str) -> DataFrame:
        return base.union(table(spark, held, "stream_id string, type string, version int")) if held else base

    def append(model: str, id: str, type: str, data: object) -> None:
        last = load(model).where(F.col("stream_id") == id).agg(F.coalesce(F.max("version"), F.lit(-1)).alias("v")).first().v
        held.append((id, type, last + 1))

    return graphql.Server({"item": shop_net()}, load, append, lambda: f"new{len(held)}")


def _item(i: dict) -> tuple:
    m = i["marking"]
    return i["id"], i["version"], m["seen"], m["clicked"], m["bought"], ",".join(i["enabled"])


@query(f"with {SHOP} select id, version, seen::double as seen, clicked::double as clicked, bought::double as bought, {ENABLED} as enabled, (select count(*) from items where bought > 0)::bigint as total from items where bought > 0 order by id limit 5 offset 5")
def graphql_page(spark, d):
    """The second page of a list query with a variable."""
    text = 'query Q($n: Int!) { p: itemInstances(place: "bought", page: 2, perPage: $n) { total items { id version marking { seen clicked bought } enabled } } }'
    page = _server(spark, d, []).execute(text, {"n": 5})["data"]["p"]
    return table(spark, [(*_item(i), page["total"]) for i in page["items"]], f"{ITEM_SQL}, total long")


@query(f"""with {SHOP}, after as (select id, version + 1 as version, seen + 1 as seen, clicked, bought from items where id = '7' union all select 'new1', 1, 1, 0, 0)
select id, version, seen::double as seen, clicked::double as clicked, bought::double as bought, {ENABLED} as enabled from after""")
def graphql_mutations(spark, d):
    """An instance that is there is moved on; one is made and moved on."""
    server = _server(spark, d, [])
    fields = "{ id version marking { seen clicked bought } enabled }"
    one = server.execute(f'mutation {{ item_view(id: "7") {fields} }}')["data"]["item_view"]
    server.execute("mutation { item_create { id } }")
    two = server.execute(f'mutation {{ item_view(id: "new1") {fields} }}')["data"]["item_view"]
    return table(spark, [_item(one), _item(two)], ITEM_SQL)


@query("""select 'AreaMarking' as type, replace(r_name, ' ', '_') as field, 'Float!' as kind from region union all
select * from (values ('AreaInstance', 'id', 'ID!'), ('AreaInstance', 'version', 'Int!'), ('AreaInstance', 'marking', 'AreaMarking!'), ('AreaInstance', 'enabled', '[String!]!'),
('AreaPage', 'items', '[AreaInstance!]!'), ('AreaPage', 'total', 'Int!'), ('AreaPage', 'page', 'Int!'), ('AreaPage', 'perPage', 'Int!'), ('Query', 'areaInstance', 'AreaInstance'), ('Query', 'areaInstances', 'AreaPage!'), ('Mutation', 'area_create', 'AreaInstance!')) t
union all select 'Mutation', 'area_' || n_name, 'AreaInstance!' from nation""")
def graphql_schema(spark, d):
    found = graphql.introspection(graphql.unified_schema({"area": area_net(spark, d)}))["__schema"]["types"]
    return table(spark, [(t["name"], f["name"], f["type"]) for t in found for f in t["fields"]], "type string, field string, kind string")


# --- State maps and memories -----------------------------------------------------------


@query(f"""with {MAPS}, t as (select user_id, coalesce(sum(x), 0) as total, count(x) filter (where starts_with(k, 's')) as kept, coalesce(string_agg(k, ',' order by k) filter (where x is not null), '') as keys, arg_min(k, struct_pack(x := x, k := k)) filter (where x is not null) as smallest,
    coalesce(bool_and(x is not null and y is not null and abs(x - y) <= 100) filter (where x is not null or y is not null), true) as alike from m group by user_id)
select user_id, round(2 * total, 2)::double as doubled, kept::bigint as kept, keys, coalesce(smallest, '') as smallest, alike from t""")
def state_algebra(spark, d):
    m = user_maps(spark, d)
    return m.select(
        "user_id",
        F.round(statemap.total(statemap.scale("a", 2.0)), 2).alias("doubled"),
        F.size(statemap.keep("a", lambda k: k.startswith("s"))).cast("long").alias("kept"),
        F.array_join(statemap.keys("a"), ",").alias("keys"),
        F.coalesce(statemap.smallest("a").key, F.lit("")).alias("smallest"),
        statemap.equal("a", "b", 100.0).alias("alike"),
    )


@query("with c as (select user_id, event_type, count(*)::double as n from events group by all) select user_id, sha256(string_agg(event_type || '=' || n, chr(10) order by event_type)) as digest from c group by user_id")
def state_digests(spark, d):
    c = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    maps = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", statemap.digest("m").alias("digest"))


@query("""select n_nationkey::int as n, (row_number() over (partition by n_regionkey order by n_nationkey) > 1) as remembered, true as near from nation""")
def state_memory(spark, d):
    """States of nations by region, each simulated once."""
    net = Net().place("A", 0.0).transition("t").arc("A", "t")
    e = cache.RememberedEvaluator(net, {"t": 0.1}, options=ACCURATE)
    rows = []
    for r in read(spark, d, "nation").orderBy("n_nationkey").collect():
        hits = e.memory.stats.hits
        value = e.evaluate({"A": r.n_regionkey + 1.0}, lambda s: s["A"])
        rows.append((r.n_nationkey, e.memory.stats.hits > hits, bool(abs(value - (r.n_regionkey + 1) * np.exp(-0.5)) < 1e-3)))
    return table(spark, rows, "n int, remembered boolean, near boolean")


# --- Solvers -----------------------------------------------------------------------


def decay_net() -> Net:
    return Net().place("A", 100.0).transition("t").arc("A", "t")


@query("select method, round(100 * power(list_sum(list_transform(range(degree + 1), lambda i: power(-0.05::double, i) / factorial(i::int))), 20), 4)::double as value from (values ('bs32', 3), ('euler', 1), ('heun', 2), ('midpoint', 2), ('rk4', 4), ('rk45', 5), ('tsit5', 5)) t(method, degree)")
def solvers_decay(spark, d):
    """Twenty fixed steps of each method: on a decay each multiplies by its polynomial."""
    options = ode.Options(dt=0.1, adaptive=False)
    rows = [(m, round(ode.solve(decay_net(), {"A": 100.0}, {"t": 0.5}, (0, 2 - 1e-9), m, options).final["A"], 4)) for m in sorted(ode.METHODS)]
    return table(spark, rows, "method string, value double")


@query("""with c as (select 2 - sqrt(2.0::double) as g, -0.05::double as z)
select 'implicit_euler' as method, round(100 * power(1 / (1 - z), 20), 3)::double as value from c union all
select 'trbdf2', round(100 * power((1 / (g * (2 - g)) * (1 + 0.5 * g * z) / (1 - 0.5 * g * z) - (1 - g) * (1 - g) / (g * (2 - g))) / (1 - (1 - g) / (2 - g) * z), 20), 3) from c""")
def solvers_implicit(spark, d):
    options = ode.Options(dt=0.1, abstol=1e-12, adaptive=False)
    rows = [(m, round(ode.solve_implicit(decay_net(), {"A": 100.0}, {"t": 0.5}, (0, 2 - 1e-9), m, options).final["A"], 3)) for m in ("implicit_euler", "trbdf2")]
    return table(spark, rows, "method string, value double")


@query("select preset, true as reached, 0.0::double as a, 100.0::double as b, false as stiff, true as stiff_with_fast from (values ('default'), ('fast')) t(preset)")
def equilibria(spark, d):
    """A chain at rest: all has moved on. One fast and one slow transition make it stiff."""
    net = Net().chain(100.0, "A", "t", "B")
    stiff = Net().place("A", 1.0).place("B", 1.0).transition("t").transition("u").arc("A", "t").arc("B", "u")
    rows = []
    for preset in ("default", "fast"):
        state, reached = ode.find_rest(net, net.state(), {"t": 1.0}, (0.0, 60.0), preset)
        rows.append((preset, reached, abs(round(state["A"], 1)), round(state["B"], 1), ode.is_stiff(net, net.state(), {"t": 1.0}), ode.is_stiff(stiff, stiff.state(), {"t": 1.0, "u": 5000.0})))
    return table(spark, rows, "preset string, reached boolean, a double, b double, stiff boolean, stiff_with_fast boolean")


# --- Searches on nets with a closed form -------------------------------------------------


FORK = "f as (select k1, k2, 100 * k1 / (k1 + k2) * (1 - exp(-(k1 + k2) * 10)) as b from {0})"


def fork_net() -> Net:
    return Net().place("A", 100.0).place("B").place("C").transition("left").transition("right").flow("A", "left", "B").flow("A", "right", "C")


def _fork(spark: SparkSession) -> search.Sensitivity:
    return search.Sensitivity(spark, fork_net(), search.place_scorer("B"), rates={"left": 0.1, "right": 0.3}, tspan=(0.0, 10.0), options=ACCURATE)


@query("with r as (select 0.05::double + 0.05 * k as k, k as run from range(4) t(k)), v as (select run, 100 * exp(-k * 10) as a from r) select run::bigint as run_id, 'B' as scorer, round(100 - a, 2)::double as score from v union all select run, 'A-B', round(a - (100 - a), 2) from v union all select run, 'sum', 100.0 from v")
def scorers_decay(spark, d):
    net = Net().chain(100.0, "A", "t", "B")
    runs = table(spark, [(i, {}, {"t": 0.05 + 0.05 * i}, 0.0, 10.0) for i in range(4)], search.RUNS_SQL)
    scorers = {"B": search.place_scorer("B"), "A-B": search.difference_scorer("A", "B"), "sum": search.final_scorer(lambda s: s["A"] + s["B"])}
    out = [search.score_runs(runs, net, f, ACCURATE).select("run_id", F.lit(name).alias("scorer"), F.round("score", 2).alias("score")) for name, f in scorers.items()]
    return out[0].union(out[1]).union(out[2])


@query(f"with r as (select * from (values ('left', 0.0::double, 0.3::double), ('right', 0.1, 0.0)) t(transition, k1, k2)), {FORK.format('r')}, base as (select 25 * (1 - exp(-4.0::double)) as b) select transition, round(f.b, 2)::double as score, round(f.b - base.b, 2)::double as impact, (row_number() over (order by abs(f.b - base.b) desc))::int as rank from r join f using (k1, k2), base")
def knockouts_fork(spark, d):
    return _fork(spark).knockouts().select("transition", F.round("score", 2).alias("score"), F.round("impact", 2).alias("impact"), "rank")


@query(f"with r as (select 0.1::double * (k + 1) as k1, 0.3::double as k2 from range(5) t(k)), {FORK.format('r')} select round(k1, 6)::double as rate, round(b, 2)::double as score, b = max(b) over () as best, b = min(b) over () as worst from f")
def rate_sweep_fork(spark, d):
    return _fork(spark).sweep("left", [0.1 * (k + 1) for k in range(5)]).select(F.round("rate", 6).alias("rate"), F.round("score", 2).alias("score"), "best", "worst")


@query("""with f as (select t, k, 100 * a / (a + b) * (1 - exp(-(a + b) * 10)) as b from (values ('left', 1, 0.11::double, 0.3::double), ('left', -1, 0.09, 0.3), ('right', 1, 0.1, 0.31), ('right', -1, 0.1, 0.29)) t(t, k, a, b))
select t as transition, round(sum(k * b) / 0.02, 1)::double as gradient from f group by t""")
def gradients_fork(spark, d):
    return _fork(spark).gradients(0.01).select("transition", F.round("gradient", 1).alias("gradient"))


@query(f"with r as (select k as c, [0.1, 0.2, 0.4][k % 3 + 1]::double as k1, [0.1, 0.5][k // 3 + 1]::double as k2 from range(6) t(k)), {FORK.format('r')} select c::bigint as combination, k1 as left_rate, k2 as right_rate, round(b, 2)::double as score, (row_number() over (order by b desc, c))::int as rank from r join f using (k1, k2)")
def rate_grid_fork(spark, d):
    out = _fork(spark).grid({"left": [0.1, 0.2, 0.4], "right": [0.1, 0.5]})
    return out.select("combination", F.col("parameters.left").alias("left_rate"), F.col("parameters.right").alias("right_rate"), F.round("score", 2).alias("score"), "rank")


@query("""with u as (select * from (values ('many', 0, 50.0::double), ('many', 1, 100.0), ('many', 2, 200.0)) t(kind, i, a))
select kind, i::int as i, case when a > 150 then -1.0 else round(a * (1 - exp(-0.5::double)), 2) end::double as score from u
union all select 'best', 1, round(100 * (1 - exp(-0.5::double)), 2) union all select 'compare', 0, -1.0 union all select 'knockout', 0, 0.0""")
def hypotheses_decay(spark, d):
    net = Net().chain(100.0, "A", "t", "B")
    h = search.Hypotheses(spark, net, {"t": 0.1}, search.place_scorer("B"), options=ACCURATE, infeasible=lambda s: s["A"] > 150, infeasible_score=-1.0)
    updates = [{"A": 50.0}, {"A": 100.0}, {"A": 200.0}]
    many = h.evaluate_many(net.state(), updates).select(F.lit("many").alias("kind"), F.col("index").cast("int").alias("i"), F.round("score", 2).alias("score"))
    at, best = h.best(net.state(), updates)
    rows = [("best", at, round(best, 2)), ("compare", 0, float(h.compare({"A": 50.0}, {"A": 100.0}))), ("knockout", 0, round(h.knockouts(net.state())["t"][0], 2))]
    return many.union(table(spark, rows, "kind string, i int, score double"))


@query("with r as (select k as run, 0.05::double + 0.05 * k as rate from range(4) t(k)) select run::bigint as run_id, round(rate, 6)::double as rate, round(100 * exp(-10 * rate), 2)::double as score, (row_number() over (order by rate desc))::int as rank, 'increase by 300.0% (0.050000 → 0.200000)' as advice from r")
def sweep_decay(spark, d):
    """A sweep from its text, ranked, and what it recommends."""
    grid = search.parse_sweep("t=0.05:0.2:4")
    ranked = search.sweep(spark, decay_net(), grid, {}, "minimize_final", 10.0, options=ACCURATE)
    advice = search.recommendations(ranked)["t"]
    return ranked.select("run_id", F.round(F.col("parameters")["r:t"], 6).alias("rate"), F.round("score", 2).alias("score"), "rank", F.lit(advice).alias("advice"))


# --- Series -----------------------------------------------------------------------


def _two_runs(spark: SparkSession, d: str) -> DataFrame:
    s = daily(spark, d)
    return s.unionByName(s.withColumn("run_id", F.lit(1).cast("long")).withColumn("value", F.col("value") * 2 + F.when(F.col("place") == "click", 5.0).otherwise(0.0)))


@query(f"with {DAILY}, e as (select place, arg_max(value, step) as base, arg_max(value * 2 + case place when 'click' then 5 else 0 end, step) as variant from s group by place) select place, base::double as base, variant::double as variant, (variant - base)::double as difference, case when base <> 0 then round((variant - base) / base * 100, 6) end::double as percent from e")
def final_states_compared(spark, d):
    both = _two_runs(spark, d)
    out = trajectory.compare(both.where("run_id = 0"), both.where("run_id = 1"))
    return out.withColumn("percent", F.round("percent", 6))


@query(f"""with {DAILY}, r as (select 0 as run, step, place, value from s union all select 1, step, place, value * 2 + case place when 'click' then 5 else 0 end from s),
w as (select *, lag(value) over o as p, lead(value) over o as n from r window o as (partition by run, place order by step)),
pk as (select run, arg_max(struct_pack(v := value, t := step), struct_pack(v := value, t := -step)) as best from w where value > p and value > n and value > 0 group by run),
e as (select run, place, arg_min(value, step) as a, arg_max(value, step) as b from r group by run, place), dr as (select run, sum(b) - sum(a) as drift from e group by run),
m as (select 'max_peak' as measure, run, best.v::double as x from pk union all select 'max_peak_t', run, best.t from pk union all select 'drift', run, drift from dr)
select measure, max(x) filter (where run = 0) as base, max(x) filter (where run = 1) as variant, max(x) filter (where run = 1) - max(x) filter (where run = 0) as difference from m group by measure""")
def runs_compared(spark, d):
    return trajectory.compare_runs(_two_runs(spark, d), 0, 1).where("measure <> 'steady_t'")


@query(f"""with {DAILY}, w as (select *, lag(value) over (partition by place order by step) as p, lead(value) over (partition by place order by step) as n from s),
x as (select a.step, a.place || '/' || b.place as name, a.value - b.value as d from s a join s b on a.step = b.step and a.place < b.place), y as (select *, lead(d) over (partition by name order by step) as d2, lead(step) over (partition by name order by step) as t2 from x)
select step::double as t, case when value > p then 'peak' else 'trough' end as kind, place as name from w where value > p and value > n or value < p and value < n
union all select round(step + (t2 - step) * (-d) / (d2 - d), 6), 'crossing', name from y where d * d2 < 0""")
def series_events(spark, d):
    s = daily(spark, d)
    turns = trajectory.extrema(s).select("t", "kind", F.col("place").alias("name"))
    return turns.union(trajectory.crossings(s).select(F.round("t", 6).alias("t"), F.lit("crossing").alias("kind"), F.concat_ws("/", "var1", "var2").alias("name")))


@query(f"""with {DAILY}, c as (select place, step, abs((value - lag(value) over o) / nullif(lag(value) over o, 0)) as ch from s window o as (partition by place order by step)), n as (select max(step) + 1 as n, max(step) as last from s),
k as (select greatest(2, least(10, n // 2))::int as w from n), m as (select c.place, c.step, (select max(x.ch) from c x, k where x.place = c.place and x.step > c.step - w and x.step <= c.step) as most from c),
f as (select place, min(step) filter (where step >= (select w from k) and coalesce(most, 0) < 0.01) as t from m group by place), e as (select place, arg_min(value, step) as a, arg_max(value, step) as b from s group by place)
select (select bool_and(t is not null) from f) as steady, (select abs(sum(b) - sum(a)) < 1e-6 from e) as conserved, case when (select bool_and(t is not null) from f) then (select least(min(t), max((select last from n))) from f) end::double as steady_t""")
def series_report(spark, d):
    return trajectory.metrics(daily(spark, d)).select("steady", "conserved", "steady_t")


# --- State spaces ---------------------------------------------------------------------


RING_SQL = """r(a, b, c) as (select 4, 0, 0 union select * from (select a - 1, b + 1, c from r where a >= 1 union all select a, b - 1, c + 1 from r where b >= 1 union all select a + 1, b, c - 1 from r where c >= 1)),
d(a, b, c, depth) as (select 4, 0, 0, 0 union select * from (select a - 1, b + 1, c, depth + 1 from d where a >= 1 and depth < 12 union all select a, b - 1, c + 1, depth + 1 from d where b >= 1 and depth < 12 union all select a + 1, b, c - 1, depth + 1 from d where c >= 1 and depth < 12)),
h as (select a, b, c, min(depth) as depth from d group by all)"""


@query(f"""with recursive {RING_SQL} select a::bigint as a, b::bigint as b, c::bigint as c, (a + b + c)::bigint as total, a >= 1 and b >= 1 and c >= 1 as covers, a >= 1 and b >= 1 and c >= 1 and not (a = 1 and b = 1 and c = 1) as strictly,
(a - 1) || ',' || (b - 1) || ',' || (c - 1) as difference, concat_ws(',', case when a > 0 then 'A' end, case when b > 0 then 'B' end, case when c > 0 then 'C' end) as held, substr(sha256(a || ',' || b || ',' || c), 1, 16) as digest from r""")
def marking_algebra(spark, d):
    m = statespace.explore(spark, ring_net()).select(F.slice("marking", 1, 3).alias("m"))
    one = F.array(*[F.lit(1).cast("long")] * 3)
    return m.select(
        *[F.get("m", i).alias(n) for i, n in enumerate("abc")],
        marking.total(F.col("m")).alias("total"),
        marking.covers(F.col("m"), one).alias("covers"),
        marking.strictly_covers(F.col("m"), one).alias("strictly"),
        F.array_join(marking.difference(F.col("m"), one).cast("array<string>"), ",").alias("difference"),
        F.array_join(F.filter(F.array(*[F.when(F.get("m", i) > 0, F.lit(n)) for i, n in enumerate("ABC")]), lambda x: x.isNotNull()), ",").alias("held"),
        marking.digest(F.col("m")).alias("digest"),
    )


@query(f"""with recursive {RING_SQL} select 'states' as measure, count(*)::bigint as value from r union all select 'edges', sum((a > 0)::int + (b > 0)::int + (c > 0)::int)::bigint from r union all select 'max_A', max(a) from r union all select 'max_C', max(c) from r
union all select 'depth', max(depth) from h union all select 'terminal', count(*) filter (where a + b + c = 0) from r union all select 'deadlocks', 0 union all select 'live', 1 union all select 'bounded', 1 union all select 'cycle', 1 union all select 'dead', 0""")
def state_space_ring(spark, d):
    f = statespace.StateSpace(ring_net()).findings()
    rows = {"states": f.states, "edges": f.edges, "max_A": f.max_tokens["A"], "max_C": f.max_tokens["C"], "depth": f.max_depth, "terminal": len(f.terminal), "deadlocks": len(f.deadlocks), "live": int(f.live), "bounded": int(f.bounded), "cycle": int(f.has_cycle), "dead": len(f.dead)}
    return table(spark, list(rows.items()), "measure string, value long")


@query(f"with recursive {RING_SQL} select a::bigint as a, b::bigint as b, c::bigint as c, depth::int as depth, depth::int as steps, true as reached, true as runs from h")
def paths_ring(spark, d):
    """Every marking with the shortest sequence that leads to it, which can be fired."""
    space = statespace.StateSpace(ring_net())
    rows = []
    for m, depth in space.depth.items():
        named = space.named(m)
        path = space.path_to(named)
        rows.append((named["A"], named["B"], named["C"], depth, len(path), space.reaches(named), space.run(path) == (True, named)))
    return table(spark, rows, "a long, b long, c long, depth int, steps int, reached boolean, runs boolean")


@query("select * from (values ('ring', 'ca', true, 3), ('ring', 'ab', true, 1), ('locked', 'finish', false, 0), ('locked', 'begin', true, 1)) t(net, transition, can, steps)")
def firing_sequences(spark, d):
    locked = Net().place("start", 1).place("working").place("resource", 1).place("done").transition("begin").transition("finish")
    locked.flow("start", "begin", "working").arc("resource", "begin").arc("begin", "resource").arc("working", "finish").arc("resource", "finish", 2).arc("finish", "done")
    rows = []
    for name, net, ts in (("ring", ring_net(), ("ca", "ab")), ("locked", locked, ("finish", "begin"))):
        for t in ts:
            can, path = statespace.StateSpace(net).can_fire(t)
            rows.append((name, t, can, len(path)))
    return table(spark, rows, "net string, transition string, can boolean, steps int")


@query("select * from (values ('sir', 'I+R+S', 1000.0, true, true), ('producer-consumer', 'Buffer+Free', 10.0, false, false), ('workflow', 'after_1+after_2+end+start', 1.0, true, true)) t(net, invariant, value, conserves, bounded)")
def net_invariants(spark, d):
    """Invariants over places, each checked in the first marking."""
    rows = []
    for name in ("sir", "producer-consumer", "workflow"):
        net, _ = templates.generate(name)
        for coefficients, value in statespace.place_invariants(net):
            assert statespace.holds(coefficients, value, net.state())
            rows.append((name, "+".join(sorted(coefficients)), value, statespace.conserves(net), statespace.structurally_bounded(net)))
    return table(spark, rows, "net string, invariant string, value double, conserves boolean, bounded boolean")


@query("select * from (values ('sir', 'I,R,S', true), ('queue', 'Done,InService,Queue,Servers', false), ('workflow', 'after_1,after_2,end,start', true)) t(net, places, conserved)")
def conservation_candidates(spark, d):
    rows = []
    for name in ("sir", "queue", "workflow"):
        net, _ = templates.generate(name)
        rows += [(name, ",".join(g), statespace.verify_group(net, g)) for g in statespace.conservation_groups(net)]
    return table(spark, rows, "net string, places string, conserved boolean")


@query("select r_name as node, round(1 / sqrt(5), 6)::double as score, 5.0::double as eigenvalue from region")
def centrality_regions(spark, d):
    """Regions that share all of five limits are equally central; the greatest eigenvalue is their number times five, here cut to one limit."""
    names = sorted(r.r_name for r in read(spark, d, "region").collect())
    c = statespace.entity_centrality(names, [list(range(len(names)))])
    return table(spark, [(n, round(s, 6), round(c.eigenvalue, 6)) for n, s in c.scores.items()], "node string, score double, eigenvalue double")


@query("select * from (values ('full', 'error', 'structure', 'more tokens than capacity'), ('full', 'warning', 'deadlock', 'deadlock is reachable'), ('grows', 'warning', 'boundedness', 'tokens grow beyond the limit'), ('bare', 'error', 'structure', 'the net has no places'), ('bare', 'warning', 'structure', 'the net has no transitions'), ('alone', 'warning', 'connectivity', 'place is not connected'), ('alone', 'warning', 'liveness', 'never fires')) t(net, severity, category, message)")
def validation_findings(spark, d):
    """Errors and warnings of nets that have one fault each, with their state spaces."""
    full = Net().place("P", 3.0, 2.0).place("Q").transition("t").flow("P", "t", "Q", 5.0)
    grows = Net().place("A", 1.0).transition("t").arc("A", "t").arc("t", "A", 2.0)
    alone = Net().place("A", 1.0).place("B").place("far").transition("t").transition("u").flow("A", "t", "B").arc("B", "t").flow("B", "u", "A")
    wanted = {"full": {"structure", "deadlock"}, "grows": {"boundedness"}, "bare": {"structure"}, "alone": {"connectivity", "liveness"}}
    rows = set()
    for name, net in (("full", full), ("grows", grows), ("bare", Net()), ("alone", alone)):
        found = statespace.validate_with_states(net, 3000) if net.places else statespace.validate(net)
        rows |= {(name, s, c, m) for s, c, e, m in found if s in ("error", "warning") and c in wanted[name] and "no capacity" not in m and (name, e) not in (("alone", "u"),)}
    return table(spark, sorted(rows), "net string, severity string, category string, message string")


# --- Guards and token schemas -----------------------------------------------------------


@query(f"""with {MAPS}, t as (select user_id, coalesce(sum(x), 0) as total, coalesce(greatest(max(x) filter (where starts_with(k, 's')), 0), 0) as most, count(*) filter (where starts_with(k, 'c') and x > 0) as places, coalesce(max(x) filter (where k = 'click'), 0) as clicks, coalesce(min(x) filter (where starts_with(k, 'p')), 0) as least from m group by user_id)
select user_id, total >= most and places <= 1 as bounded, clicks < 200 or least > 10 as calm from t""")
def guard_invariants(spark, d):
    m = user_maps(spark, d)
    bounded = guard.to_column("sum('') >= max('s') && count('c') <= 1", marking=F.col("a"))
    calm = guard.to_column("tokens('click') < 200 || min('p') > 10", marking=F.col("a"))
    return m.select("user_id", bounded.alias("bounded"), calm.alias("calm"))


@query("select n_nationkey::int as n, n_regionkey * 3 - n_nationkey / 4 > 1 as ok, n_nationkey % 5 = n_regionkey and n_regionkey >= 0 as holds from (select n_nationkey, n_regionkey, n_nationkey from nation)".replace("n_nationkey / 4", "n_nationkey // 4"))
def guards_on_driver(spark, d):
    """Guards and invariants evaluated one by one."""
    rows = []
    for r in read(spark, d, "nation").collect():
        b = {"key": r.n_nationkey, "area": {"id": r.n_regionkey}}
        rows.append((r.n_nationkey, guard.evaluate("area['id'] * 3 - key / 4 > 1", b), guard.holds("key % 5 == area && area >= 0", {"key": r.n_nationkey, "area": r.n_regionkey})))
    return table(spark, rows, "n int, ok boolean, holds boolean")


@query("with m as (select o_custkey as key, o_totalprice as amount from orders union all select s_suppkey, -s_acctbal from supplier) select 'wallet' as state, key::varchar as key, round(sum(amount), 2)::double as amount from m group by key")
def token_balances(spark, d):
    paid = read(spark, d, "orders").select(F.lit("wallet").alias("state"), F.col("o_custkey").cast("string").alias("key"), F.col("o_totalprice").alias("amount"))
    owed = read(spark, d, "supplier").select(F.lit("wallet").alias("state"), F.col("s_suppkey").cast("string").alias("key"), (-F.col("s_acctbal")).alias("amount"))
    return tokens.balances(paid.union(owed)).withColumn("amount", F.round("amount", 2))


def coin() -> tokens.Schema:
    s = tokens.Schema("coin").token("ready", 25).token("spent").data("balances", "map[address]uint256", exported=True)
    s.action("mint").action("transfer", "balances[from] >= amount")
    s.arc("ready", "mint").arc("mint", "spent").arc("mint", "balances", ["to"], "amount").arc("balances", "transfer", ["from"]).arc("transfer", "balances", ["to"])
    return s.constraint("all", "ready + spent == 25")


@query("""with t as (select n_regionkey, sum(n_nationkey)::bigint as got from nation group by 1), ok as (select got >= 30 as ok from t where n_regionkey = 0)
select 'balance' as kind, n_regionkey::varchar as key, (got + case when (select ok from ok) then case n_regionkey when 0 then -30 when 1 then 30 else 0 end else 0 end)::bigint as amount from t
union all select 'token', 'ready', 0 union all select 'token', 'spent', 25 union all select 'refused', '4', 1 union all select 'enabled', 'transfer', 1 union all select 'violations', '', 0""")
def token_runtime(spark, d):
    """A coin is minted for each nation into its region's balance; one transfer is made and one refused."""
    r = tokens.Runtime(coin())
    for n in read(spark, d, "nation").orderBy("n_nationkey").collect():
        broken = r.execute("mint", {"to": str(n.n_regionkey), "amount": n.n_nationkey})
    r.execute("transfer", {"from": "0", "to": "1", "amount": 30})
    try:
        r.execute("transfer", {"from": "4", "to": "0", "amount": 10**6})
        refused = 0
    except tokens.NotEnabled:
        refused = 1
    held = r.snapshot()
    rows = [("balance", k, int(n)) for k, n in held["data"]["balances"].items()] + [("token", k, n) for k, n in held["tokens"].items()]
    rows += [("refused", "4", refused), *(("enabled", a, 1) for a in r.enabled_actions()), ("violations", "", len(broken))]
    return table(spark, rows, "kind string, key string, amount long")


@query("select k::int as spent, k <= 3 as reached from range(6) t(k)")
def token_reach(spark, d):
    s = tokens.Schema("s").token("ready", 3).token("spent").action("use").arc("ready", "use").arc("use", "spent")
    return table(spark, [(k, tokens.Runtime(s).can_reach({"spent": k}, 50)) for k in range(6)], "spent int, reached boolean")


@query("select * from (values ('read again', true, true), ('other version', false, true), ('other guard', false, false)) t(kind, same_id, same_structure)")
def schema_identity(spark, d):
    s = coin()
    again, newer, other = (tokens.parse_schema(tokens.to_text(s)) for _ in range(3))
    newer.version = "2.0.0"
    other.action("transfer", "balances[from] > amount")
    rows = [(k, x.equals(s), x.same_structure(s)) for k, x in (("read again", again), ("other version", newer), ("other guard", other))]
    return table(spark, rows, "kind string, same_id boolean, same_structure boolean")


@query(f"with {AREA} select 'place' as kind, r_name as id, count(*)::double as amount from area group by r_name union all select 'arc', r_name || '->' || n_name, n_nationkey % 3 + 1 from area")
def schema_conversion(spark, d):
    """A net as a schema, through its text, and as a net again; an arc of weight n is n arcs."""
    net = tokens.to_net(tokens.parse_schema(tokens.to_text(tokens.from_net(area_net(spark, d), "area"))))
    weights: dict[str, float] = {}
    for a in net.arcs:
        weights[f"{a.source}->{a.target}"] = weights.get(f"{a.source}->{a.target}", 0.0) + a.total
    return table(spark, [("place", p.id, p.tokens) for p in net.places.values()] + [("arc", k, w) for k, w in weights.items()], "kind string, id string, amount double")


@query("select * from (values ('renamed', true, 0, 'p>x,q>y', 1.0), ('more tokens', false, 1, 'p>x,q>y', 1.0)) t(kind, same, problems, mapping, sure)")
def net_equivalence(spark, d):
    base, rows = Net().chain(1.0, "p", "t", "q"), []
    for kind, other in (("renamed", Net().chain(1.0, "x", "u", "y")), ("more tokens", Net().chain(1.05, "x", "u", "y"))):
        found, sure = tokens.mapping_by_trajectory(base, other, {"t": 0.3}, {"u": 0.3})
        rows.append((kind, tokens.same_signature(base, other), len(tokens.check_mapping(base, other, {**found, "t": "u"})), ",".join(f"{k}>{v}" for k, v in sorted(found.items())), sure))
    return table(spark, rows, "kind string, same boolean, problems int, mapping string, sure double")


@query("select round(100 * (exp(-0.1::double * 10) - exp(-0.2::double * 10)), 1)::double as at_end, 25.0::double as greatest")
def behaviour_gap(spark, d):
    """Decays at two rates: their difference at the end, and the greatest, which is a quarter of the tokens."""
    a = Net().chain(100.0, "A", "t", "B")
    greatest, at_end = tokens.behaviour_difference(a, a, {"A": "A"}, {"t": 0.1}, {"t": 0.2}, samples=1000, options=ode.Options(dt=0.01, adaptive=False))
    return table(spark, [(round(float(at_end), 1), round(float(greatest), 1))], "at_end double, greatest double")


@query("""with c as (select 100 * (1 - exp(-0.1::double * 10 * k)) as b, k from (values (0.0::double), (0.5), (1.0), (2.0)) t(k)), x as (select max(b) filter (where k = 0) as z, max(b) filter (where k = 0.5) as h, max(b) filter (where k = 1) as o, max(b) filter (where k = 2) as d from c)
select 'rate' as kind, 't' as element, round(o - z, 1)::double as zero, round(d - o, 1)::double as double, 'important' as category from x
union all select 'marking', 'A', 100.0 - 0, 100.0, 'important' from x where false
union all select 'marking', 'A', round(greatest(o, 100 - o), 1), round(greatest(o, 100 - o), 1), 'important' from x
union all select 'marking', 'B', 0.0, 0.0, 'important' from x""")
def rate_and_marking_sensitivity(spark, d):
    net = Net().chain(100.0, "A", "t", "B")
    rows = [("rate", t, round(zero, 1), round(double, 1), kind) for t, zero, half, double, value, kind in tokens.rate_sensitivity(net, {"t": 0.1}, options=ACCURATE)]
    rows += [("marking", p, round(zero, 1), round(double, 1), kind) for p, zero, double, more, value, kind in tokens.marking_sensitivity(net, {"t": 0.1}, options=ACCURATE)]
    return table(spark, rows, "kind string, element string, zero double, double double, category string")


@query("""select * from (values ('place', 'A', 'important', 1), ('place', 'B', 'important', 1), ('transition', 't', 'important', 1), ('arc', 'A->t', 'important', 2), ('arc', 't->B', 'important', 2)) t(kind, element, category, "symmetric") where element <> 'B' union all select 'place', 'B', 'peripheral', 1""")
def element_sensitivity_chain(spark, d):
    """Without its place the other end of a chain changes; without its end place the start does not."""
    net = Net().chain(100.0, "A", "t", "B")
    return tokens.element_sensitivity(spark, net, {"t": 0.1}, options=ACCURATE).select("kind", "element", "category", F.col("symmetric").cast("int").alias("symmetric"))


# --- Learning -----------------------------------------------------------------------


@query("select n_nationkey::int as n, 0.7::double as constant, greatest(0, 0.5 * n_regionkey - 0.8)::double as linear, (0.5 * n_regionkey - 0.8 + 0.1 * n_nationkey)::double as timed from nation".replace("greatest(0, 0.5 * n_regionkey - 0.8)::double", "round(greatest(0, 0.5 * n_regionkey - 0.8), 9)::double").replace("(0.5 * n_regionkey - 0.8 + 0.1 * n_nationkey)::double", "round(0.5 * n_regionkey - 0.8 + 0.1 * n_nationkey, 9)::double"))
def rate_functions(spark, d):
    constant, linear = learn.Constant(0.7), learn.Linear(["r"], np.array([-0.8, 0.5]))
    timed = learn.Linear(["r"], np.array([-0.8, 0.5, 0.1]), relu=False, timed=True)
    rows = []
    for r in read(spark, d, "nation").collect():
        state = {"r": float(r.n_regionkey)}
        rows.append((r.n_nationkey, constant(state, 0.0), round(linear(state, 0.0), 9), round(timed(state, float(r.n_nationkey)), 9)))
    return table(spark, rows, "n int, constant double, linear double, timed double")


@query("with recursive r as (select 0 as step, 100.0::double as a union all select step + 1, a * (1 - 0.005::double + 0.005::double * 0.005 / 2 - 0.005::double * 0.005 * 0.005 / 6 + 0.005::double * 0.005 * 0.005 * 0.005 / 24) from r where step < 200) select (step // 20 * 2)::double as t, round(a, 6)::double as value from r where step % 20 = 0".replace("(step // 20 * 2)::double as t", "round(step / 10.0, 6)::double as t"))
def learned_run(spark, d):
    """A run with a rate that is a function, sampled at uniform times."""
    problem = learn.Problem(decay_net(), {"A": 100.0}, (0.0, 20.0 - 1e-9), {"t": learn.Linear([], np.array([0.05]))})
    path = problem.solve("rk4", ode.Options(dt=0.1, adaptive=False))
    times = learn.uniform_times(0.0, 20.0, 11)
    return table(spark, [(round(t, 6), round(float(v), 6)) for t, v in zip(times, learn.sampled(path, times, "A"), strict=True)], "t double, value double")


@query("select * from (values ('nelder-mead', 0.2, true), ('coordinate-descent', 0.2, true)) t(method, rate, better)")
def learned_rate(spark, d):
    net = Net().chain(100.0, "A", "t", "B")
    times = learn.uniform_times(0.0, 20.0, 11)
    seen = learn.Observations(times, {"A": [100 * float(np.exp(-0.2 * t)) for t in times]})
    rows = []
    for method in ("nelder-mead", "coordinate-descent"):
        problem = learn.Problem(net, net.state(), (0.0, 20.0), {"t": learn.Linear([], np.array([0.05]))})
        out = learn.fit(problem, seen, method=method, max_iterations=60, options=ode.Options(dt=0.5, adaptive=False))
        rows.append((method, round(float(out.params[0]), 2), out.final_loss < out.initial_loss))
    return table(spark, rows, "method string, rate double, better boolean")


@query(f"with {USERS}, {GAPS}, r as (select activity, avg(s) as m from g group by activity) select id, round(case when m > 0 then 1 / m else 0.1 end, 12)::double as rate from (values ('click'), ('refund'), ('nothing')) t(id) left join r on id = activity")
def fitted_rate_functions(spark, d):
    wanted = table(spark, [("click",), ("refund",), ("nothing",)], "id string")
    found = timing.rate_functions(user_log(spark, d), wanted)
    return table(spark, [(k, round(f({}, 0.0), 12)) for k, f in found.items()], "id string, rate double")


@query(f"""with {USERS}, {GAPS}, q as (select activity, avg(s) as m, list_transform(range(21), lambda i: quantile_cont(s, i / 20.0)) as x from g where s is not null group by activity)
select 1""".replace("list_transform(range(21), lambda i: quantile_cont(s, i / 20.0))", "quantile_cont(s, [" + ", ".join(str(i / 20) for i in range(21)) + "])").replace("select 1", """, e as (select activity, (0.5 * m + 60) - m as mean_diff, list_sum(list_transform(x, lambda v: (0.5 * v + 60 - v) * (0.5 * v + 60 - v))) / 21 as mse from q)
select activity, round(mean_diff, 3)::double as mean_diff, round(sqrt(mse), 3)::double as rmse from e union all select null, round(avg(mean_diff), 3), round(sqrt(avg(mse)), 3) from e"""))
def log_compared(spark, d):
    """Simulated durations, here half of the log's and a minute, against the log."""
    lg = user_log(spark, d)
    simulated = timing.durations(lg).withColumn("seconds", F.col("seconds") * 0.5 + 60.0)
    return timing.compare_to_log(simulated, lg).select("activity", F.round("mean_diff", 3).alias("mean_diff"), F.round("rmse", 3).alias("rmse"))


# --- Workflow -----------------------------------------------------------------------


def review() -> workflow.Workflow:
    w = workflow.Workflow("review", default_deadline_s=100.0).task("a").task("b", needs={"desk": 1.0}).task("c").task("d")
    w.branch("a", {"b": workflow.when_var("x", ">", 1), "c": workflow.when_var("x", "<=", 1)})
    return w.merge("d", "b", "c").resource("desk", 3.0)


@query("""with c as (select n_nationkey, n_regionkey, case when n_regionkey > 1 then row_number() over (partition by n_regionkey > 1 order by n_nationkey) end as k from nation), t as (select unnest(['a', 'b', 'c', 'd']) as task),
s as (select n_nationkey as n, task, case task when 'a' then 'completed' when 'b' then case when n_regionkey <= 1 then 'skipped' when k <= 3 then 'running' else 'ready' end when 'c' then case when n_regionkey > 1 then 'skipped' else 'completed' end else case when n_regionkey <= 1 then 'completed' else 'pending' end end as status from c, t)
select n::int as n, task, status, case when bool_and(status in ('completed', 'skipped')) over (partition by n) then 'completed' else 'running' end as case_status from s""")
def workflow_cases(spark, d):
    """A case for each nation; three of those that need a desk get one."""
    e = workflow.Engine(review(), lambda: 0.0)
    for r in read(spark, d, "nation").orderBy("n_nationkey").collect():
        id = str(r.n_nationkey)
        e.start_case(id, {"x": r.n_regionkey})
        e.assign(id, "a", "anyone")
        e.start(id, "a")
        e.complete(id, "a")
        for task in ("b", "c", "d"):
            if (id, task) in e.ready():
                try:
                    e.start(id, task)
                except ValueError:
                    continue
                if task != "b":
                    e.complete(id, task)
    return table(spark, [(int(c.id), t, h["status"], c.status) for c in e.cases.values() for t, h in c.tasks.items()], "n int, task string, status string, case_status string")


@query("""with t as (select unnest(['a', 'b', 'c', 'd']) as task) select task || '_ready' as place, (task = 'a')::int::double as tokens, 1::int as goes from t union all select task || '_running', 0, 1 from t
union all select task || '_completed', 0, 0 from t union all select 'resource_desk', 3, 1""")
def workflow_net(spark, d):
    net = review().net()
    return table(spark, [(p.id, p.tokens, sum(a.source == p.id for a in net.arcs)) for p in net.places.values()], "place string, tokens double, goes int")


@query("""select 'retry' as kind, 'ready' as task, 'running' as status, 1.0::double as free union all select 'abort', 'failed', 'failed', 1.0 union all select 'skip', 'skipped', 'completed', 1.0 union all select 'escalate', 'escalated', 'running', 1.0 union all select 'cancel', 'cancelled', 'cancelled', 1.0 union all select 'give', 'completed', 'completed', 3.0""")
def workflow_outcomes(spark, d):
    """One task that holds a resource, and ends in each way."""
    rows = []
    for kind in ("retry", "abort", "skip", "escalate", "cancel", "give"):
        w = workflow.Workflow("w").task("a", needs={"r": 1.0}, gives={"r": 2.0} if kind == "give" else {}, retries=int(kind == "retry"), on_failure=kind if kind in ("skip", "escalate") else "abort").resource("r", 1.0)
        e = workflow.Engine(w, lambda: 0.0)
        e.start_case("1")
        e.start("1", "a")
        e.cancel("1") if kind == "cancel" else e.complete("1", "a") if kind == "give" else e.fail("1", "a")
        rows.append((kind, e.cases["1"].tasks["a"]["status"], e.cases["1"].status, e.available["r"]))
    return table(spark, rows, "kind string, task string, status string, free double")


@query("select n_nationkey::int as n, case when n_regionkey = 0 or n_nationkey > n_regionkey * 5 then 1.0 else n_nationkey / (n_regionkey * 5.0) end::double as risk, n_nationkey < 12 and n_nationkey >= 3 as busy, n_regionkey <> 2 as other from nation".replace("n_nationkey / (n_regionkey * 5.0)", "n_nationkey::double / (n_regionkey * 5)"))
def workflow_risk(spark, d):
    busy = [workflow.when_var("n", "<", 12), workflow.when_var("n", ">=", 3)]
    other = workflow.when_var("r", "!=", 2)
    rows = []
    for r in read(spark, d, "nation").collect():
        v = {"n": r.n_nationkey, "r": r.n_regionkey}
        rows.append((r.n_nationkey, float(workflow.risk(float(r.n_nationkey), r.n_regionkey * 5.0)), all(c(v) for c in busy), other(v)))
    return table(spark, rows, "n int, risk double, busy boolean, other boolean")


@query("select * from (values (true, 1.0, true)) t(raised_is_sooner, probability, after_first)")
def workflow_forecast(spark, d):
    """Work that is under way ends within the day, sooner at raised rates, and sooner than work that waits."""
    w = workflow.Workflow("w").task("a", estimated_s=600.0).task("b", estimated_s=600.0).sequence("a", "b")
    now, raised = workflow.what_if(w, {"a": "running", "b": "pending"}, 1.0)
    late, sure = workflow.forecast(w, {"a": "completed", "b": "running"})
    return table(spark, [(raised < now, round(sure, 2), late < now)], "raised_is_sooner boolean, probability double, after_first boolean")


# --- Monitoring -----------------------------------------------------------------------


WATCHED = f"{USERS}, o as (select *, row_number() over w as k, count(*) over (partition by case_id) as n, lag(ts) over w as before from u window w as (partition by case_id order by ts, seq)), e as (select *, case when k = 1 then 'start' when k = n and k % 2 = 0 then 'complete' else 'event' end as kind from o)"


def watched(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as monitored cases: the first opens a case, an even last one closes it."""
    lg = user_log(spark, d)
    w = Window.partitionBy("case_id")
    k, n = F.row_number().over(w.orderBy("ts", "seq")), F.count(F.lit(1)).over(w)
    return lg.select("case_id", "activity", "ts", "seq", F.when(k == 1, "start").when((k == n) & (k % 2 == 0), "complete").otherwise("event").alias("kind"))


@query(f"with {WATCHED} select 'stuck' as alert, 'warning' as severity, count(*)::bigint as n from e where kind = 'event' and epoch_us(ts) - epoch_us(before) > 43200000000")
def monitor_alerts(spark, d):
    out = monitor.monitor(watched(spark, d), talk_net(), {}, monitor.Config(stuck_s=43_200.0, predictions=False))
    return monitor.statistics(out)


@query(f"with {WATCHED} select case_id, epoch_us(min(ts)) as started_us, epoch_us(max(ts)) as last_us, count(*) filter (where kind = 'event')::bigint as events from e group by case_id having count(*) filter (where kind = 'complete') = 0")
def monitor_active(spark, d):
    out = monitor.active_cases(watched(spark, d))
    return out.select("case_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_ts").alias("last_us"), "events")


@query(f"""with recursive {TALKS}, o as (select case_id, activity, row_number() over (partition by case_id order by ts, seq) as k, count(*) over (partition by case_id) as n from u),
r as (select distinct case_id, 0::bigint as k, 1.0::double as s, 0.0::double as q, 0.0::double as e from u union all
    select r.case_id, r.k + 1, case when activity = 'user' then greatest(s - 1, 0) else s end, case when activity = 'user' then q + 1 when activity = 'assistant' then greatest(q - 1, 0) else q end, case when activity = 'assistant' then e + 1 else e end
    from r join o on o.case_id = r.case_id and o.k = r.k + 1),
f as (select r.* from r join (select case_id, count(*) as n from u group by case_id) c on c.case_id = r.case_id and c.n = r.k), x as (select *, 0.02 * s as fu, 0.05 * q as fa from f)
select case_id, s as start_tokens, q as asked, e as ended, case when fu = 0 and fa = 0 then null when fa > fu then 'assistant' else 'user' end as next, case when fu + fa > 0 then round(greatest(fu, fa) / (fu + fa), 6) end::double as probability from x""")
def next_of_talks(spark, d):
    """The marking of each talk after its turns, and the likeliest next turn."""
    net, rates = talk_net(), {"user": 0.02, "assistant": 0.05}

    @F.pandas_udf("start_tokens double, asked double, ended double, next string, probability double")
    def judged(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for variants in it:
            rows = []
            for v in variants:
                state = monitor.estimate(net, list(v))
                best = max(monitor.next_activities(net, rates, state), key=lambda x: (x[1], x[0]), default=(None, None))
                rows.append((state["start"], state["asked"], state["end"], best[0], None if best[1] is None else round(best[1], 6)))
            yield pd.DataFrame(rows, columns=["start_tokens", "asked", "ended", "next", "probability"])

    return log.traces(talk_log(spark, d)).select("case_id", judged("variant").alias("j")).select("case_id", "j.*")


@query(f"with {MAPS}, t as (select user_id, coalesce(max(x) filter (where k = 'click'), 0) as c, coalesce(max(x) filter (where k = 'error'), 0) as e from m group by user_id) select user_id, concat_ws(',', case when c > 150 then 'busy' end, case when e > 100 and c < 150 then 'failing' end) as rules from t")
def rules_on_states(spark, d):
    m = user_maps(spark, d)
    click, error = statemap.get("a", "click"), statemap.get("a", "error")
    return m.select("user_id", F.array_join(monitor.rule_column({"busy": click > 150, "failing": (error > 100) & (click < 150)}), ",").alias("rules"))


@query("""select * from (values ('step', 'low', round(100 * exp(-0.5::double), 1)), ('step', 'low,very low', round(100 * exp(-1.0::double), 1)), ('simulate', '', round(40 * exp(-0.2::double), 1)), ('state', '', 40.0), ('step', 'low,very low', round(40 * exp(-0.1::double), 1))) t(kind, rules, value)""")
def rule_engine(spark, d):
    """Steps of a decay with rules; then its state and rates are set, a run is tried, and a step made."""
    e = monitor.RuleEngine(decay_net(), rates={"t": 0.1}).rule("low", monitor.below("A", 70.0), lambda s: None).rule("very low", monitor.all_of(monitor.below("A", 50.0), monitor.any_of(monitor.above("A", 1.0))), lambda s: None)
    rows = []
    for _ in range(2):
        names = e.step(5.0)
        rows.append(("step", ",".join(names), round(e.state["A"], 1)))
    e.set_state({"A": 40.0})
    e.update_rates({"t": 0.02})
    rows += [("simulate", "", round(e.simulate(10.0).final["A"], 1)), ("state", "", e.state["A"])]
    names = e.step(5.0)
    rows.append(("step", ",".join(names), round(e.state["A"], 1)))
    return table(spark, rows, "kind string, rules string, value double")


# --- Signals and charts -------------------------------------------------------------------


@query(f"with {SIGNALS}, b as (select * from (values ('audit', '*', 1), ('shop', 'click', 2)) t(actor_id, wanted, priority)), p as (select id, case when type = 'signup' then 'view' else type end as type, target from g where type <> 'error'), x as (select actor_id, type, count(*)::bigint as n from p join b on (p.type = wanted or wanted = '*') and (target is null or target = actor_id) group by all) select * from x")
def signals_after_middleware(spark, d):
    """Middleware drops and changes signals before they are delivered; one subscription is taken back."""
    subs = table(spark, [("audit", "*", 1), ("shop", "purchase", 5), ("shop", "click", 2)], "actor_id string, type string, priority int")
    steps = [actors.keep(F.col("type") != "error"), actors.change(type=F.when(F.col("type") == "signup", "view").otherwise(F.col("type")))]
    out = actors.dispatch(actors.middleware(signals(spark, d), steps), actors.unsubscribe(subs, "shop", "purchase"))
    return out.groupBy("actor_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SIGNALS} select (2 * count(*))::bigint as published, count(distinct type)::bigint as types, (2 * count(*) filter (where type = 'click' and target is null))::bigint as delivered from g")
def bus_statistics(spark, d):
    both = actors.broadcast([signals(spark, d), signals(spark, d)])
    subs = table(spark, [("shop", "click", 1)], "actor_id string, type string, priority int")
    return actors.bus_stats(both, actors.dispatch(both, subs))


@query(f"with {SIGNALS} select id, 'seen' as type, k * 2 as size from g where type = 'view' union all select id, 'again', -1 from g where type = 'refund' union all select id, 'rare', -1 from g where type = 'error' and k > 90")
def signals_processed(spark, d):
    g = signals(spark, d).join(read(spark, d, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.get_json_object("props", "$.k").cast("int").alias("k")), "id")
    seen = actors.process(g, "view", "seen", F.create_map(F.lit("size"), (F.col("k") * 2).cast("string"))).select("id", "type", F.col("payload")["size"].cast("int").alias("size"))
    again = actors.forward(g, "refund", "again").select("id", "type", F.lit(-1).alias("size"))
    rare = actors.filtered(g, "error", "rare", F.col("k") > 90).select("id", "type", F.lit(-1).alias("size"))
    return seen.union(again).union(rare)


@query(f"""with recursive {STORE}, r as (
    select distinct stream_id, -1 as version, 0 as seen, 0 as clicked, false as sold, null::timestamp as ts from st
    union all
    select r.stream_id, st.version, seen + (type = 'view')::int - (type = 'click' and seen >= 1)::int, clicked + (type = 'click' and seen >= 1)::int - (type = 'purchase' and clicked >= 1)::int, type = 'purchase' and clicked >= 1, st.timestamp
    from r join st on st.stream_id = r.stream_id and st.version = r.version + 1)
select stream_id as source, 'sold' as type, epoch_us(ts) as ts_us, 'purchase' as transition from r where sold""")
def net_actors(spark, d):
    """A net for each source; purchases that fire are told."""
    out = actors.net_actor(signals(spark, d), shop_net(), {"view": "view", "click": "click", "purchase": "purchase"}, {"purchase": "sold"})
    return out.select("source", "type", F.unix_micros("ts").alias("ts_us"), "transition")


@query(f"with {SIGNALS} select id as correlation_id, source, case when k % 2 = 0 then id || '/reply' end as reply_id, k % 2 = 0 as answered from g where type = 'purchase'")
def requests_answered(spark, d):
    """Purchases ask for a receipt; those of even kind get one."""
    asked = actors.request(signals(spark, d), "purchase", "receipt")
    replies = actors.reply(asked.where(F.col("payload")["route"] == "even"), "shop", F.create_map(F.lit("ok"), F.lit("yes")))
    return actors.answered(asked, replies).select("correlation_id", "source", "reply_id", F.col("replied_at").isNotNull().alias("answered"))


@query("select user_id::varchar as key, least(count(*) filter (where event_type = 'click'), 6)::bigint as moved, case when least(count(*) filter (where event_type = 'click'), 6) % 2 = 1 then 'lamp:on.bright' else 'lamp:off' end as state from events group by user_id")
def chart_counters(spark, d):
    """A lamp that counts how often it is lit, and is lit three times at most; its lit state has a substate."""
    chart = statechart.Chart("lamp").region("lamp", "off", "on", "on.bright").counter("n")

    def count(counters: dict) -> None:
        counters["n"] += 1

    chart.when("click", "lamp:off", "lamp:on", lambda c: c["n"] < 3, count).when("click", "lamp:on", "lamp:off")
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), F.col("event_type").alias("event"))
    return statechart.run_chart(e, chart).groupBy("key").agg(F.sum(F.col("moved").cast("long")).alias("moved"), F.max_by("state", "seq").alias("state"))


# --- Stores that are written ----------------------------------------------------------------


def _written(spark: SparkSession, d: str) -> events.EventStore:
    """The store's events in a folder, as :class:`~loomtrace.operators.events.EventStore` keeps them."""
    out = events.EventStore(spark, fresh_path(spark, "store"))
    old = store(spark, d).withColumn("bucket", F.pmod(F.hash("stream_id"), F.lit(out.BUCKETS)))
    old.repartition("bucket").write.partitionBy("bucket").parquet(f"{out.path}/events")
    return out


def _news(spark: SparkSession, n: int) -> DataFrame:
    rows = [(f"news{i}", i, json.dumps({"n": i})) for i in range(n)]
    return table(spark, rows, "type string, seq long, data string").withColumn("timestamp", F.lit("2030-01-01").cast("timestamp")).withColumn("metadata", F.lit(None).cast("map<string,string>"))


@query(f"""with {STORE}, v as (select stream_id, max(version) as version from st group by stream_id)
select stream_id, (version + case stream_id when '7' then 3 else 0 end)::int as version from v where stream_id <> '8' union all select 'fresh', 1""")
def store_written(spark, d):
    """Events are appended to a stream that is there and to a new one, and a stream is deleted."""
    s = _written(spark, d)
    at = events.stream_version(s.stream("7"), "7")
    s.append("7", at, _news(spark, 3))
    s.append("fresh", -1, _news(spark, 2))
    try:
        s.append("7", at, _news(spark, 1))
        raise AssertionError("a stale writer was let in")
    except events.ConcurrencyConflict:
        pass
    s.delete_stream("8")
    return events.stream_versions(s.events())


@query(f"with {STORE} select id, stream_id, version from st where type = 'click'")
def store_subscription(spark, d):
    """Events of one type as a stream, written by the streaming engine and read again."""
    s = _written(spark, d)
    out, marks = fresh_path(spark, "subscribed"), fresh_path(spark, "marks")
    s.subscribe(types=["click"]).writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("id", "stream_id", "version")


@query(f"with {STORE}, c as (select stream_id, count(*) filter (where type = 'click') as clicks, max(version) as version from st where stream_id in ('7', '9') group by stream_id) select stream_id, (clicks + 5)::bigint as clicks, (version + 1)::bigint as version from c union all select 'fresh', 5, 0")
def store_repository(spark, d):
    """Aggregates that count clicks, loaded from the store; each gets a click of five."""
    s = _written(spark, d)
    repo = events.Repository(s, lambda id: events.Aggregate(id, 0).on("click", lambda n, e: n + e.get("n", 1)))
    rows = []
    for id in ("7", "9", "fresh"):
        a = repo.execute(id, lambda n: [("click", {"n": 5})], "2030-01-01")
        again = repo.load(id)
        assert (again.state, again.version) == (a.state, a.version)
        rows.append((id, a.state, a.version))
    return table(spark, rows, "stream_id string, clicks long, version long")


# --- Patterns -----------------------------------------------------------------------


@query("""with recursive o as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, case event_type when 'purchase' then 2 when 'refund' then -3 else 0 end as x from events),
r as (select distinct user_id, 0::bigint as k, 0::bigint as s from o union all select r.user_id, r.k + 1, greatest(0, s + x) from r join o on o.user_id = r.user_id and o.k = r.k + 1)
select user_id, arg_max(s, k) as state from r group by user_id""")
def folded_events(spark, d):
    """Points of users, which never fall below zero: an ordered fold in the JVM."""
    x = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "refund", -3).otherwise(0).cast("long")
    e = read(spark, d, "events").select("user_id", "ts", "event_id", x.alias("x"))
    return patterns.fold_events(e, "user_id", ["ts", "event_id"], ["x"], F.lit(0).cast("long"), lambda s, r: F.greatest(F.lit(0).cast("long"), s + r.x))


@query("""with e as (select n_nationkey, row_number() over (order by n_nationkey) - 1 as k from nation) select n_nationkey::int as n, ['b', 'c', 'a'][k % 3 + 1] as state, true as could, (k + 1)::bigint as events, (select sum(x.n_nationkey) from nation x where x.n_nationkey <= e.n_nationkey)::bigint as total from e""")
def pattern_machines(spark, d):
    """A machine of three states that goes round, and event sourcing, a step for each nation."""
    m = patterns.StateMachine("m", "a").move("ab", "a", "b").move("bc", "b", "c").move("ca", "c", "a")
    s = patterns.EventSourced("s", 0, lambda x, e: x + e, 0)
    rows = []
    for r in read(spark, d, "nation").orderBy("n_nationkey").collect():
        move = {"a": "ab", "b": "bc", "c": "ca"}[m.state]
        could = m.can(move)
        m.fire(move)
        s.apply(r.n_nationkey)
        assert s.replay(s.events) == s.state
        rows.append((r.n_nationkey, m.state, could, len(s.events), s.project(0)))
    return table(spark, rows, "n int, state string, could boolean, events long, total long")


@query("select * from (values ('POST', '/instances', 'create'), ('GET', '/instances', 'list'), ('GET', '/instances/{id}', 'get')) t(method, path, action) union all select 'POST', '/instances/{id}/' || n_name, n_name from nation union all select 'event', 'Nation' || n_nationkey, '' from nation union all select 'event', 'Created', '' union all select 'field', replace(r_name, ' ', '_'), 'double' from region union all select 'field', 'id', 'string' union all select 'field', 'version', 'int'")
def inferred_interface(spark, d):
    """Routes, event types and state fields of a model."""
    net = area_net(spark, d)
    rows = patterns.routes(net) + [("event", e, "") for e in patterns.event_types(net)] + [("field", f, t) for f, t in patterns.state_fields(net)]
    return table(spark, rows, "method string, path string, action string")


@query("select * from (values ('sound', '', 3), ('odd', 'a b: not an identifier', 2), ('limits', 'limits: too small', 3)) t(kind, problem, free)")
def extended_models(spark, d):
    """Checks before generation, an extension that objects to its model, and a pool of resources."""

    class Limits:
        def problems(self, net: Net) -> list[str]:
            return ["too small"] if len(net.places) < 3 else []

    registry = patterns.Registry()
    registry.register("limits", Limits)
    small = Net().chain(1.0, "a", "t", "b")
    odd = Net().place("a b").transition("t").arc("a b", "t")
    model = patterns.ExtendedModel(small).add("limits", registry.create("limits"))
    pool = patterns.ResourcePool("r", 3)
    rows = [("sound", ",".join(patterns.problems_for_generation(small)), pool.free)]
    pool.acquire()
    rows.append(("odd", ",".join(patterns.problems_for_generation(odd)), pool.free))
    pool.release()
    rows.append(("limits", ",".join(model.problems()), pool.free))
    return table(spark, rows, "kind string, problem string, free int")
