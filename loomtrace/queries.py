"""Queries that apply the operators to the shared tables, each with SQL where SQL can express it.

Doubles are rounded alike on both sides; arrays are joined to text and counts are 64-bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import guard, statemap
from .operators import conformance, discovery, events, footprint, learn, log, statespace, timing, tokens, workflow
from .plans import ode, search, trajectory
from .plans.net import Net
from .sources import templates
from .sources.log import to_log
from .streaming import actors, monitor, statechart

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Logs --------------------------------------------------------------------


def user_log(spark: SparkSession, d: str) -> DataFrame:
    """Events by user."""
    return to_log(read(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


def day_log(spark: SparkSession, d: str) -> DataFrame:
    """Events by user and day."""
    return to_log(read(spark, d, "events"), F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")), "event_type", "ts", "event_id")


def talk_log(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations, one a minute."""
    return to_log(read(spark, d, "conversations"), "conv_id", "role", F.timestamp_seconds(F.col("turn") * 60), "turn")


def line_log(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders by flag and status."""
    seq = F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    return to_log(read(spark, d, "lineitem"), "l_orderkey", F.concat("l_returnflag", "l_linestatus"), "l_shipdate", seq)


USERS = "u as (select user_id::varchar as case_id, event_type as activity, ts, event_id as seq from events)"
DAYS = "u as (select user_id || '-' || strftime(ts, '%Y%m%d') as case_id, event_type as activity, ts, event_id as seq from events)"
TALKS = "u as (select conv_id::varchar as case_id, role as activity, make_timestamp(turn * 60000000) as ts, turn as seq from conversations)"
LINES = "u as (select l_orderkey::varchar as case_id, l_returnflag || l_linestatus as activity, l_shipdate as ts, l_linenumber::bigint * 1000000000000 + l_partkey * 1000000 + l_suppkey as seq from lineitem)"
DFG = "dfg as (select a, b, count(*)::bigint as n from (select activity as a, lead(activity) over (partition by case_id order by ts, seq) as b from u) where b is not null group by a, b)"
PAIRS = DFG + """,
acts as (select distinct activity from u),
pairs as (
    select x.activity as a, y.activity as b, coalesce(f.n, 0)::bigint as ab, coalesce(r.n, 0)::bigint as ba
    from acts x cross join acts y left join dfg f on f.a = x.activity and f.b = y.activity left join dfg r on r.a = y.activity and r.b = x.activity
),
related as (
    select *, case when ab > 0 and ba > 0 then 'parallel' when ab > 0 then 'causal' when ba > 0 then 'reverse' else 'choice' end as relation from pairs
)"""


def _footprint(lg: DataFrame) -> DataFrame:
    return footprint.footprint(footprint.directly_follows(lg), lg.select("activity").distinct())


@query(f"with {USERS}, {PAIRS} select a, b, ab, ba, relation from related")
def footprint_users(spark, d):
    return _footprint(user_log(spark, d)).select("a", "b", F.col("ab").cast("long").alias("ab"), F.col("ba").cast("long").alias("ba"), "relation")


@query(f"with {TALKS}, {PAIRS} select a, b, ab, ba, relation from related")
def footprint_talks(spark, d):
    return _footprint(talk_log(spark, d)).select("a", "b", F.col("ab").cast("long").alias("ab"), F.col("ba").cast("long").alias("ba"), "relation")


@query(f"with {LINES}, {DFG} select a, b, n from dfg")
def directly_follows_lines(spark, d):
    return footprint.directly_follows(line_log(spark, d))


@query(f"with {TALKS}, {PAIRS}, s as (select a, b, case relation when 'causal' then '->' when 'reverse' then '<-' when 'parallel' then '||' else '#' end as sign from related) select left(a, 4) as a, max(sign) filter (where b = 'assistant') as assistant, max(sign) filter (where b = 'system') as system, max(sign) filter (where b = 'user') as \"user\" from s group by s.a")
def footprint_matrix(spark, d):
    return footprint.matrix(_footprint(talk_log(spark, d)))


@query(f"with {TALKS}, {DFG}, s as (select a as activity, string_agg(b, ',' order by b) as successors from dfg group by a), p as (select b as activity, string_agg(a, ',' order by a) as predecessors from dfg group by b) select activity, coalesce(successors, '') as successors, coalesce(predecessors, '') as predecessors from s full join p using (activity)")
def neighbours_talks(spark, d):
    n = footprint.neighbours(footprint.directly_follows(talk_log(spark, d)))
    return n.select("activity", F.array_join("successors", ",").alias("successors"), F.array_join("predecessors", ",").alias("predecessors"))


@query(f"with {TALKS}, {PAIRS}, e as (select a, b from related where relation = 'causal'), s as (select a as activity, string_agg(b, ',' order by b) as successors from e group by a), p as (select b as activity, string_agg(a, ',' order by a) as predecessors from e group by b) select activity, coalesce(successors, '') as successors, coalesce(predecessors, '') as predecessors from s full join p using (activity)")
def causal_neighbours_talks(spark, d):
    n = footprint.neighbours(footprint.directly_follows(talk_log(spark, d)), causal=True)
    return n.select("activity", F.array_join("successors", ",").alias("successors"), F.array_join("predecessors", ",").alias("predecessors"))


@query(f"with {USERS} select activity, count(*)::bigint as cases from (select activity, row_number() over (partition by case_id order by ts, seq) as k from u) where k = 1 group by activity")
def start_activities(spark, d):
    return footprint.start_activities(user_log(spark, d))


@query(f"with {USERS} select activity, count(*)::bigint as cases from (select activity, row_number() over (partition by case_id order by ts desc, seq desc) as k from u) where k = 1 group by activity")
def end_activities(spark, d):
    return footprint.end_activities(user_log(spark, d))


@query(f"with {LINES} select count(distinct case_id)::bigint as cases, count(*)::bigint as events from u")
def log_counts(spark, d):
    return log.counts(line_log(spark, d))


@query(f"with {LINES} select distinct activity from u")
def log_activities(spark, d):
    return log.activities(line_log(spark, d))


@query("select distinct event_type as resource from events where event_type <> ''")
def log_resources(spark, d):
    return log.resources(to_log(read(spark, d, "events"), "user_id", "event_type", "ts", "event_id", resource="event_type"))


@query(f"with {LINES} select case_id, count(*)::bigint as events, epoch_us(max(ts)) - epoch_us(min(ts)) as duration_us from u group by case_id")
def log_cases(spark, d):
    return log.cases(line_log(spark, d)).select("case_id", "events", "duration_us")


@query(f"with {DAYS} select variant, count(*)::bigint as cases from (select string_agg(activity, ' ' order by ts, seq) as variant from u group by case_id) group by variant")
def log_variants(spark, d):
    return log.variants(day_log(spark, d)).select(F.array_join("variant", " ").alias("variant"), "cases")


@query(f"with {TALKS} select case_id, string_agg(activity, ' ' order by ts, seq) as variant, count(*)::bigint as events from u group by case_id")
def log_traces(spark, d):
    return log.traces(talk_log(spark, d)).select("case_id", F.array_join("variant", " ").alias("variant"), F.size("events").cast("long").alias("events"))


@query(f"with {USERS} select case_id, seq, (row_number() over (partition by case_id order by ts, seq) - 1)::bigint as position from u")
def log_positions(spark, d):
    return log.ordered(user_log(spark, d)).select("case_id", "seq", F.col("position").cast("long").alias("position"))


@query(f"""with {LINES}, p as (select case_id, count(*) as n, string_agg(activity, ' ' order by ts, seq) as v, epoch_us(min(ts)) as s, epoch_us(max(ts)) as e from u group by case_id)
select count(*)::bigint as cases, sum(n)::bigint as events, (select count(distinct activity) from u)::bigint as activities, count(distinct v)::bigint as variants, (max(e) - min(s))::bigint as span_us, round(sum(n) / count(*), 6)::double as events_per_case, (sum(e - s) // count(*))::bigint as mean_duration_us from p""")
def log_summary(spark, d):
    s = log.summary(line_log(spark, d))
    return s.select("cases", "events", "activities", "variants", "span_us", F.round("events_per_case", 6).alias("events_per_case"), F.col("mean_duration_us").cast("long").alias("mean_duration_us"))


@query("""with g as (select user_id, event_id, ts, case when ts - lag(ts) over w > interval 12 hour then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, event_id, sum(fresh) over (partition by user_id order by ts, event_id) as session from g)
select user_id, session::bigint as session, count(*)::bigint as events from s group by user_id, session""")
def log_sessions(spark, d):
    return log.sessions(read(spark, d, "events"), "user_id", "ts", "12 hours", "event_id").groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count(F.lit(1)).alias("events"))


# --- Discovery ----------------------------------------------------------------


@query(f"with {USERS}, {PAIRS} select a, b, round((ab - ba) / (ab + ba + 1), 9)::double as score from pairs")
def dependency_matrix(spark, d):
    return discovery.dependency_matrix(_footprint(user_log(spark, d))).select("a", "b", F.round("score", 9).alias("score"))


@query(f"with {USERS}, {PAIRS} select a as activity, round(ab / (ab + 1), 9)::double as score from pairs where a = b")
def loop_scores(spark, d):
    return discovery.loop_scores(_footprint(user_log(spark, d))).select("activity", F.round("score", 9).alias("score"))


@query(f"with {TALKS}, {PAIRS} select a, b, case when ab > 0 and ba > 0 then round((ab + ba) / (ab + ba + 1), 9)::double else 0.0 end as score from pairs where a <> b")
def loop2_scores(spark, d):
    return discovery.loop2_scores(_footprint(talk_log(spark, d))).select("a", "b", F.round("score", 9).alias("score"))


@query(f"with {TALKS}, {PAIRS} select a, b, round((ab - ba) / (ab + ba + 1), 9)::double as score from pairs where a <> b and (ab - ba) / (ab + ba + 1) >= 0.5 union all select a, b, round(ab / (ab + 1), 9)::double from pairs where a = b and ab > 0 and ab / (ab + 1) >= 0.5")
def dependency_graph(spark, d):
    return discovery.dependency_graph(_footprint(talk_log(spark, d))).select("a", "b", F.round("score", 9).alias("score"))


@query(f"with {USERS}, {PAIRS} select a, b, round((ab - ba) / (ab + ba + 1), 9)::double as score from pairs where a <> b and ab > ba order by (ab - ba) / (ab + ba + 1) desc, a, b limit 5")
def top_edges(spark, d):
    return discovery.top_edges(_footprint(user_log(spark, d)), 5).select("a", "b", F.round("score", 9).alias("score"))


ENDS = """firsts as (select distinct activity from (select activity, row_number() over (partition by case_id order by ts, seq) as k from u) where k = 1),
lasts as (select distinct activity from (select activity, row_number() over (partition by case_id order by ts desc, seq desc) as k from u) where k = 1)"""


def _arcs(spark: SparkSession, net: Net) -> DataFrame:
    return net.frames(spark)[2].select("source", "target")


@query(f"""with {TALKS}, {PAIRS}, {ENDS},
e as (select a, b, 'p' || (row_number() over (order by a, b) - 1) as p from pairs where a <> b and ab + ba > 0 and (ab - ba) / (ab + ba + 1) >= 0.5),
l as (select a from pairs where a = b and ab > 0 and ab / (ab + 1) >= 0.5)
select a as source, p as target from e union all select p, b from e union all select a, 'loop_' || a from l union all select 'loop_' || a, a from l
union all select 'start', activity from firsts union all select activity, 'end' from lasts""")
def heuristic_net(spark, d):
    return _arcs(spark, discovery.heuristic(talk_log(spark, d)))


@query(f"""with recursive {TALKS}, {PAIRS}, {ENDS},
sets(s) as (
    select [activity] from acts
    union all
    select list_append(s, activity) from sets, acts
    where activity > s[len(s)] and len(s) < 5 and len(list_filter((select list(a) from related where relation <> 'choice' and b = activity), lambda x: list_contains(s, x))) = 0
),
cause as (select list(a || '>' || b) as pairs from related where relation = 'causal'),
cand as (select x.s as l, y.s as r from sets x, sets y, cause where len(list_filter(pairs, lambda p: list_contains(x.s, split_part(p, '>', 1)) and list_contains(y.s, split_part(p, '>', 2)))) = len(x.s) * len(y.s)),
places as (select 'p_' || array_to_string(l, '_') || '_' || array_to_string(r, '_') as p, l, r from cand c where not exists (select 1 from cand o where (o.l <> c.l or o.r <> c.r) and list_has_all(o.l, c.l) and list_has_all(o.r, c.r)))
select unnest(l) as source, p as target from places union all select p, unnest(r) from places
union all select 'start', activity from firsts union all select activity, 'end' from lasts""")
def alpha_net(spark, d):
    return _arcs(spark, discovery.alpha(talk_log(spark, d)))


@query(f"""with {TALKS}, a as (select activity, row_number() over (order by activity) as k, count(*) over () as n from (select distinct activity from u))
select case when k = 1 then 'start' else 'p' || (k - 1) end as source, activity as target from a union all select activity, case when k = n then 'end' else 'p' || k end from a""")
def sequential_net(spark, d):
    return _arcs(spark, discovery.sequential(talk_log(spark, d)))


@query(f"""with {TALKS}, v as (select list(activity order by ts, seq) as v from u group by case_id), top as (select v from v group by v order by count(*) desc, v limit 1),
a as (select unnest(v) as activity, generate_subscripts(v, 1) as k, len(v) as n from top)
select case when k = 1 then 'start' else 'p' || (k - 1) end as source, activity as target from a union all select activity, case when k = n then 'end' else 'p' || k end from a""")
def common_path_net(spark, d):
    return _arcs(spark, discovery.common_path(talk_log(spark, d)))


@query(f"with {DAYS}, v as (select string_agg(activity, ' ' order by ts, seq) as v from u group by case_id), c as (select count(*) as n from v group by v) select count(*)::bigint as variants, max(n)::bigint as most_common, round(max(n) / sum(n) * 100, 6)::double as coverage_percent from c")
def discovery_coverage(spark, d):
    return discovery.coverage(day_log(spark, d)).select("variants", "most_common", F.round("coverage_percent", 6).alias("coverage_percent"))


# --- Timing -------------------------------------------------------------------

GAPS = "g as (select case_id, activity, (epoch_us(lead(ts) over (partition by case_id order by ts, seq)) - epoch_us(ts)) / 1e6 as s from u)"


@query(f"with {USERS}, {GAPS} select activity, count(*)::bigint as events, count(s)::bigint as n, round(coalesce(avg(s), 0), 3)::double as mean_s, round(coalesce(stddev_samp(s), 0), 3)::double as std_s, round(case when avg(s) > 0 then 1 / avg(s) else 0.1 end, 12)::double as rate from g group by activity")
def activity_timing(spark, d):
    t = timing.activity_timing(user_log(spark, d))
    return t.select("activity", "events", "n", F.round("mean_s", 3).alias("mean_s"), F.round("std_s", 3).alias("std_s"), F.round("rate", 12).alias("rate"))


@query(f"with {DAYS}, s as (select case_id, epoch_us(min(ts)) as us from u group by case_id), g as (select case_id, (us - lag(us) over (order by us, case_id)) / 1e6 as seconds from s) select case_id, round(seconds, 6)::double as seconds from g where seconds is not null")
def inter_arrivals(spark, d):
    return timing.inter_arrivals(day_log(spark, d)).select("case_id", F.round("seconds", 6).alias("seconds"))


@query(f"with {DAYS}, s as (select case_id, epoch_us(min(ts)) as us, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as dur from u group by case_id), g as (select us - lag(us) over (order by us, case_id) as gap from s) select count(gap)::bigint as arrivals, round(avg(gap) / 1e6, 3)::double as mean_inter_arrival_s, (select count(*) from s)::bigint as cases, round((select avg(dur) from s), 3)::double as mean_case_s from g")
def timing_report(spark, d):
    r = timing.timing_report(day_log(spark, d))
    return r.select("arrivals", F.round("mean_inter_arrival_s", 3).alias("mean_inter_arrival_s"), "cases", F.round("mean_case_s", 3).alias("mean_case_s"))


@query(f"with {USERS}, {GAPS}, r as (select activity, avg(s) as m from g group by activity), t as (select unnest(['click', 'error', 'refund']) as id) select id, round(case when m > 0 then 1 / m else 0.1 end, 12)::double as rate from t left join r on id = activity")
def learned_rates(spark, d):
    wanted = spark.createDataFrame([("click",), ("error",), ("refund",)], "id string")
    return timing.rates_for(user_log(spark, d), wanted).select("id", F.round("rate", 12).alias("rate"))


# --- Conformance ---------------------------------------------------------------


def talk_net() -> Net:
    """A user asks, the assistant answers, which may go on; system turns are not in the model."""
    net = Net().place("start", 1.0).place("asked").place("end").transition("user").transition("assistant")
    return net.flow("start", "user", "asked").flow("asked", "assistant", "end")


REPLAYED = """o as (select case_id, activity, row_number() over (partition by case_id order by ts, seq) as k, count(*) over (partition by case_id) as n from u),
r as (
    select distinct case_id, 0::bigint as k, 1 as s, 0 as q, 0 as e, 1 as produced, 0 as consumed, 0 as missing from u
    union all
    select r.case_id, r.k + 1,
        case when activity = 'user' then greatest(s - 1, 0) else s end,
        case when activity = 'user' then q + 1 when activity = 'assistant' then greatest(q - 1, 0) else q end,
        case when activity = 'assistant' then e + 1 else e end,
        produced + (activity in ('user', 'assistant'))::int, consumed + (activity in ('user', 'assistant'))::int,
        missing + case when activity = 'user' then greatest(1 - s, 0) when activity = 'assistant' then greatest(1 - q, 0) else 1 end
    from r join o on o.case_id = r.case_id and o.k = r.k + 1
),
f as (
    select r.case_id, produced::bigint as produced, consumed::bigint as consumed, missing::bigint as missing, (s + q + (e <= 0)::int)::bigint as remaining
    from r join (select case_id, count(*) as n from u group by case_id) c on c.case_id = r.case_id and c.n = r.k
),
scored as (
    select *, case when consumed > 0 then greatest(0, 0.5 * (1 - missing::double / consumed) + 0.5 * (1 - remaining::double / produced)) else 1.0 end as fitness, missing = 0 and remaining = 0 as fitting from f
)"""
VISITED = """v as (
    select distinct case_id, 0::bigint as k, 1 as s, 0 as q, 0 as e from u
    union all
    select v.case_id, v.k + 1,
        case when activity = 'user' and s >= 1 then s - 1 else s end,
        case when activity = 'user' then q + 1 when activity = 'assistant' and q >= 1 then q - 1 else q end,
        case when activity = 'assistant' then e + 1 else e end
    from v join o on o.case_id = v.case_id and o.k = v.k + 1
),
seen as (select v.s, v.q, v.e, bool_or(activity = 'user') as took_user, bool_or(activity = 'assistant') as took_assistant from v join o on o.case_id = v.case_id and o.k = v.k + 1 group by v.s, v.q, v.e),
prec as (
    select count(*)::bigint as states, sum((s >= 1)::int + (q >= 1)::int)::bigint as enabled, sum((s >= 1 and not took_user)::int + (q >= 1 and not took_assistant)::int)::bigint as escaping from seen
)"""
OVERALL = "w as (select 0.5 * (1 - sum(missing)::double / sum(consumed)) + 0.5 * (1 - sum(remaining)::double / sum(produced)) as fitness from scored)"


@query(f"with recursive {TALKS}, {REPLAYED} select case_id, produced, consumed, missing, remaining, round(fitness, 9)::double as fitness, fitting from scored")
def replay_talks(spark, d):
    r = conformance.replay(talk_log(spark, d), talk_net())
    return r.select("case_id", "produced", "consumed", "missing", "remaining", F.round("fitness", 9).alias("fitness"), "fitting")


@query(f"with recursive {TALKS}, {REPLAYED}, {OVERALL} select count(*)::bigint as cases, sum(fitting::int)::bigint as fitting_cases, sum(missing)::bigint as missing, sum(remaining)::bigint as remaining, round(avg(scored.fitness), 6)::double as mean_case_fitness, round(any_value(w.fitness), 9)::double as fitness from scored, w")
def fitness_talks(spark, d):
    f = conformance.fitness(talk_log(spark, d), talk_net())
    return f.select("cases", "fitting_cases", "missing", "remaining", F.round("mean_case_fitness", 6).alias("mean_case_fitness"), F.round("fitness", 9).alias("fitness"))


@query(f"with recursive {TALKS}, {REPLAYED}, {VISITED} select states, enabled, escaping, round(1 - escaping / enabled, 9)::double as precision from prec")
def precision_talks(spark, d):
    return conformance.precision(talk_log(spark, d), talk_net()).withColumn("precision", F.round("precision", 9))


@query(f"with recursive {TALKS}, {REPLAYED}, {VISITED}, {OVERALL} select round(fitness, 9)::double as fitness, round(1 - escaping / enabled, 9)::double as precision, round(2 * fitness * (1 - escaping / enabled) / (fitness + 1 - escaping / enabled), 9)::double as f_score from w, prec")
def conformance_talks(spark, d):
    c = conformance.conformance(talk_log(spark, d), talk_net())
    return c.select(*[F.round(x, 9).alias(x) for x in ("fitness", "precision", "f_score")])


@query(f"with recursive {TALKS}, {REPLAYED} select case_id, round(fitness, 9)::double as fitness from scored where not fitting")
def not_fitting_talks(spark, d):
    r = conformance.by_fitness(conformance.not_fitting(conformance.replay(talk_log(spark, d), talk_net())))
    return r.select("case_id", F.round("fitness", 9).alias("fitness"))


# --- Event store ---------------------------------------------------------------


def store(spark: SparkSession, d: str) -> DataFrame:
    """Events by user as streams; the data state one place, by type, from the property ``k``."""
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    data = F.concat(F.lit('{"state":{"'), "event_type", F.lit('":'), (k % 3).cast("string"), F.lit('},"title":"'), "event_type", F.lit(" "), k.cast("string"), F.lit('"}'))
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("stream_id"), F.col("event_type").alias("type"), version.cast("int").alias("version"), F.col("ts").cast("timestamp").alias("timestamp"), data.alias("data"), F.lit(None).cast("map<string,string>").alias("metadata"))


STORE = "st as (select event_id::varchar as id, user_id::varchar as stream_id, event_type as type, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as version, ts as timestamp, json_extract_string(props, '$.k')::int as k from events)"
STATES = STORE + ", states as (select stream_id, type as place, arg_max(k % 3, version)::double as tokens from st group by stream_id, type)"


@query(f"with {STORE} select stream_id, max(version) as version from st group by stream_id")
def store_versions(spark, d):
    return events.stream_versions(store(spark, d))


@query(f"with {STORE} select version, type from st where stream_id = '7' and version >= 3")
def store_stream(spark, d):
    return events.read_stream(store(spark, d), "7", 3).select("version", "type")


@query(f"with {STORE} select id, stream_id, version from st where type in ('click', 'error') and version between 2 and 20 and timestamp >= timestamp '2024-01-05' and timestamp <= timestamp '2024-01-20'")
def store_filtered(spark, d):
    condition = events.event_filter(types=["click", "error"], from_version=2, to_version=20, since="2024-01-05", until="2024-01-20")
    return events.read_all(store(spark, d), condition).select("id", "stream_id", "version")


@query(f"with {STORE} select id from st order by timestamp, stream_id, version limit 100")
def store_first(spark, d):
    return events.read_all(store(spark, d), limit=100).select("id")


@query(f"with {STATES} select stream_id, place, tokens from states")
def store_states(spark, d):
    return events.instance_states(store(spark, d))


@query(f"with {STATES}, i as (select stream_id, max(version) as version from st group by stream_id) select stream_id, i.version from i where stream_id in (select stream_id from states where place = 'purchase' and tokens > 0) order by stream_id limit 20 offset 20")
def store_instances(spark, d):
    return events.page_of(events.instances(store(spark, d), "purchase"), ["stream_id"], 2, 20).select("stream_id", "version")


@query(f"with {STORE} select stream_id, max(version) as version from st group by stream_id having max(timestamp) <= timestamp '2024-01-30 12:00:00' order by max(timestamp) desc, stream_id limit 15")
def store_recent(spark, d):
    return events.recent_instances(store(spark, d), until="2024-01-30 12:00:00", per_page=15).select("stream_id", "version")


@query(f"with {STORE} select count(distinct stream_id)::bigint as instances, count(*)::bigint as events from st")
def store_stats(spark, d):
    return events.store_stats(store(spark, d))


@query(f"with {STORE} select type as place, count(*)::bigint as events from st where k % 3 > 0 group by type")
def store_by_place(spark, d):
    return events.stats_by_place(store(spark, d))


@query(f"with {STORE} select stream_id, max(version) as version from st where version % 10 = 0 group by stream_id")
def store_snapshots(spark, d):
    return events.latest_snapshots(store(spark, d).where("version % 10 = 0").select("stream_id", "version", "data")).select("stream_id", "version")


@query(f"with {STORE} select stream_id, 'title' as field, arg_max(type || ' ' || k, version) as value from st group by stream_id")
def store_index(spark, d):
    return events.index_events(store(spark, d), ["title", "tags"]).select("stream_id", "field", "value")


@query(f"with {STORE}, i as (select stream_id, arg_max(type || ' ' || k, version) as value, max(timestamp) as latest from st group by stream_id) select stream_id, 1::bigint as hits from i where contains(lower(value), 'click') order by latest desc, stream_id limit 10")
def store_search(spark, d):
    return events.search(events.index_events(store(spark, d), ["title"]), "CLICK", limit=10).select("stream_id", "hits")


@query(f"with {STORE} select stream_id, (max(version) + 1)::int as version, 'audit' as type from st group by stream_id union all select stream_id, (max(version) + 2)::int, 'audit' from st group by stream_id")
def store_append(spark, d):
    old = store(spark, d)
    new = old.select("stream_id").distinct().select("stream_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.lit("audit").alias("type"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit("{}").alias("data"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return events.with_versions(new, old).select("stream_id", "version", "type")


@query(f"with {STORE}, f as (select * from (values ('view', 'seen', 1.0), ('click', 'seen', -1.0), ('click', 'clicked', 1.0), ('purchase', 'clicked', -1.0), ('purchase', 'bought', 1.0)) t(type, place, change)) select stream_id, place, sum(change)::double as tokens from st join f using (type) group by stream_id, place")
def store_replay(spark, d):
    effects = [("view", "seen", 1.0), ("click", "seen", -1.0), ("click", "clicked", 1.0), ("purchase", "clicked", -1.0), ("purchase", "bought", 1.0)]
    return events.replay_linear(store(spark, d), spark.createDataFrame(effects, "type string, place string, change double"))


@query(f"""with recursive {STORE}, r as (
    select distinct stream_id, -1 as version, 0 as seen, 0 as clicked, 0 as bought, 0 as fired from st
    union all
    select r.stream_id, st.version, seen + (type = 'view')::int - (type = 'click' and seen >= 1)::int,
        clicked + (type = 'click' and seen >= 1)::int - (type = 'purchase' and clicked >= 1)::int, bought + (type = 'purchase' and clicked >= 1)::int,
        fired + (type = 'view' or type = 'click' and seen >= 1 or type = 'purchase' and clicked >= 1)::int
    from r join st on st.stream_id = r.stream_id and st.version = r.version + 1
)
select stream_id, version, seen::bigint as seen, clicked::bigint as clicked, bought::bigint as bought, fired::bigint as fired, (version + 1 - fired)::bigint as refused from r
where version = (select max(version) from st where st.stream_id = r.stream_id)""")
def store_replay_guarded(spark, d):
    moves = [("view", {}, {"seen": 1}), ("click", {"seen": 1}, {"clicked": 1}), ("purchase", {"clicked": 1}, {"bought": 1})]
    r = events.replay_guarded(store(spark, d), moves, {"seen": 0})
    return r.select("stream_id", "version", *[F.col("state")[p].alias(p) for p in ("seen", "clicked", "bought")], "fired", "refused")


# --- State maps and guards -------------------------------------------------------


def user_maps(spark: SparkSession, d: str) -> DataFrame:
    """``user_id, a, b``: values by type of even and odd events."""
    e = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value"))), 2).alias("x"), F.round(F.sum(F.when(F.col("event_id") % 2 == 1, F.col("value"))), 2).alias("y"))
    entries = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("event_type", c))))
    return e.groupBy("user_id").agg(entries("x").alias("a"), entries("y").alias("b"))


MAPS = "m as (select user_id, event_type as k, round(sum(value) filter (where event_id % 2 = 0), 2) as x, round(sum(value) filter (where event_id % 2 = 1), 2) as y from events group by all)"


@query(f"with {MAPS} select user_id, round(coalesce(sum(x), 0), 2)::double as total, count(x) filter (where x <> 0)::bigint as non_zero, coalesce(arg_max(k, x), '') as largest, round(coalesce(max(x) filter (where k = 'click'), 0), 2)::double as clicks from m group by user_id")
def state_totals(spark, d):
    m = user_maps(spark, d)
    return m.select("user_id", F.round(statemap.total("a"), 2).alias("total"), F.size(statemap.non_zero("a")).cast("long").alias("non_zero"), F.coalesce(statemap.largest("a").key, F.lit("")).alias("largest"), F.round(statemap.get("a", "click"), 2).alias("clicks"))


@query(f"with {MAPS}, d as (select user_id, k, coalesce(y, 0) as v from m where x is distinct from y), g as (select user_id, coalesce(y, x) as v from m where x is not null or y is not null), t as (select user_id, sum(v) as merged from g group by user_id) select t.user_id, count(d.k)::bigint as changed, round(coalesce(sum(d.v), 0), 2)::double as total, round(any_value(t.merged), 2)::double as merged from t left join d on d.user_id = t.user_id group by t.user_id")
def state_differences(spark, d):
    m = user_maps(spark, d).withColumn("d", statemap.difference("a", "b"))
    return m.select("user_id", F.size("d").cast("long").alias("changed"), F.round(statemap.total("d"), 2).alias("total"), F.round(statemap.total(statemap.merge("a", "b")), 2).alias("merged"))


@query(f"with {MAPS} select user_id, round(coalesce(sum(x) filter (where starts_with(k, 's')), 0), 2)::double as total, count(x) filter (where starts_with(k, 's') and x > 0)::int as places, greatest(coalesce(max(x) filter (where starts_with(k, 's')), 0), 0)::double as most from m group by user_id")
def prefix_aggregates(spark, d):
    m = user_maps(spark, d).withColumn("g", statemap.aggregates("a", "s"))
    return m.select("user_id", F.round("g.total", 2).alias("total"), F.col("g.places").alias("places"), F.col("g.most").alias("most"))


@query("select p_partkey from part where p_size % 7 = 3 or p_size > 45 and not (p_size = 50) and p_size * 2 - 1 >= 93")
def guard_parts(spark, d):
    return read(spark, d, "part").where(guard.to_column("p_size % 7 == 3 || p_size > 45 && !(p_size == 50) && p_size * 2 - 1 >= 93")).select("p_partkey")


# --- Trajectories ------------------------------------------------------------------


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Whole daily values by event type as series of one run."""
    e = read(spark, d, "events").groupBy(F.datediff("ts", F.lit("2024-01-01")).alias("step"), F.col("event_type").alias("place")).agg(F.round(F.sum("value")).alias("value"))
    return e.select(F.lit(0).cast("long").alias("run_id"), "step", F.col("step").cast("double").alias("t"), "place", "value")


DAILY = "s as (select date_diff('day', date '2024-01-01', ts::date)::int as step, event_type as place, round(sum(value)) as value from events group by 1, 2)"


@query(f"""with {DAILY}, w as (select *, lag(value) over (partition by place order by step) as p, lead(value) over (partition by place order by step) as n, min(value) over (partition by place order by step rows between unbounded preceding and 1 preceding) as l, min(value) over (partition by place order by step rows between 1 following and unbounded following) as r from s)
select place, case when value > p then 'peak' else 'trough' end as kind, step::double as t, value::double as value, case when value > p then value - greatest(l, r) end::double as prominence from w where value > p and value > n or value < p and value < n""")
def series_extrema(spark, d):
    return trajectory.extrema(daily(spark, d)).drop("run_id")


@query(f"""with {DAILY}, p as (select x.step, x.place as var1, y.place as var2, x.value as v, x.value - y.value as d from s x join s y on x.step = y.step and x.place < y.place),
w as (select *, lead(d) over o as d2, lead(v) over o as v2, lead(step) over o as t2 from p window o as (partition by var1, var2 order by step))
select var1, var2, round(step + (t2 - step) * (-d) / (d2 - d), 6)::double as t, round(v + (v2 - v) * ((t2 - step) * (-d) / (d2 - d)) / (t2 - step), 4)::double as value from w where d * d2 < 0""")
def series_crossings(spark, d):
    return trajectory.crossings(daily(spark, d)).select("var1", "var2", F.round("t", 6).alias("t"), F.round("value", 4).alias("value"))


@query(f"with {DAILY} select place, min(value)::double as min, max(value)::double as max, round(avg(value), 6)::double as mean, median(value)::double as median, round(stddev_pop(value), 6)::double as std from s group by place")
def series_statistics(spark, d):
    return trajectory.statistics(daily(spark, d)).select("place", "min", "max", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"))


@query(f"with {DAILY}, n as (select max(step) + 1 as n from s), k as (select k, floor(k * (n - 1) / 9 + 0.5)::int as step from n, range(10) t(k)) select k::int as step, step::double as t, place, value::double as value from s join k using (step)".replace("select k::int as step, step::double as t", "select k.k::int as step, s.step::double as t").replace("from s join k using (step)", "from s join k on s.step = k.step"))
def series_downsampled(spark, d):
    return trajectory.downsample(daily(spark, d), 10).drop("run_id")


@query(f"with {DAILY}, e as (select place, arg_min(value, step) as a, arg_max(value, step) as b from s group by place) select sum(a)::double as initial, sum(b)::double as final, abs(sum(b) - sum(a)) < 1e-6 as conserved from e")
def series_conservation(spark, d):
    return trajectory.conservation(daily(spark, d)).drop("run_id")


@query(f"""with {DAILY}, n as (select max(step) + 1 as n from s), c as (select place, step, abs((value - lag(value) over o) / nullif(lag(value) over o, 0)) as ch from s window o as (partition by place order by step)),
m as (select c.place, c.step, max(ch) over (partition by c.place order by step rows between 9 preceding and current row) as most from c),
f as (select place, min(step) filter (where step >= 10 and coalesce(most, 0) < 2.5) as t from m group by place)
select bool_and(t is not null) as reached, case when bool_and(t is not null) then least(min(t), (select max(step) from s))::double end as t from f""")
def series_steady(spark, d):
    return trajectory.steady_state(daily(spark, d), tolerance=2.5, duration=10.0).drop("run_id")


TIMES = "a as (select unnest([0.25, 3.5, 7.0, 12.75, 40.0]) as x)"


def _times(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, t) for t in (0.25, 3.5, 7.0, 12.75, 40.0)], "run_id long, at double")


@query(f"""with {DAILY}, {TIMES}, j as (select x, place, arg_max(value, step) filter (where step <= x) as v0, max(step) filter (where step <= x) as t0, arg_min(value, step) filter (where step > x) as v1, min(step) filter (where step > x) as t1 from a, s group by x, place)
select x::double as "at", place, round(coalesce(v0 + (v1 - v0) * (x - t0) / nullif(t1 - t0, 0), v0, v1), 6)::double as value from j""")
def series_interpolated(spark, d):
    return trajectory.interpolate(daily(spark, d), _times(spark)).select("at", "place", F.round("value", 6).alias("value"))


@query(f"with {DAILY}, {TIMES} select x::double as \"at\", place, arg_min(value, abs(step - x) * 1000 + step / 1000)::double as value from a, s group by x, place")
def series_nearest(spark, d):
    return trajectory.at_times(daily(spark, d), _times(spark)).select("at", "place", "value")


@query(f"""with {DAILY}, w as (select *, lag(value) over (partition by place order by step) as p, lead(value) over (partition by place order by step) as n from s), t as (select place, step, value from w where value > p and value > n and value > 0)
select value::double as max_peak, place as max_peak_place, step::double as max_peak_t from t order by value desc, step, place limit 1""")
def series_metrics(spark, d):
    return trajectory.metrics(daily(spark, d)).select("max_peak", "max_peak_place", "max_peak_t")


# --- Simulation and search -----------------------------------------------------------


@query("with recursive r as (select 0 as step, 100.0::double as a union all select step + 1, a + 0.01 * (-0.1 * a) from r where step < 1000) select step::int as step, round(a, 6)::double as value from r where step % 100 = 0")
def simulate_decay(spark, d):
    """Fixed steps of Euler's method on a decay."""
    net = Net().place("A", 100.0).transition("t").arc("A", "t")
    runs = spark.createDataFrame([(0, {}, {"t": 0.1}, 0.0, 10.0 - 1e-9)], search.RUNS_SQL)
    path = ode.simulate(runs, net, "euler", ode.Options(dt=0.01, adaptive=False))
    return path.where("step % 100 = 0").select("step", F.round("value", 6).alias("value"))


def _epidemic(runs: str, steps: int) -> str:
    """SQL of fixed steps of a tenth by the classical method of fourth order, for ``runs`` (run_id, beta, gamma, s, i, r)."""
    slope = lambda k, s, i: f"-beta * ({s}) * ({i}) as s{k}, beta * ({s}) * ({i}) - gamma * ({i}) as i{k}, gamma * ({i}) as r{k}"
    one = f"select *, {slope(1, 's', 'i')} from p where step < {steps}"
    two = f"select *, {slope(2, 's + 0.05 * s1', 'i + 0.05 * i1')} from ({one})"
    three = f"select *, {slope(3, 's + 0.05 * s2', 'i + 0.05 * i2')} from ({two})"
    four = f"select *, {slope(4, 's + 0.1 * s3', 'i + 0.1 * i3')} from ({three})"
    move = lambda x: f"{x} + 0.1 * ({x}1 + 2 * {x}2 + 2 * {x}3 + {x}4) / 6"
    return f"runs as ({runs}), p as (select run_id, beta, gamma, 0 as step, s, i, r from runs union all select run_id, beta, gamma, step + 1, {move('s')}, {move('i')}, {move('r')} from ({four}))"


FIXED = ode.Options(dt=0.1, adaptive=False)


@query(f"""with recursive {_epidemic("select k as run_id, 0.0003::double * (1 + k / 10.0::double) as beta, 0.1::double as gamma, 990.0::double as s, 10.0::double as i, 0.0::double as r from range(8) t(k)", 1000)},
e as (select * from p where step = 1000)
select run_id::bigint as run_id, 'S' as place, round(s, 4) as value from e union all select run_id, 'I', round(i, 4) from e union all select run_id, 'R', round(r, 4) from e""")
def simulate_sir(spark, d):
    """Fixed steps of the classical method of fourth order."""
    net, rates = templates.generate("sir")
    runs = spark.createDataFrame([(i, {}, {**rates, "infection": rates["infection"] * (1 + i / 10)}, 0.0, 100.0 - 1e-9) for i in range(8)], search.RUNS_SQL)
    return ode.final_states(ode.simulate(runs.repartition(8), net, "rk4", FIXED)).select("run_id", "place", F.round("value", 4).alias("value"))


@query(f"""with recursive {_epidemic("select k as run_id, 0.00015::double + 0.00045::double * (k // 2 % 4) / 3 as beta, 0.05::double + 0.15::double * (k // 8) / 2 as gamma, 990.0::double as s, [5.0, 20.0][k % 2 + 1]::double as i, 0.0::double as r from range(24) t(k)", 600)},
w as (select distinct case when k = 149 then 600 else floor(k * 600 / 149.0::double + 0.5)::int end as step from range(150) t(k)),
v as (select run_id, step, i, lag(i) over o as b, lead(i) over o as a from p semi join w using (step) window o as (partition by run_id order by step)),
m as (select run_id, max(i) filter (where i > b and i > a) as peak from v group by run_id)
select run_id::bigint as run_id, round(peak, 3) as score, (row_number() over (order by peak nulls last, run_id))::int as rank from m""")
def sweep_sir(spark, d):
    net, rates = templates.generate("sir")
    beta = rates["infection"]
    grid = {"infection": search.linspace(beta / 2, beta * 2, 4), "recovery": search.linspace(0.05, 0.2, 3)}
    out = search.sweep(spark, net, grid, {"I": [5.0, 20.0]}, "minimize_peak", 60.0 - 1e-9, options=FIXED, method="rk4")
    return out.select("run_id", F.round("score", 3).alias("score"), "rank")


@query(f"""with recursive {_epidemic("select k as run_id, case k when 1 then 0 else 0.0003 end::double as beta, case k when 2 then 0 else 0.1 end::double as gamma, 990.0::double as s, 10.0::double as i, 0.0::double as r from range(3) t(k)", 300)},
e as (select run_id, r - (select r from p where step = 300 and run_id = 0) as impact from p where step = 300 and run_id > 0)
select case run_id when 1 then 'infection' else 'recovery' end as transition, round(impact, 3) as impact, (row_number() over (order by abs(impact) desc))::int as rank from e""")
def sensitivity_sir(spark, d):
    net, rates = templates.generate("sir")
    s = search.Sensitivity(spark, net, search.place_scorer("R"), rates=rates, tspan=(0.0, 30.0 - 1e-9), options=FIXED, method="rk4")
    return s.knockouts().select("transition", F.round("impact", 3).alias("impact"), "rank")


@query("select id::bigint as combination, [1.0, 2.0][id % 2 + 1]::double as a, [5.0, 6.0, 7.0][id // 2 % 3 + 1]::double as b from range(6) t(id)")
def grid_combinations(spark, d):
    return search.grid(spark, {"b": [5.0, 6.0, 7.0], "a": [1.0, 2.0]}).select("combination", F.col("parameters.a").alias("a"), F.col("parameters.b").alias("b"))


@query()
def element_sensitivity(spark, d):
    net, rates = templates.generate("sir")
    return tokens.element_sensitivity(spark, net, rates).select("kind", "element", "category", "symmetric")


@query("""with v as (select date_diff('day', date '2024-01-01', ts::date)::int as t, event_type as place, round(sum(value)) as value from events group by 1, 2), e as (select x.place, x.t, x.value, coalesce(y.value, 0) as other, avg(x.value) over (partition by x.place) as m from v x join v y on x.place = y.place and x.t = y.t + 1)
select round(avg((other - value) * (other - value)), 3)::double as mse, round(sqrt(avg((other - value) * (other - value))), 3)::double as rmse from e""")
def loss_of_yesterday(spark, d):
    s = daily(spark, d).select("place", "t", "value")
    shifted = s.select("place", (F.col("t") + 1).alias("t"), "value")
    return learn.loss_table(s, shifted).select(F.round("mse", 3).alias("mse"), F.round("rmse", 3).alias("rmse"))


# --- State spaces -------------------------------------------------------------------


def ring_net() -> Net:
    """Tokens that go round three places, one of two at a time."""
    return Net().chain(4.0, "A", "ab", "B", "bc", "C").transition("ca").flow("C", "ca", "A").place("X", 0.0).inhibitor("X", "ab")


@query("""with recursive r(a, b, c) as (select 4, 0, 0 union select * from (
    select a - 1, b + 1, c from r where a >= 1 union all select a, b - 1, c + 1 from r where b >= 1 union all select a + 1, b, c - 1 from r where c >= 1))
select a::bigint as a, b::bigint as b, c::bigint as c from r""")
def reachable_markings(spark, d):
    m = statespace.explore(spark, ring_net())
    return m.select(F.get("marking", 0).alias("a"), F.get("marking", 1).alias("b"), F.get("marking", 2).alias("c"))


@query("select * from (values ('A', 'ab', -1.0), ('A', 'ca', 1.0), ('B', 'ab', 1.0), ('B', 'bc', -1.0), ('C', 'bc', 1.0), ('C', 'ca', -1.0)) t(place, transition, change)")
def incidence_ring(spark, d):
    p, t, a = ring_net().frames(spark)
    return statespace.incidence(a, p, t)


RING = "arc as (select * from (values ('A', 'ab', 'in'), ('B', 'bc', 'in'), ('C', 'ca', 'in'), ('X', 'ab', 'inhibit'), ('B', 'ab', 'out'), ('C', 'bc', 'out'), ('A', 'ca', 'out')) t(place, transition, kind)), held as (select * from (values ('A', 4), ('B', 0), ('C', 0), ('X', 0)) t(place, tokens))"


@query(f"""with {RING}, n as (select place, count(*) filter (where kind = 'out') as comes, count(*) filter (where kind <> 'out') as goes from arc group by place)
select 'info' as severity, 'deadlock' as category, transition as element, 'cannot fire at first' as message from arc join held using (place) where kind = 'in' and tokens < 1
union all select 'info', 'conservation', transition, 'takes ' || count(*) filter (where kind = 'in') || ', gives ' || count(*) filter (where kind = 'out') from arc group by transition having count(*) filter (where kind = 'in') <> count(*) filter (where kind = 'out')
union all select 'info', 'conservation', place, 'sink' from n where comes > 0 and goes = 0 union all select 'info', 'conservation', place, 'source' from n where goes > 0 and comes = 0
union all select 'warning', 'boundedness', place, 'more inputs than outputs and no capacity' from n where comes > goes""")
def validation_ring(spark, d):
    return spark.createDataFrame(statespace.validate_with_states(ring_net()), "severity string, category string, element string, message string")


@query(f"""with recursive {TALKS}, {DFG}, e as (select 'from ' || a as a, 'to ' || b as b, n::double as w from dfg), g as (select a, b, w from e union all select b, a, w from e),
p(i, node, score) as (select 0, node, 1.0::double from (select distinct a as node from g) union all select i + 1, a, sum(w * score)::double from p join g on b = node where i < 10 group by i, a)
select node, round(score / (select sqrt(sum(score * score)) from p where i = 10), 6)::double as score from p where i = 10""")
def centrality_roles(spark, d):
    dfg = footprint.directly_follows(talk_log(spark, d)).select("a", "b", F.col("n").cast("double").alias("w"))
    out = statespace.edge_centrality(dfg.select(F.concat(F.lit("from "), "a").alias("a"), F.concat(F.lit("to "), "b").alias("b"), "w"), iterations=10)
    return out.select("node", F.round("score", 6).alias("score"))


# --- Workflow -----------------------------------------------------------------------


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases."""
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    began = F.col("o_orderdate").cast("timestamp")
    days = (F.col("o_orderkey") % 40).cast("int")
    return o.select(F.col("o_orderkey").alias("case_id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).alias("priority"), began.alias("started_at"), F.when(status == "completed", F.timestamp_micros(F.unix_micros(began) + days.cast("long") * 86_400_000_000)).alias("completed_at"))


CASES = "c as (select o_orderkey as case_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status, left(o_orderpriority, 1) as priority, o_orderdate as started_at, case when o_orderstatus = 'F' then o_orderdate + to_days((o_orderkey % 40)::int) end as completed_at from orders)"
SLA = "d as (select c.*, started_at + to_days(case priority when '1' then 700 when '2' then 1400 else 2200 end) as deadline from c)"


def _with_deadlines(spark: SparkSession, d: str) -> DataFrame:
    sla = spark.createDataFrame([("1", 700 * 86400.0), ("2", 1400 * 86400.0)], "priority string, seconds double")
    return workflow.with_deadlines(cases(spark, d), sla, 2200 * 86400.0)


@query(f"with {CASES}, {SLA} select case_id, epoch_us(deadline) as deadline_us from d")
def case_deadlines(spark, d):
    return _with_deadlines(spark, d).select("case_id", F.unix_micros("deadline").alias("deadline_us"))


@query(f"with {CASES}, {SLA}, a as (select case_id, (epoch_us(timestamp '2001-01-01') - epoch_us(started_at))::double / (epoch_us(deadline) - epoch_us(started_at)) as share from d where status = 'running') select case_id, case when share >= 1 then 'breach' else 'warning' end as level, round(share, 6)::double as share from a where share >= 0.8")
def case_alerts(spark, d):
    return workflow.sla_alerts(_with_deadlines(spark, d), "2001-01-01").select("case_id", "level", F.round("share", 6).alias("share"))


@query(f"with {CASES}, t as (select *, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 as s from c) select count(*)::bigint as cases, count(*) filter (where status = 'running')::bigint as running, count(*) filter (where status = 'completed')::bigint as completed, count(*) filter (where status = 'failed')::bigint as failed, 0::bigint as cancelled, 0::bigint as suspended, round(avg(s), 3)::double as mean_s, round(quantile_cont(s, 0.5), 3)::double as p50_s, round(quantile_cont(s, 0.95), 3)::double as p95_s from t")
def case_metrics(spark, d):
    m = workflow.case_metrics(cases(spark, d))
    return m.select("cases", "running", "completed", "failed", "cancelled", "suspended", *[F.round(c, 3).alias(c) for c in ("mean_s", "p50_s", "p95_s")])


def instances(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as task instances, one per order and task, by flags and ship dates."""
    x = read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("task_id")).agg(F.min("l_shipdate").cast("timestamp").alias("ready_at"), F.max("l_shipdate").cast("timestamp").alias("end"), F.max("l_linestatus").alias("s"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("s") == "O", "ready").when(F.col("n") % 2 == 0, "failed").otherwise("completed")
    later = F.timestamp_micros(F.unix_micros("ready_at") + 3_600_000_000)
    return x.select(F.col("l_orderkey").alias("case_id"), "task_id", status.alias("status"), "ready_at", F.when(status != "ready", later).alias("started_at"), F.when(status == "completed", F.timestamp_micros(F.unix_micros("end") + 7_200_000_000)).alias("completed_at"), F.col("n").alias("attempts"))


TASKS = "i as (select l_orderkey as case_id, l_returnflag as task_id, min(l_shipdate) as ready_at, max(l_shipdate) as e, max(l_linestatus) as s, count(*) as n from lineitem group by all), t as (select case_id, task_id, n as attempts, ready_at, case when s = 'O' then 'ready' when n % 2 = 0 then 'failed' else 'completed' end as status, e from i)"


@query(f"with {TASKS} select task_id, count(*) filter (where status <> 'ready')::bigint as executions, count(*) filter (where status = 'completed')::bigint as successes, count(*) filter (where status = 'failed')::bigint as failures, sum(attempts - 1)::bigint as retries, 3600.0::double as mean_wait_s, round(avg((epoch_us(e) - epoch_us(ready_at)) / 1e6 + 3600) filter (where status = 'completed'), 3)::double as mean_work_s from t group by task_id")
def task_metrics(spark, d):
    return workflow.task_metrics(instances(spark, d)).withColumn("mean_work_s", F.round("mean_work_s", 3))


@query(f"with {TASKS}, a as (select case_id, task_id, (epoch_us(timestamp '2002-01-01') - epoch_us(ready_at)) / 1e6 / 150000000 as share from t where status = 'ready') select case_id, task_id, case when share >= 1 then 'breach' else 'warning' end as level from a where share >= 0.8")
def task_alerts(spark, d):
    sla = spark.createDataFrame([(t, 150_000_000.0) for t in "ANR"], "task_id string, sla_s double")
    return workflow.task_sla_alerts(instances(spark, d), sla, "2002-01-01").select("case_id", "task_id", "level")


@query(f"""with {TASKS}, p as (select case_id, task_id, case when task_id = 'N' then 'pending' else status end as status from t), d as (select p.case_id, count(*) as n, count(*) filter (where status = 'completed') as met from p where task_id in ('A', 'R') group by p.case_id)
select p.case_id, p.task_id from p left join d on d.case_id = p.case_id where p.status = 'pending' and (d.n is null or met = n)""")
def ready_tasks(spark, d):
    i = instances(spark, d).withColumn("status", F.when(F.col("task_id") == "N", "pending").otherwise(F.col("status")))
    deps = spark.createDataFrame([("A", "N", workflow.FS), ("R", "N", workflow.FS)], "source string, target string, kind string")
    tasks_ = spark.createDataFrame([("A", "all", 1), ("N", "all", 1), ("R", "all", 1)], "task_id string, join string, join_count int")
    return workflow.ready_tasks(i, deps, tasks_)


@query(f"with {TASKS} select case_id from t where task_id in ('A', 'R') group by case_id having bool_and(status = 'completed')")
def complete_cases(spark, d):
    return workflow.complete_cases(instances(spark, d), ["A", "R"])


RESERVED = "r as (select s_nationkey::varchar as resource_id, sum(s_acctbal) as used from supplier group by 1), k as (select n_nationkey::varchar as resource_id, 20000.0 as capacity from nation)"


@query(f"with {RESERVED} select k.resource_id, round(coalesce(used, 0), 2)::double as used, round(coalesce(used, 0) / capacity, 6)::double as utilisation from k left join r using (resource_id)")
def resource_utilisation(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("resource_id"), F.col("s_acctbal").alias("quantity"))
    k = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("resource_id"), F.lit(20000.0).alias("capacity"))
    return workflow.utilisation(s, k).select("resource_id", F.round("used", 2).alias("used"), F.round("utilisation", 6).alias("utilisation"))


@query(f"with {TASKS}, {RESERVED}, w as (select task_id as id, max((epoch_us(timestamp '2002-01-01') - epoch_us(ready_at)) / 1e6) as v from t where status = 'ready' group by 1) select 'task' as kind, id, round(v, 2)::double as value from w where v > 200000000 union all select 'resource', k.resource_id, round(used / capacity, 2)::double from k join r using (resource_id) where used / capacity > 0.9")
def workflow_bottlenecks(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("resource_id"), F.col("s_acctbal").alias("quantity"))
    k = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("resource_id"), F.lit(20000.0).alias("capacity"))
    return workflow.bottlenecks(instances(spark, d), workflow.utilisation(s, k), "2002-01-01", 200_000_000.0).withColumn("value", F.round("value", 2))


# --- Signals, charts and monitoring ---------------------------------------------------


def signals(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    payload = F.create_map(F.lit("route"), F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "even").otherwise("odd"))
    return e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("source"), F.when(F.col("event_id") % 5 == 0, "audit").alias("target"), payload.alias("payload"), F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("correlation_id"))


SIGNALS = "g as (select lpad(event_id::varchar, 12, '0') as id, event_type as type, user_id::varchar as source, case when event_id % 5 = 0 then 'audit' end as target, json_extract_string(props, '$.k')::int as k, ts from events)"


@query(f"with {SIGNALS}, b as (select * from (values ('audit', '*', 1), ('shop', 'purchase', 5), ('shop', 'click', 2)) t(actor_id, wanted, priority)) select id, actor_id, priority from g join b on (g.type = wanted or wanted = '*') and (target is null or target = actor_id)")
def signals_delivered(spark, d):
    subs = spark.createDataFrame([("audit", "*", 1), ("shop", "purchase", 5), ("shop", "click", 2)], "actor_id string, type string, priority int")
    return actors.dispatch(signals(spark, d), subs).select("id", "actor_id", "priority")


@query(f"with {SIGNALS}, n as (select *, row_number() over (partition by type, date_trunc('second', ts) order by ts, id) as n from g) select id from n where type <> 'error' or n <= 1")
def signals_throttled(spark, d):
    return actors.throttle(signals(spark, d), "error", 1).select("id")


@query(f"with {SIGNALS} select id, count(*) over (partition by source order by ts, id rows unbounded preceding)::bigint as count from g where type = 'click'")
def signals_counted(spark, d):
    return actors.counter(signals(spark, d), "click").select("id", "count")


@query(f"with {SIGNALS} select id, case when k % 2 = 0 then 'left' end as type from g where type = 'view' and k % 2 = 0")
def signals_routed(spark, d):
    return actors.route(signals(spark, d), "view", {"even": "left"}).select("id", "type")


@query(f"with {SIGNALS} select id, t.type from g, (values ('one'), ('two')) t(type) where g.type = 'signup'")
def signals_split(spark, d):
    return actors.split(signals(spark, d), "signup", ["one", "two"]).select("id", "type")


@query(f"""with recursive {SIGNALS}, o as (select *, row_number() over (partition by type, source order by ts, id) as n from g),
r as (select type, source, id, n, ts as last, true as passed from o where n = 1 union all
    select o.type, o.source, o.id, o.n, case when epoch_us(o.ts) - epoch_us(r.last) >= 86400000000 then o.ts else r.last end, epoch_us(o.ts) - epoch_us(r.last) >= 86400000000 from r join o on o.type = r.type and o.source = r.source and o.n = r.n + 1)
select id, type, source from r where passed""")
def signals_deduped(spark, d):
    return actors.dedupe(signals(spark, d), 86_400.0).select("id", "type", "source")


@query(f"with {SIGNALS}, n as (select source, id, row_number() over (partition by source order by ts, id) - 1 as n from g where type = 'click') select source, string_agg(id, ',' order by n) as ids from n group by source, n // 3 having count(*) = 3")
def signals_aggregated(spark, d):
    return actors.aggregate(signals(spark, d), "click", "batch", 3).select("source", "ids")


@query(f"with {SIGNALS} select source as key, count(*)::bigint as events, count(*) filter (where type = 'click')::bigint as moved, case when count(*) filter (where type = 'click') % 2 = 1 then 'lamp:on' else 'lamp:off' end as state from g group by source")
def statechart_lamps(spark, d):
    chart = statechart.Chart("lamp").region("lamp", "off", "on").when("click", "lamp:off", "lamp:on").when("click", "lamp:on", "lamp:off")
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), F.col("event_type").alias("event"))
    out = statechart.run_chart(e, chart)
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("moved").cast("long")).alias("moved"), F.max_by("state", "seq").alias("state"))


@query()
def monitored_talks(spark, d):
    lg = talk_log(spark, d).select("case_id", "activity", F.col("ts"), (F.col("seq") + 1).alias("seq"), F.lit("event").alias("kind"))
    starts = lg.groupBy("case_id").agg(F.lit("").alias("activity"), F.min("ts").alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"))
    rates = {"user": 0.02, "assistant": 0.05}
    out = monitor.monitor(lg.unionByName(starts), talk_net(), rates, monitor.Config(sla_s=600.0))
    return out.select("case_id", "ts", "activity", "next_activity", "alert", F.round("remaining_s", 1).alias("remaining_s"))
