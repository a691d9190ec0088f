"""The directly-follows relation and the footprint of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import in_case

CAUSAL, REVERSE, PARALLEL, CHOICE = "causal", "reverse", "parallel", "choice"
#: Signs of the text matrix.
SIGNS = {CAUSAL: "->", REVERSE: "<-", PARALLEL: "||", CHOICE: "#"}


def directly_follows(log: DataFrame) -> DataFrame:
    """``a, b, n``: how often an event of ``b`` comes next after one of ``a`` in a case."""
    pairs = log.select(F.col("activity").alias("a"), F.lead("activity").over(in_case()).alias("b"))
    return pairs.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _ends(log: DataFrame, pick) -> DataFrame:
    return log.groupBy("case_id").agg(pick("activity", F.struct("ts", "seq")).alias("activity")).groupBy("activity").agg(F.count(F.lit(1)).alias("cases"))


def start_activities(log: DataFrame) -> DataFrame:
    """``activity, cases`` of first events."""
    return _ends(log, F.min_by)


def end_activities(log: DataFrame) -> DataFrame:
    """``activity, cases`` of last events."""
    return _ends(log, F.max_by)


def footprint(dfg: DataFrame, activities: DataFrame) -> DataFrame:
    """``a, b, ab, ba, relation`` for all pairs of activities.

    The number of activities bounds both sides of the product, and Spark sends a side only if it is small.
    """
    a, b = activities.select(F.col("activity").alias("a")), activities.select(F.col("activity").alias("b"))
    back = dfg.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("ba"))
    every = a.crossJoin(b).join(dfg.withColumnRenamed("n", "ab"), ["a", "b"], "left").join(back, ["a", "b"], "left")
    every = every.withColumn("ab", F.coalesce("ab", F.lit(0))).withColumn("ba", F.coalesce("ba", F.lit(0)))
    relation = F.when((F.col("ab") > 0) & (F.col("ba") > 0), PARALLEL).when(F.col("ab") > 0, CAUSAL).when(F.col("ba") > 0, REVERSE).otherwise(CHOICE)
    return every.withColumn("relation", relation)


def neighbours(dfg: DataFrame, causal: bool = False) -> DataFrame:
    """``activity, successors, predecessors`` as sorted arrays; with ``causal`` only those without the reverse pair."""
    edges = dfg.select("a", "b")
    if causal:
        edges = edges.join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    after = edges.groupBy(F.col("a").alias("activity")).agg(F.sort_array(F.collect_set("b")).alias("successors"))
    before = edges.groupBy(F.col("b").alias("activity")).agg(F.sort_array(F.collect_set("a")).alias("predecessors"))
    empty = F.array().cast("array<string>")
    return after.join(before, "activity", "full").select("activity", F.coalesce("successors", empty).alias("successors"), F.coalesce("predecessors", empty).alias("predecessors"))


def unrelated(pairs: DataFrame, members: list[str]) -> bool:
    """Whether all pairs of different members are in choice; one member alone always is."""
    return not pairs.where(F.col("a").isin(members) & F.col("b").isin(members) & (F.col("a") < F.col("b")) & (F.col("relation") != CHOICE)).head(1)


def causally_connected(pairs: DataFrame, left: list[str], right: list[str]) -> bool:
    """Whether every member of ``left`` is causal to every one of ``right``."""
    return pairs.where(F.col("a").isin(left) & F.col("b").isin(right) & (F.col("relation") == CAUSAL)).count() == len(set(left)) * len(set(right))


def matrix(pairs: DataFrame) -> DataFrame:
    """The footprint as a table of signs, one column per activity, names cut to four bytes in the first column."""
    sign = F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv])[F.col("relation")]
    table = pairs.withColumn("sign", sign).groupBy("a").pivot("b").agg(F.first("sign"))
    return table.withColumn("a", F.substring("a", 1, 4)).orderBy("a")
