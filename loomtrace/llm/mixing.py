"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target of words: its weight's share of all words, but no more than ``max_copies`` times its own
words, with the excess dealt again by weight. A target of ``f`` times a source's words gives each of its documents
``floor(f)`` certain whole copies. The rest is a sample: with inclusion probability ``p = f - floor(f)`` a document
gets the ranking number ``(u / (1 - u)) / (p / (1 - p))`` from a reproducible uniform ``u``, and those of least rank
are taken. The sample's size is fixed in words: it is the run of least ranks whose words come nearest to what is left.
As one long document at its end can leave a gap, one document is then added or dropped, that whose words come nearest
to the gap, if that narrows it.

A source may hold a third of all rows, so no window takes a whole source. Ranks are cut into buckets of about
``rows_per_bucket`` rows; sums by bucket place each bucket, and ranks within one bucket settle the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, uniform, unused


def source_targets(sized: DataFrame, max_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: ``source, n_docs, source_size, weight, target``.

    ``sized`` has ``source`` and ``size``. Sources in code-point order, null last, take ``weights`` in turn. The level
    at which shares and caps balance is found in one pass over the sources sorted by cap to weight: a source is capped
    if its cap is at most what it would get after all earlier ones were capped.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    per = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")))
        .withColumn("cap", F.col("source_size") * max_copies)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level).withColumn("open", F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level")))
    final = F.min("open").over(everything)["level"]
    return per.withColumn("target", F.when(F.col("open").isNull(), F.col("cap").cast("double")).otherwise(final * F.col("weight"))).select("source", "n_docs", "source_size", "weight", "target")


def mix(docs: DataFrame, seed: str = "mix-1", max_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3), rows_per_bucket: int = 2000, carry: tuple[str, ...] = ()) -> DataFrame:
    """How much of every document the mix takes.

    ``docs`` has ``doc_id, text, source``; of other columns only those named in ``carry`` are read. Returns one row
    per row of ``docs``: ``doc_id, size, source, source_size, target, copies, taken`` and ``carry``. ``copies`` is 0
    to ``max_copies`` and ``taken = copies * size``.

    Null text has size 0, and a row of size 0 takes 0 words. Null source is a source of its own, the last. Null
    doc_id is an id like any other. Equal ids with different texts rank apart; rows equal in both tie, and which of
    them is taken makes no difference to the result. An empty table gives an empty result.
    """
    sized = cut(
        docs.select(
            "doc_id",
            "source",
            *carry,
            F.monotonically_increasing_id().alias("row"),
            n_words("text").alias("size"),
            uniform(seed, F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("u"),
        )
    )
    goals = (
        source_targets(sized, max_copies, weights)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("left") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("n_buckets", F.ceil(F.col("n_docs") / rows_per_bucket))
    )
    # Within a source the rank grows with u alone, so cutting u cuts the ranks in order.
    ranked = (
        sized.alias("d")
        .join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
        .select("d.*", "source_size", "target", "whole", "left", "p", F.floor(F.col("u") * F.col("n_buckets")).alias("bucket"))
        .withColumn("rank", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    )
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)).alias("base"))
    placed = ranked.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    within = Window.partitionBy("source", "bucket").orderBy("rank", "u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.col("base") + F.sum("size").over(within)
    extra = F.when((F.col("p") > 0) & (after + after - F.col("size") < 2 * F.col("left")), 1).otherwise(0)
    sampled = cut(placed.withColumn("extra", extra).select("doc_id", "source", *carry, "size", "u", "row", "source_size", "target", "whole", "left", "p", "extra"))
    gaps = sampled.groupBy("source").agg((F.max("left") - F.sum(F.col("size") * F.col("extra"))).alias("gap")).select(F.col("source").alias("s"), "gap")
    near = F.abs(F.abs("gap") - F.col("size"))
    movable = (F.col("p") > 0) & (F.col("extra") == F.when(F.col("gap") > 0, 0).otherwise(1)) & (near < F.abs("gap"))
    moved = sampled.join(gaps, F.col("source").eqNullSafe(F.col("s"))).where(movable).groupBy("source").agg(F.min(F.struct(near.alias("near"), "u", "doc_id", "row")).alias("best"))
    moved = moved.select(F.col("best.row").alias("moved_row"))
    settled = sampled.join(moved, F.col("row") == F.col("moved_row"), "left")
    flipped = F.when(F.col("moved_row").isNotNull(), 1 - F.col("extra")).otherwise(F.col("extra"))
    return settled.withColumn("copies", (F.col("whole") + flipped).cast("int")).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *carry
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row taken ``n`` times comes ``n`` times, rows not taken go.

    ``docs`` must be a stored table: rows meet their copies by their place in its scan. All columns stay as they are.
    A document without words has nothing to take; it stays once, as no weight bears on it.
    """
    row, copies, each = unused(docs, "__row", "__copies", "__each")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    counts = mix(placed, carry=(row,), **options)
    counts = counts.select(row, F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).alias(copies)).where(F.col(copies) > 0)
    return placed.join(counts, row).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
