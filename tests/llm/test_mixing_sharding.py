import numpy as np
from pyspark.sql import functions as F

from loomtrace.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string"


def test_permutation_is_one():
    for n in (1, 2, 3, 24, 1000, 4097):
        assert sorted(sharding.permute(np.arange(n), n, 7).tolist()) == list(range(n))


def test_shards_with_nulls_and_repeats(spark):
    rows = [(None, None, None, "x")] * 3 + [(i // 2, "t", "s", None) for i in range(47)]
    docs = spark.createDataFrame(rows, SCHEMA)  # "size" and later "shard" clash with nothing kept
    got = sharding.deal(docs.withColumn("shard", F.lit("old")), ["doc_id"], 24).collect()
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 50 and set(counts) == set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert sharding.deal(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0


def test_mix_targets_and_caps(spark):
    rows = [(i, "w " * (1 + i % 17), "ab"[i % 7 == 0], None) for i in range(700)] + [(None, None, None, None), (5, "", "a", "9"), (5, "", "a", "9")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).drop("size")).toPandas()
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).drop("size")).toPandas()
    assert len(got) == 703
    key = ["doc_id", "size", "taken", "target"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 17
    total = got.groupby("source", dropna=False).target.first().sum()
    assert abs(total - got["size"].sum()) < 1e-6
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mixed_documents_repeat_rows(spark, tmp_path):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 3 == 0], str(i)) for i in range(90)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert counts == {k: v for k, v in copies.items() if v}
