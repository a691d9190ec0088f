"""Queries with SQL against DuckDB, over the smallest tables."""

import zlib

import pytest

from loomtrace.llm import queries

DIR = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR).toPandas()
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]


def test_crc_of_texts(spark, duck):
    got = queries.op6_feistel_shards(spark, DIR).toPandas()
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    assert [zlib.crc32((texts[d] or "").encode()) for d in got.doc_id] == got.text_crc32.tolist()
