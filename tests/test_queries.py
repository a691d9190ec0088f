"""Every query runs over the smallest tables and equals its SQL where it has one."""

import pytest

from loomtrace import model_queries, queries  # noqa: F401 - registers its queries

DIR = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR).toPandas()
    if name in queries.ORACLE_SQL:
        want = duck.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
