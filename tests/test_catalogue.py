import glob
import os

import duckdb
import pytest

from ragmill import catalogue


def values(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, data, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    if name in catalogue.SQL:
        db = duckdb.connect()
        for path in glob.glob(f"{data}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        assert values(got) == values(db.execute(catalogue.SQL[name]).df())


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
