from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lattica.oracle import SQL
from lattica.queries import QUERIES


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name in SQL:
        db = duckdb.connect()
        for p in Path(sf).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        found = db.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert _rows(df.columns, got) == _rows(names, found.fetchall())
