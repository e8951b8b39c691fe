"""Every registered query of the annotation engine against its SQL in DuckDB."""
import math

import duckdb
import pytest

from glossa import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return tuple(map(plain, x)) if isinstance(x, list) else x


@pytest.mark.parametrize("name", [n for n in registry.available() if registry.get(n).sql])
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    q = registry.get(name)
    df = q.run(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    rel = duck.sql(q.oracle())
    assert sorted(rel.columns) == columns
    theirs = sorted((tuple(map(plain, r)) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert ours == theirs


def test_unknown_query_is_an_error():
    with pytest.raises(KeyError):
        registry.get("no_such_query")
