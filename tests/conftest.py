import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from gradeloom.session import build_session

    s = build_session("tests", "local[4]", 4, **{"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """A value that compares equal between both engines."""
    if isinstance(value, float):
        return None if value != value else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def same_rows(spark_df, duck_rel) -> None:
    columns = sorted(spark_df.columns)
    assert sorted(duck_rel.columns) == columns
    at = [duck_rel.columns.index(c) for c in columns]
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(plain(r[c]) for c in columns) for r in spark_df.collect()), key=key)
    want = sorted((tuple(plain(r[i]) for i in at) for r in duck_rel.fetchall()), key=key)
    assert len(got) == len(want)
    assert [key(g) for g in got] == [key(w) for w in want]
