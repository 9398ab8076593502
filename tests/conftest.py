import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    s = s.config("spark.driver.memory", "4g").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp()).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.fixture
def same(spark, duck, sf_dir):
    """Holds a query's rows against those of its SQL."""

    def check(make, sql):
        from rows import comparable

        df = make(spark, sf_dir)
        names = sorted(df.columns)
        got = comparable(df.select(*[f"`{c}`" for c in names]).collect())
        e = duck.execute(sql)
        order = [x[0] for x in e.description]
        assert sorted(order) == names
        assert got == comparable([[r[order.index(c)] for c in names] for r in e.fetchall()])

    return check
