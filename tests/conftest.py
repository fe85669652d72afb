import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("vellumine-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.sql.python.filterPushdown.enabled", "true").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def same(spark, duck, sf):
    """Hold a query's rows against its SQL, columns by name, in any order."""
    def check(query, sql):
        df = query(spark, sf)
        r = duck.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(r.columns)
        at = [r.columns.index(n) for n in names]
        key = lambda row: tuple((v is None, str(v)) for v in row)
        mine = sorted(key(tuple(x[n] for n in names)) for x in df.collect())
        theirs = sorted(key(tuple(x[i] for i in at)) for x in r.fetchall())
        assert mine == theirs
    return check
