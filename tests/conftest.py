import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(rows, columns):
    """Rows as sorted tuples of comparable values."""

    def value(v):
        if v is None or v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return v
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return v if isinstance(v, int) else str(v)

    return sorted((tuple(value(r[c]) for c in columns) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(spark_df, duck_relation):
        columns = sorted(spark_df.columns)
        assert columns == sorted(duck_relation.columns)
        names = duck_relation.columns
        ours = plain([r.asDict() for r in spark_df.collect()], columns)
        theirs = plain([dict(zip(names, r)) for r in duck_relation.fetchall()], columns)
        assert ours == theirs

    return check
