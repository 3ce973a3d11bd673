import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def canon(rows):
    """Rows as sorted lists of strings, floats to nine digits."""

    def one(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in rows)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    made = {}

    def at(sf):
        if sf not in made:
            c = made[sf] = duckdb.connect()
            for f in os.listdir(f"{DATA}/{sf}"):
                c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{sf}/{f}'")
        return made[sf]

    return at


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query's rows with its SQL's, columns by name."""

    def check(query, sql, sf="sf0.001"):
        df = query(spark, f"{DATA}/{sf}")
        names = sorted(df.columns)
        rel = duck(sf).sql(sql)
        assert names == sorted(rel.columns)
        got = canon(df.select(*[f"`{c}`" for c in names]).collect())
        want = canon(rel.project(", ".join(f'"{c}"' for c in names)).fetchall())
        assert got == want

    return check
