import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    out = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(x):
    """A value without the types that an engine gave it."""
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if x != x else float(f"{x:.9g}") + 0.0
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def same(df, con, sql):
    """The same columns and rows from a DataFrame and from SQL."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    floats = lambda found: [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in found]
    assert floats(rows(df.columns, df.collect())) == floats(rows(names, cursor.fetchall()))
