import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from foliowright.session import session, ship

    s = session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def check(spark, sf):
    """Compare a query with its SQL, values and multiplicities."""
    import glob

    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")

    def rows(frame, columns):
        def cell(v):
            if v is None or v != v:
                return ""
            return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

        return sorted(tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False))

    def run(query, sql):
        ours, theirs = query(spark, sf).toPandas(), con.sql(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        assert rows(ours, columns) == rows(theirs, columns)

    return run
