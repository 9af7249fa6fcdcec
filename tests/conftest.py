import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shipshape.session import get_session
    s = get_session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def star(spark):
    from shipshape.plans.star import build_star
    return build_star(spark, SF)


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from shipshape.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con
