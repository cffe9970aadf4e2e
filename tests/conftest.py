import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellweft.session import local_session  # noqa: E402

DATA = os.environ.get("CELLWEFT_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("CELLWEFT_DRIVER_MEMORY", "4g")
    s = local_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(data_dir):
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{data_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def same_rows(df, duck, sql):
    """Asserts that a DataFrame and a SQL text give the same rows."""
    import math

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return v

    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(sql)
    names = [x[0] for x in res.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted(names) == cols
    assert got == want
