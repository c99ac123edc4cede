import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from evidex.session import get_spark

    return get_spark("tests", "4")


@pytest.fixture
def rows():
    """Sorted tuples of a frame."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is not None, 0 if x is None else x) for x in t))


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compares a query with its SQL over the tables of a folder: names of columns and all values, in any order."""
    import duckdb

    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        if isinstance(x, bool) or not hasattr(x, "__float__") and not isinstance(x, (int, float)):
            return str(x)
        return f"{float(x):.6f}"

    def check(query, sql, folder):
        con = duckdb.connect()
        for path in Path(folder).glob("*.parquet"):
            con.execute(f"create view {path.stem} as select * from '{path}'")
        found = query(spark, str(folder))
        wanted = con.execute(sql)
        names = [c[0] for c in wanted.description]
        assert sorted(found.columns) == sorted(names)
        got = sorted(tuple(map(plain, r)) for r in found.select(*sorted(names)).collect())
        want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in wanted.fetchall())
        assert got == want

    return check
