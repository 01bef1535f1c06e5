import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))

from flankline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    db = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        pattern = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{pattern}'")
    return db


def same(df, db, sql):
    """Rows of a DataFrame and of SQL are equal, whatever their order."""

    def key(row):
        return tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)

    names = sorted(df.columns)
    got = sorted(key(r) for r in df.select(*(f"`{c}`" for c in names)).collect())
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    want = sorted(key([row[i] for i in at]) for row in result.fetchall())
    assert got == want
    return len(got)
