import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern.session import session

    s = session("local[4]", **{"spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def compare(spark, sf_dir):
    """Runs a query and its SQL over the same tables and compares the rows, in any order."""
    import duckdb

    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")

    def rows(frame, columns):
        def plain(v):
            if isinstance(v, float):
                return f"{v:.9g}"
            return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

        return sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))

    def check(query, sql):
        got, want = query(spark, sf_dir).toPandas(), db.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)

    return check
