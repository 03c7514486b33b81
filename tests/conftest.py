import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH", "")]))
sys.path.insert(0, HERE)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pointwright.session import local_session

    session = local_session("*", 4, spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")), spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the tables at sf0.001."""
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(SMALL)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    return con
