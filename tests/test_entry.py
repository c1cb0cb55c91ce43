"""All core queries against their SQL on the smallest tables, and the entry points."""

import importlib
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tenderlake import session

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from compare import rows as plain  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CORE = {name: (query, module.SQL.get(name)) for module in map(importlib.import_module, entry.CORE) for name, query in module.QUERIES.items()}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, db, name):
    query, sql = CORE[name]
    ours = query(spark, FOLDER).toPandas()
    if sql:
        theirs = db.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert plain(ours) == plain(theirs)


def test_entry_points(spark):
    assert entry.entry(spark).columns == ["tbl", "run_id", "rec_id", "ref_id", "period"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stages_are_dropped(spark):
    df = session.stage(spark.range(3).toDF("x"), "try")
    assert df.count() == 3 and session.stage(spark.range(0).toDF("x"), "none").count() == 0
    assert session.drop_stages(spark) >= 2 and not session._STAGES


def test_kept_stages_are_written_once(spark):
    built = []
    get = lambda: session.kept(spark, "once", "somewhere", lambda: built.append(1) or spark.range(4).toDF("x"))
    assert get().count() == get().count() == 4 and built == [1]
    session.drop_stages(spark)
    assert get().count() == 4 and built == [1, 1]
    session.drop_stages(spark)


def test_clusters_need_a_shared_folder(monkeypatch):
    class Bare:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "local-cluster[3,2,3000]"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Bare)
