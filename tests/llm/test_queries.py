"""The registered queries on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

from tenderlake.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from compare import rows as plain  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["id", "defect"],
    "p2_found": ["id_a", "id_b"],
    "p3_found": ["tbl", "run_id", "item_id"],
    "p4_found": ["id_a", "id_b"],
    "p8_found": ["doc_id", "seg_no", "lang"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    ours = df.toPandas()
    assert len(ours)
    if name.endswith("_found"):
        assert not ours.duplicated().any() and not ours.isna().any().any()
    if name in queries.SQL:
        con = duckdb.connect()
        for path in Path(FOLDER).glob("*.parquet"):
            con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        assert plain(ours) == plain(con.sql(queries.SQL[name]).df())


def test_mix_report_adds_up(spark):
    r = queries.p7_shares(spark, FOLDER).toPandas()
    assert abs(r["actual_share"].sum() - 1) < 1e-9 and (r["most_copies"] <= r["max_repeats"]).all()
