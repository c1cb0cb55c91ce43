from datetime import datetime

from tenderlake.operators import integrity as op

T = lambda day: datetime(2024, 3, day)
REF = "tbl string, run_id string, rec_id string, target string, scope string, ref_id string, loaded_at timestamp, ref_no int"
KEY = "target string, scope string, ref_id string, loaded_at timestamp, there int"
GONE = "target string, scope string, ref_id string, removed_at timestamp"


def test_missing_late_and_removed(spark, rows):
    refs = spark.createDataFrame([("a", "", "1", "t", "", k, T(10), 0) for k in ("OK", "NONE", "LATE", "GONE", "LATER", "SAME")], REF)
    keys = spark.createDataFrame([("t", "", "OK", T(1), 1), ("t", "", "LATE", T(11), 1), ("t", "", "LATE", T(12), 1), ("t", "", "GONE", T(1), 1), ("t", "", "LATER", T(1), 1), ("t", "", "SAME", T(10), 1), ("u", "", "NONE", T(1), 1)], KEY)
    gone = spark.createDataFrame([("t", "", "GONE", T(10)), ("t", "", "GONE", T(20)), ("t", "", "LATER", T(11))], GONE)
    found = op.orphan_references(refs, keys, gone)
    assert rows(found, "ref_id", "period") == [("GONE", "2024-03"), ("LATE", "2024-03"), ("NONE", "2024-03")]
    assert rows(op.orphan_counts(found), "tbl", "n_orphans", "n_records") == [("a", 3, 1)]


def test_nulls_repeats_and_empty_tables(spark, rows):
    refs = spark.createDataFrame([("a", None, "1", "t", None, "X", T(1), 0)] * 3 + [("a", "", "2", "t", "", None, T(1), 0), ("a", "", "3", "t", "", "", T(1), 0), ("a", "", "4", "t", "", "Y", None, 0)], REF)
    none = spark.createDataFrame([], KEY), spark.createDataFrame([], GONE)
    assert rows(op.orphan_references(refs, *none), "rec_id", "ref_id", "period") == [("1", "X", "2024-03"), ("4", "Y", None)]
    assert rows(op.orphan_references(spark.createDataFrame([], REF), *none)) == []


def test_hot_key_is_found_whole(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_REFERENCES", 100)
    refs = spark.range(3000).selectExpr("'a' tbl", "'' run_id", "string(id) rec_id", "'t' target", "'' scope", "if(id % 3 = 0, 'HOT', string(id)) ref_id", "timestamp'2024-03-10' loaded_at")
    keys = spark.range(3000).where("id % 2 = 0").selectExpr("'t' target", "'' scope", "string(id) ref_id", "timestamp'2024-03-01' loaded_at")
    found = op.orphan_references(refs, keys, spark.createDataFrame([], GONE))
    assert found.where("ref_id = 'HOT'").count() == 1000 and found.where("ref_id <> 'HOT'").count() == 1000


def test_json_lists(spark, rows):
    texts = ['["a", null, " B "]', "['a']", '["a"', "n/a", "", None, '{"a":1}', '["a"] x', "[]"]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(op.json_ids(F.col("j"))).collect()] == [["a", None, " B "], None, None, None, None, None, None, None, []]
    assert [r[0] for r in spark.createDataFrame([(" pp-1\n",), ("  ",), (None,)], "r string").select(op.clean_ref(F.col("r"))).collect()] == ["PP-1", None, None]
