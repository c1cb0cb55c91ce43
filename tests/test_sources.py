import io
import zipfile

import pytest
from pyspark.sql import types as t

from tenderlake.sources import readers
from tenderlake.streaming import events


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
DOCX = zipped(word__document=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Body.</w:t></w:r></w:p></w:body></w:document>')
XLSX = zipped(xl__workbook=f'<workbook {S}><sheets><sheet name="Costs"/></sheets></workbook>', xl__sharedStrings=f"<sst {S}><si><t>Item</t></si></sst>", xl__worksheets__sheet1=f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>3</v></c></row><row><c/></row></sheetData></worksheet>')


def test_documents_become_text(spark, tmp_path, rows):
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.xlsx").write_bytes(XLSX)
    texts = {r["path"][-6:]: r["text"] for r in readers.document_files(spark, [str(tmp_path)]).collect()}
    assert texts == {"a.docx": "## Scope\n\nBody.\n\n| a |  |", "b.xlsx": "## Costs\n| Item | 3 |"}


def test_text_and_json(spark, tmp_path, rows):
    (tmp_path / "x.md").write_text("# T\nbody")
    assert rows(readers.text_files(spark, [str(tmp_path / "x.md")]), "file_name", "text") == [("x.md", "# T\nbody")]
    (tmp_path / "y.csv").write_text("1")
    with pytest.raises(Exception, match="unsupported document"):
        readers.text_files(spark, [str(tmp_path / "y.csv")]).collect()
    (tmp_path / "l.json").write_text('[{"id": "a"}, {"id": "b", "n": 1}]')
    (tmp_path / "o.json").write_text('{"name": "x", "items": [{"id": "c"}]}')
    schema = t.StructType().add("id", "string").add("n", "integer")
    got = readers.json_records(spark, [str(tmp_path / "l.json"), str(tmp_path / "o.json")], schema)
    assert rows(got, "id", "n") == [("a", None), ("b", 1), ("c", None)]


def test_forbidden_folder(spark):
    ok = spark.createDataFrame([("/data/knowledge_base/a.md",)], "path string")
    assert readers.allowed(ok).count() == 1
    with pytest.raises(Exception, match="forbidden folder"):
        readers.allowed(spark.createDataFrame([("/data/eval/a.md",)], "path string")).collect()


def test_streams(spark, tmp_path, rows):
    source = str(tmp_path / "in")
    spark.sql("SELECT id event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 30) ts, id % 2 user_id, 'view' event_type, 1.5D value FROM range(20)").unionByName(spark.sql("SELECT 0L event_id, timestamp'2024-01-01 00:00:00' ts, 0L user_id, 'view' event_type, 1.5D value")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    for name, query, mode in (("counts", events.windowed_counts(events.once(stream)), "complete"), ("raw", events.windowed_counts(stream), "append"), ("busy", events.busy_users(stream, 60, 5), "update")):
        q = query.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert rows(spark.table("counts"), "n") == [(10,), (10,)]
    assert spark.table("busy").where("n < 5").count() == 0
