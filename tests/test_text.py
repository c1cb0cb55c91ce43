import random
import re

from pyspark.sql import functions as F

from tenderlake.functions import lexicon as lex
from tenderlake.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def model_sentences(text):
    """The same rules, one text at a time."""
    t = re.sub(r"\s+", " ", re.sub(r"[*_`]+", "", text)).strip()
    for a in lex.ABBREVIATIONS:
        t = t.replace(a, a.replace(".", "\0"))
    t = re.sub(r"(\d)\.(\d)", "\\1\0\\2", t)
    return [p.replace("\0", ".").strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z(\[])", t) if p.strip("\0 ")]


def test_sentences_match_model(spark):
    rng = random.Random(5)
    parts = ["We met Dr. Smith. ", "It is 3.5 m. ", "Yes! ", "No? maybe. ", "(See e.g. Art. 4.) ", "**Bold** text ", "Ends here.\n\n", "[x] Next ", "Ltd. Co. "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.split_sentences(F.col("t")).alias("s"))
    assert {r["i"]: r["s"] for r in df.collect()} == {i: model_sentences(t) for i, t in enumerate(texts)}


def test_numbers_and_tolerance(spark):
    cells = ["1,234.5", "**12** %", "₹ 5", "$5", "x", "", "-3"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(T.cell_number(F.col("c")))
    assert [r[0] for r in df.collect()] == [1234.5, 12.0, 5.0, None, None, None, -3.0]
    ok = lambda a, b: one(spark, T.matches(F.col("a"), F.col("b")), a=a, b=b)
    assert ok(100.0, 102.0) and not ok(100.0, 103.0) and ok(0.0, 0.01)


def test_syllables_and_readability(spark):
    words = {"cake": 1, "table": 2, "tree": 1, "idea": 2, "rhythm": 1, "'tis'": 1, "bcd": 1}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.syllables(F.col("w")))
    assert {r[0]: r[1] for r in df.collect()} == words
    assert one(spark, T.readability(F.col("m")), m="# Title\nThe cat sat. The dog ran.") == round(206.835 - 1.015 * 7 / 2 - 84.6 * 8 / 7, 2)
    assert one(spark, T.readability(F.col("m")), m="") == 0.0


def test_templates(spark):
    df = spark.createDataFrame([("Dear {{NAME}}, {{ X }} {{Y}} {{X}}", {"NAME": "Ann", "Z": None})], "t string, v map<string,string>")
    assert df.select(T.fill_template(F.col("t"), F.col("v"))).first()[0] == "Dear Ann, [[X]] [[Y]] [[X]]"
    assert df.select(T.unfilled(F.col("t"), F.col("v"))).first()[0] == ["X", "Y"]


def test_natural_order_and_checkable(spark):
    titles = ["10 End", "2.1 Two", "2 Mid", "Annex", "2.10 Three"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").orderBy(T.natural_key(F.col("t")))
    assert [r[0] for r in df.collect()] == ["2 Mid", "2.1 Two", "2.10 Three", "10 End", "Annex"]
    flags = {"We meet ISO rules here": True, "we meet iso rules here": False, "It takes 3 days": True, "Too 3 few": False, "It is the best plan": True}
    df = spark.createDataFrame([(t,) for t in flags], "t string").select("t", T.checkable(F.col("t")))
    assert {r[0]: r[1] for r in df.collect()} == flags


def test_json_cells_and_ids(spark):
    replies = ['{"a": 1}', '```json\n{"a": 2}\n```', 'Sure: {"a": 3} ok', "none", None]
    df = spark.createDataFrame([(r,) for r in replies], "t string").select(F.try_variant_get(T.json_slice(F.col("t")), "$.a", "int"))
    assert [r[0] for r in df.collect()] == [1, 2, 3, None, None]
    df = spark.createDataFrame([(["a", "b", "c"], ["c", "a"]), ([], ["x"])], "c array<string>, k array<string>")
    assert [r[0] for r in df.select(T.fit_cells(F.col("c"), 2)).collect()] == [["a", "b"], ["", ""]]
    assert [r[0] for r in df.select(T.within(F.col("c"), F.col("k"))).collect()] == [["a", "c"], []]


def test_drafting_helpers(spark):
    d = spark.createDataFrame([(100, "```md\nintro\n## Plan\ntext\n```", "T", "REUSED"), (400, "only text", "T", "SYNTHESIZED"), (9000, None, "T", "TEMPLATE")], "n int, r string, h string, k string")
    ids = F.array(*[F.lit(i) for i in "abcde"])
    got = [tuple(r) for r in d.select(T.token_budget(F.col("n")), T.clean_reply(F.col("r"), F.col("h")), F.size(T.capped_sources(ids, F.col("k")))).collect()]
    assert got == [(400, "## Plan\ntext", 1), (1120, "## T\n\nonly text", 4), (2200, None, 0)]
