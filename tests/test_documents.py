import random
import re

from pyspark.sql import functions as F

from tenderlake.operators import assurance, chunking, profile, render, structure
from tenderlake.operators import requirements as req


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc int, text string, body string")


def test_headings_and_parents(spark, rows):
    text = "before\n# A Plan\nx\n### 1.2 Deep\n\ny\n## Mid\n# Last"
    nodes = structure.headings(docs(spark, text, "no heads. at all.", None, "# Only"), ["doc"], "text")
    got = rows(nodes, "doc", "node_ord", "level", "title", "numbering", "parent_ord")
    assert got == sorted([(0, 0, 0, "before", None, None), (0, 1, 1, "Plan", "A", 0), (0, 2, 3, "Deep", "1.2", 1), (0, 3, 2, "Mid", None, 1), (0, 4, 1, "Last", None, 0), (1, 0, 1, "Untitled section", None, None), (3, 0, 1, "Only", None, None)], key=str)


def test_tables_totals_percent_and_durations(spark, rows):
    text = "| P | V |\n|---|---|\n| a | 10 |\n| b | 1,020 |\n| c (10%) | 50 |\n| **TOTAL** | **2000** |\ntext\n| P | Weeks |\n| x | 40 |\n| y | 32 |\n\nThe work runs for 34 months. It runs for 16.6 months."
    d = docs(spark, text, "| only |", "")
    cells = structure.table_cells(d, ["doc"], "text")
    assert cells.where("table_ix = 1").count() == 6
    assert rows(assurance.table_totals(cells, ["doc"]), "table_ix", "computed", "stated") == [(0, 1080.0, 2000.0)]
    assert rows(assurance.percentage_rows(cells, ["doc"]), "expected", "stated") == [(103.0, 50.0)]
    assert [(round(a, 1), b) for a, b in rows(assurance.durations(d, cells, ["doc"], ["doc"], "text"), "implied_months", "stated_months")] == [(16.6, 34.0)]


def test_claims_leave_scaffolding_out(spark, rows):
    text = "# Head\nFirst one. Second one.\n```\ncode here\n```\n- item one\n| H | I |\n|---|---|\n| a | b |\n\n1. last"
    claims = structure.claim_sentences(docs(spark, text), ["doc"], "text")
    assert rows(claims, "ix", "sentence") == [(0, "First one."), (1, "Second one."), (2, "item one"), (3, "| a | b |"), (4, "last")]
    records = spark.createDataFrame([(0, 0), (0, 1), (0, 3)], "doc int, sentence_index int")
    assert rows(assurance.completeness(claims, records, ["doc"])) == [(0, 5, 3, False, 0.6)]


def test_risks_facts_and_conflicts(spark, rows):
    d = docs(spark, "We guarantee it. We guarantee results subject to audit. 100% uptime and 5 % off, Zero bugs, zero bugs.", None)
    assert rows(assurance.risks(d, ["doc"], "text"), "label", "phrase") == [("absolute performance claim", "100% uptime"), ("absolute quality claim", "zero bugs"), ("unqualified guarantee", "we guarantee")]
    assert rows(assurance.facts(d, ["doc"], "text"), "kind", "value") == [("percentage", 100.0), ("percentage", 5.0)]
    v = spark.createDataFrame([("k", 1), ("k", 2), ("m", 1), ("m", 1), ("n", None)], "k string, v int")
    assert rows(assurance.conflicts(v, ["k"], "v")) == [("k", 2, [1, 2])]


def test_tracked_quantities_and_failures(spark, rows):
    said = [("r", "a", "Peak strength of **12** FTE. The work runs for 1,2 months."), ("r", "b", "A peak team of 14 FTE, 12 FTEs at peak."), ("s", "c", "It lasts 5 months"), ("s", "d", None)]
    d = spark.createDataFrame(said, "run string, id string, text string")
    assert rows(assurance.tracked_conflicts(d, ["run"], "id", "text")) == [("r", "peak FTE", 2, [12.0, 14.0], ["a", "b"])]
    risks = assurance.risks(spark.createDataFrame([("a", "We guarantee it."), ("e", "We guarantee it, no exceptions."), ("f", "No exceptions.")], "id string, text string"), ["id"], "text")
    clash = spark.createDataFrame([("a", "ENTITY_VALUE", "peak")], "id string, kind string, detail string")
    assert rows(assurance.failures(clash, risks, ["id"])) == [("a", "ENTITY_VALUE: peak"), ("e", "risk language: unqualified guarantee we guarantee")]
    v = spark.createDataFrame([("r", True), ("r", False), ("r", None), ("s", False)], "run string, bad boolean")
    assert rows(assurance.grounded_rate(v, ["run"], "bad")) == [("r", 66.7), ("s", 100.0)]


def test_batches_get_their_sources(spark, rows):
    said = spark.createDataFrame([(1, i, f"All {i} checks are done here.") for i in range(9)] + [(2, 0, "Every test is done twice.")], "doc int, ix int, sentence string")
    cited = spark.createDataFrame([(1, ["kb-2 ", None, "KB-1", "none"])], "doc int, ids array<string>")
    chunks = spark.createDataFrame([("1", "KB-1", "one"), ("2", "kb-2", "two"), ("3", "KB-2", "later")], "id string, source_id string, text string")
    got = assurance.with_sources(assurance.grounding_batches(said, ["doc"], ["ix"]), cited, ["doc"], "ids", chunks)
    assert [(r["doc"], r["batch_no"], len(r["sentences"]), r["sources"]) for r in got.orderBy("doc", "batch_no").collect()] == [(1, 0, 8, ["two", "one"]), (1, 1, 1, ["two", "one"]), (2, 0, 1, [])]


def test_templates_and_corpus(spark, rows):
    files = spark.createDataFrame([("tmpl_cover", "\n# Cover letter \nDear"), ("note", "plain"), ("blank", " \n"), ("none", None)], "stem string, text string")
    t = chunking.template_chunks(files)
    assert rows(t, "id", "title") == [("TMPL-cover", "Cover letter"), ("TMPL-note", "note")]
    assert rows(chunking.corpus([t, t.limit(1)]).groupBy("n_same").count()) == [(1, 1), (2, 2)]


def packed_model(text, most, overlap):
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    parts, buf = [], ""
    for para in re.split(r"\n\s*\n", text):
        if len(buf) + len(para) + 2 <= most:
            buf = f"{buf}\n\n{para}".strip()
        elif buf:
            parts.append(buf)
            buf = (buf[-overlap:] + "\n\n" + para).strip()
        else:
            parts += [para[i : i + most] for i in range(0, len(para), most - overlap)]
    return [p for p in [*parts, buf] if p.strip()]


def test_packing_matches_model(spark):
    rng = random.Random(3)
    texts = ["\n\n".join("ab c"[rng.randint(0, 2) :] * rng.randint(0, 60) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking._packed(F.col("t"), 100, 20).alias("p"))
    assert {r["i"]: r["p"] for r in df.collect()} == {i: packed_model(t, 100, 20) for i, t in enumerate(texts)}


def test_chunks_keep_headings(spark, rows):
    text = "# Doc\nintro\n\n## One\n" + "a " * 200 + "\n\n## Two\nshort\n"
    got = rows(chunking.markdown_chunks(docs(spark, text, None, ""), "doc", "text"), "chunk_no", "title")
    assert got == [(0, "Doc — Doc")]
    assert "short" in chunking.markdown_chunks(docs(spark, text), "doc", "text").first()["text"]


def test_requirements_of_a_document(spark, rows):
    text = "# 1 Mandatory Requirements\n**R-001**: The vendor shall keep all logs safe.\n**R-002**: Price list for each item group.\nThe vendor SHALL keep logs safe, all.\nEnd here.\n\n| R-010 | Hosting must be in the country | 10 |\n\n# Submission\nSubmit three references with the offer. Deadline: 30 April at noon sharp. Nothing here matters to us."
    found = req.extract(structure.headings(docs(spark, text), ["doc"], "text"), ["doc"])
    got = {r["text"]: r for r in found.collect()}
    assert got["The vendor shall keep all logs safe."]["priority"] == "MANDATORY" and got["The vendor shall keep all logs safe."]["n_found"] == 2
    assert got["Price list for each item group."]["priority"] == "MANDATORY" and got["Price list for each item group."]["deliverable_form"] == "COSTING"
    assert got["Hosting must be in the country"]["cue_evidence"] == "table row R-010"
    assert got["Submit three references with the offer."]["req_type"] == "SUBMISSION_RULE"
    assert "Nothing here matters to us." not in got
    assert sorted(r["id"] for r in got.values()) == [f"R-{i:03d}" for i in range(1, len(got) + 1)]


def test_profile_of_a_document(spark, rows):
    text = "# Submission\nSend two copies by post today. Send two copies by post, today! Late offers will be rejected.\n# Evaluation\n| Criterion | Weight |\n|---|---|\n| Price | 40 % |\n| Quality | high |\n| R-001 | 10 points |\n| price | 50% |\n# Terms\nThe uptime must be high enough. The CIO and the Head of data and the cio decide.\n| Other | none |\n| Speed | 15 pts |"
    nodes = structure.headings(docs(spark, text, None, ""), ["doc"], "text")
    assert rows(profile.rules(nodes, ["doc"]), "kind", "place", "sentence") == sorted([("submission", 1, "Send two copies by post today."), ("submission", 2, "Late offers will be rejected."), ("constraint", 1, "The uptime must be high enough."), ("red_line", 1, "Late offers will be rejected.")], key=str)
    assert rows(profile.criteria(nodes, ["doc"]), "place", "name", "weight") == [(1, "Price", 40.0), (2, "Quality", None), (3, "Speed", 15.0)]
    assert [r[1] for r in rows(profile.roles(docs(spark, text), ["doc"], "text"), "place", "role")][0] == "CIO"


def test_markers(spark):
    d = docs(spark, "One fact. One fact here too.", "none")
    records = spark.createDataFrame([(0, "One fact here too.", "REUSED", ["KB-1"]), (0, "", "X", [])], "doc int, sentence string, kind string, source_ids array<string>")
    assert {r["doc"]: r["text"] for r in render.with_markers(d, records, ["doc"], "text").collect()} == {0: "One fact. One fact here too. [REUSED(KB-1)]", 1: "none"}
