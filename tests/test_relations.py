import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.operators import matching, measures, render, retrieval
from tenderlake.plans import relations
from tenderlake.sources import store


@pytest.mark.parametrize("heavy", [100_000, 2])
def test_bm25_matches_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(retrieval, "HEAVY", heavy)
    texts = {1: "red fox red", 2: "blue fox", 3: "red hen in the pen", 4: "", 5: None, 6: "green tree by the sea"}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    q = spark.createDataFrame([("q", "red red hen"), ("none", "zzz")], "query_id string, query string")
    post = retrieval.postings(docs, "id", "text").cache()
    counts = retrieval.term_counts(post)
    got = {r["id"]: r["score"] for r in retrieval.bm25(post, counts, docs.count(), "id", q, "query_id", "query").collect()}
    share = retrieval.word_share(post, counts, "id", q, "query_id", "query")
    assert {r["id"]: r["score"] for r in share.collect()} == {1: 0.5, 3: 1.0}
    again = retrieval.reranked(share, q, docs, "query_id", "id", "query", "text", 5).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in again] == [(3, 0.666667), (1, 0.333333)]
    toks = {i: (t or "").split() for i, t in texts.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in Counter(w for t in toks.values() for w in set(t)).items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    want = {}
    for i, t in toks.items():
        s = sum((idf[w] if idf[w] >= 0 else floor) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in "red red hen".split())
        if s > 0:
            want[i] = round(s, 6)
    assert got == want


def test_dense_top_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<float>")
    got = retrieval.dense_top(df, "id", "v", df.where("id % 10 = 0"), 3).orderBy("query_id", "rank").collect()
    v = v.astype(np.float32).astype(np.float64)
    want = [(q, i) for q in range(0, 60, 10) for i in sorted((i for i in range(60) if i != q), key=lambda i: (-round(float(v[q] @ v[i]), 6), i))[:3]]
    assert [(r["query_id"], r["id"]) for r in got] == want


def test_background_takes_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIR_BLOCK", 7)
    v = np.random.default_rng(6).normal(size=(60, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    got = retrieval.percentiles(retrieval.pair_scores(df, "id", "v"), "score", "n").first()
    s = np.round((v @ v.T)[np.triu_indices(60, 1)], 6)
    assert got["n_pairs"] == 60 * 59 // 2 == len(s)
    assert np.allclose([got[c] for c in ("low", "median", "p90", "adapt_min", "reuse_min", "high")], [s.min(), *np.percentile(s, [50, 90, 97, 99.5]), s.max()], atol=6e-5)


def test_fusion_quality_and_budget(spark, rows):
    r = lambda *x: spark.createDataFrame([("q", i, k) for k, i in enumerate(x, 1)], "q string, id string, rank int")
    fused = retrieval.fuse([r("a", "b"), r("b", "c")], "q", "id")
    assert [x[0] for x in fused.orderBy("rank").select("id").collect()] == ["b", "a", "c"]
    wanted = spark.createDataFrame([("q", "b"), ("q", "c"), ("z", "a")], "q string, id string")
    got = {x["q"]: x for x in retrieval.query_quality(r("a", "b", "c"), wanted, "q", "id").collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got["q"]["recall_1"] == 0 and got["q"]["reciprocal_rank"] == 0.5 and abs(got["q"]["ndcg"] - (1 / math.log2(3) + 0.5) / ideal) < 1e-6
    assert got["z"]["recall_k"] == 0
    packs = retrieval.context_budget(r("x" * 9, "y" * 9, "z" * 9), "q", "id", budget=12, snippet=8)
    assert [x[0] for x in packs.orderBy("rank").select("used").collect()] == [8, 4, 0]


def test_proofs_and_compliance(spark, rows):
    reqs = spark.createDataFrame([("r", "R-1", "Cloud backup recovery plan"), ("r", "R-2", "alpaca wool"), ("r", "R-3", None)], "run_id string, id string, text string")
    proofs = spark.createDataFrame([("P1", "cloud backup", "done", None, ["recovery-plan"], "Strong "), ("P2", "cloud", None, "", None, None)], "id string, claim string, evidence string, verifiable_source string, covers_tags array<string>, strength string")
    got = {r["id"]: r for r in matching.match_proofs(reqs, proofs, ["run_id", "id"]).collect()}
    assert got["R-1"]["fit"] == "STRONG" and got["R-1"]["proof_ids"] == ["P1"] and got["R-1"]["best_score"] == round(0.6 * 0.5 + 0.4 * 0.5, 4)
    assert got["R-2"]["fit"] == got["R-3"]["fit"] == "GAP"
    placed = spark.createDataFrame([("r", "R-1", "S-1"), ("r", "R-2", "S-2")], "run_id string, requirement_id string, section_id string")
    sections = spark.createDataFrame([("r", "S-1", "Intro.\n\nThe cloud backup plan.", 1)], "run_id string, id string, content_md string, w int")
    assert rows(matching.compliance(placed, reqs, sections), "requirement_id", "section_id", "anchor", "rag") == [("R-1", "S-1", "S-1#p2", "GREEN"), ("R-2", None, None, "RED"), ("R-3", None, None, "RED")]


def test_every_requirement_is_matched(spark, rows, monkeypatch):
    monkeypatch.setattr(matching, "ASKED_BLOCK", 3)
    monkeypatch.setattr(matching, "PROOF_BLOCK", 4)
    spark_rows = relations.proof_matches_all(spark, "/root/testdata/sf0.001").select("run_id", "id").collect()
    wanted = spark.read.parquet("/root/testdata/sf0.001/requirements.parquet").select("run_id", "id").distinct()
    assert len(spark_rows) == wanted.count() and "% 50" not in relations.SQL["proof_matches_all"]
    rng = random.Random(5)
    names = [f"word{i}" for i in range(12)]
    reqs = [(f"r{i % 7}", f"R-{i:03d}", " ".join(rng.sample(names, rng.randint(1, 5)))) for i in range(40)]
    proofs = [(f"P{i:02d}", " ".join(rng.sample(names, 4)), None, None, rng.sample(names, 2), rng.choice(["strong", "weak", None])) for i in range(30)]
    got = matching.match_proofs(spark.createDataFrame(reqs, "run_id string, id string, text string"), spark.createDataFrame(proofs, "id string, claim string, evidence string, verifiable_source string, covers_tags array<string>, strength string"), ["run_id", "id"])
    want = []
    for run, i, text in reqs:
        w = set(text.split())
        scored = sorted((-round(0.6 * len(w & set(c.split())) / len(w) + 0.4 * len(w & set(t)) / len(w), 4), p, s) for p, c, _, _, t, s in proofs if len(w & (set(c.split()) | set(t))) >= 2)
        best = [x for x in scored[:3] if -x[0] >= 0.12]
        want.append((run, i, "GAP" if not best else "STRONG" if -best[0][0] >= 0.28 and best[0][2] == "strong" else "PARTIAL", [x[1] for x in best], -best[0][0] if best else 0.0))
    assert rows(got) == sorted(want, key=str)


def test_measures(spark, rows):
    e = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "k string, v int")
    assert rows(measures.breakdown(e, "k", ["a", "b", "c"]), "k", "n") == [("a", 2), ("b", 1), ("c", 0)]
    d = spark.createDataFrame([("g", "X", 2), ("g", "PROSE", 3), ("h", "Y", 1), ("h", "X", 2)], "g string, f string, o int")
    assert rows(measures.dominant(d, ["g"], "f", "o", "PROSE"), "g", "f") == [("g", "PROSE"), ("h", "Y")]
    assert measures.agreement(e, F.col("v") > 1, F.col("k") == "a").first()[:4] == (1, 1, 1, 0)
    assert measures.usage(e, ["k"], [F.count(F.lit(1)).alias("n")]).count() == 4
    assert measures.automation(d, "f", "g", F.col("o") > 2).where("g = 'g'").first()["rate"] == 50.0


def test_store(spark, rows, tmp_path):
    t = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1), (None, "x", 1)], "id int, v string, t int")
    assert rows(store.latest(t, ["id"], "t")) == [(1, "b", 2), (2, None, 1)]
    assert rows(store.latest(t, ["id"], "t", fixed=["v"]), "id", "v") == [(1, "a"), (2, None)]
    new = spark.createDataFrame([(2, "n", 9), (3, "m", 9)], t.schema)
    assert rows(store.upsert(store.latest(t, ["id"], "t"), new, ["id"], fixed=["t"])) == [(1, "b", 2), (2, "n", 1), (3, "m", 9)]
    assert rows(store.duplicate_keys(t, ["id"])) == [(1, 2)]
    assert rows(store.outside_domain(t, "v", ["a", "b"])) == [("x", 1)]
    done, bad = store.set_status(spark.createDataFrame([(1, "OPEN"), (2, "OPEN")], "id int, status string"), "id", spark.createDataFrame([(1, "DONE"), (2, "odd"), (9, "DONE")], "id int, status string"), ["OPEN", "DONE"])
    assert rows(done, "id", "status") == [(1, "DONE"), (2, "OPEN")] and rows(bad) == [(2, "odd"), (9, "DONE")]
    path = str(tmp_path / "t")
    store.append(t, path)
    store.replace_table(store.latest(spark.read.parquet(path), ["id"], "t"), path)
    assert spark.read.parquet(path).count() == 2


def test_render(spark):
    d = spark.createDataFrame([("k", 2, "a|b"), ("k", 1, None)], "k string, o int, v string")
    assert render.table(d, ["k"], ["o"], ["O", "V"], [F.col("o"), F.col("v")]).first()["markdown"] == "| O | V |\n|---|---|\n| 1 | - |\n| 2 | a\\|b |"
    assert render.document(d, ["k"], ["o"], "v").first()["markdown"] == "\n\na|b"


def test_background_of_queries_counts_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIR_BLOCK", 7)
    v = np.random.default_rng(7).normal(size=(40, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    got = retrieval.percentiles(retrieval.pair_scores(df, "id", "v", df.where("id % 10 = 0")), "score", "n").first()
    scores = [round(float(v[a] @ v[b]), 6) for a in range(0, 40, 10) for b in range(40) if a != b]
    assert got["n_pairs"] == len(scores) and abs(got["adapt_min"] - np.percentile(scores, 97)) < 1e-3


def test_theme_checks(spark, rows):
    themes = [("r", "a", "We provide backup copies", None), ("r", "b", "the of", ""), ("r", "c", "Backup copies kept safe", None), ("r", "d", "Night shift handover", "slow repairs"), ("r", "e", "Solar meters readings", None), ("r", "f", None, None)]
    reqs = [("r", "1", "backup copies weekly"), ("r", "2", "copies tested"), ("r", "3", "night handover notes"), ("r", "4", "shift plans"), ("r", "5", "meters"), ("s", "6", "meters solar")]
    proofs = [(f"P{i}", "claim", "copies of backup", None, ["night-shift"] if i == 9 else None) for i in (9, 3, 5, 7, 1)]
    t = spark.createDataFrame(themes, "run_id string, id string, statement string, buyer_pain_addressed string")
    r = spark.createDataFrame(reqs, "run_id string, id string, text string")
    p = spark.createDataFrame(proofs, "id string, claim string, evidence string, verifiable_source string, covers_tags array<string>")
    got = matching.theme_checks(t, r, p, ["run_id"])
    assert rows(got, "theme_id", "verdict") == [("a", "seller"), ("b", "empty"), ("c", "kept"), ("d", "kept"), ("e", "decorative"), ("f", "empty")]
    assert rows(got.where("theme_id = 'c'"), "proof_ids") == [(["P1", "P3", "P5", "P7"],)]
    assert rows(matching.theme_checks(t.where("id = 'd'"), r, p.where("id <> 'P9'"), ["run_id"]), "verdict") == [("unevidenced",)]
    assert matching.theme_checks(t.limit(0), r, p, ["run_id"]).count() == 0


def test_labelled_texts_meet_found_ones(spark, rows):
    a = spark.createDataFrame([("r", "1", "Keep the *backup* copies for five years"), ("r", "2", "Nothing alike"), ("s", "3", None)], "run string, id string, text string")
    b = spark.createDataFrame([("r", "z", "keep backup copies for five years"), ("r", "y", "keep backup copies five years safely"), ("s", "x", "keep backup copies for five years")], "run string, id string, text string")
    assert rows(matching.matched_texts(a, b, ["run"], "id", "text"), "id", "first_match", "best_match") == [("1", "y", "z"), ("2", None, None), ("3", None, None)]


def test_narrative_sections(spark, rows):
    r = spark.createDataFrame([("r", "Pricing schedule", "COSTING", "X"), ("r", "Detailed mandatory text", "PROSE", "X"), ("r", "x", "APPENDIX", "X"), ("r", "price", "PROSE", "SUBMISSION_RULE"), ("r", "risk and security and privacy", "PROSE", None), ("s", None, None, None)], "run_id string, text string, deliverable_form string, req_type string")
    got = matching.narrative_outline(r, ["run_id"])
    assert rows(got.where("run_id = 'r'"), "order_index", "title", "n_requirements") == [(0, "Executive summary", 0), (1, "Security, data protection and compliance", 1), (2, "Commercials", 1), (3, "Submission compliance", 2), (4, "Additional requirements", 1)]
    assert rows(got.where("run_id = 's'"), "title", "target_words") == [("Additional requirements", 400), ("Executive summary", 500)]


def test_windows_of_hot_keys(spark, monkeypatch):
    rng = random.Random(3)
    rows_ = [(rng.choice(["hot", "hot", "hot", None, "k"]), i * 7 % 400, rng.choice([1.5, 2.0, None]), rng.choice(["a", "b"])) for i in range(400)]
    df = spark.createDataFrame(rows_, "k string, o int, v double, e string").withColumn("ts", F.timestamp_seconds(F.col("o") * 60))
    def all_three():
        run = {(r["k"], r["o"]): (r["start"], r["end"], r["share"]) for r in measures.running(df, ["k"], ["o"], "v").collect()}
        last = {(r["k"], r["o"]): r["x"] for r in measures.last_before(df, ["k"], ["o"], F.col("e") == "a", "o", "x").collect()}
        n = {(r["k"], r["o"]): r["n"] for r in measures.in_window(df, ["k"], "ts", 600, "n").collect()}
        return run, last, n
    want = all_three()
    monkeypatch.setattr(measures, "HOT_ROWS", 20)
    assert all_three() == want and len(want[0]) == 400


def _shuffled(spark, since=-1):
    """The last stage so far, and the rows that stages after ``since`` wrote for a shuffle."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return max((s.stageId() for s in stages), default=-1), sum(s.shuffleWriteRecords() for s in stages if s.stageId() > since)


def test_bm25_writes_no_pairs_of_queries_and_documents(spark):
    docs = spark.createDataFrame([(f"D{i:04d}", "red fox " + ("hen" if i % 2 else "sea") if i < 600 else "owl tree") for i in range(2000)], "id string, text string")
    q = spark.createDataFrame([(f"Q{i:02d}", "red fox hen") for i in range(50)], "query_id string, query string")
    post = retrieval.postings(docs, "id", "text").cache()
    counts = retrieval.term_counts(post).cache()
    counts.count()
    since, _ = _shuffled(spark)
    got = retrieval.bm25(post, counts, 2000, "id", q, "query_id", "query", depth=5).collect()
    assert {r["query_id"]: r["id"] for r in got if r["rank"] == 5} == {f"Q{i:02d}": "D0009" for i in range(50)} and len(got) == 250
    assert _shuffled(spark, since)[1] < 600 * 50 / 4


def test_rankings_in_parts_match_brute_force(spark, monkeypatch):
    for name, n in (("HEAVY", 9), ("ASKED", 3), ("STEP", 4)):
        monkeypatch.setattr(retrieval, name, n, raising=False)
    rng = random.Random(9)
    names = ["red", "fox", "hen", "sea", "tree", "pen", "owl"]
    texts = {f"D{i:02d}": [rng.choice(names) for _ in range(rng.randint(0, 5))] for i in range(90)}
    asked = {f"Q{i}": rng.sample(names, rng.randint(1, 4)) for i in range(10)}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "id string, text string")
    q = spark.createDataFrame([(k, " ".join(t)) for k, t in asked.items()], "query_id string, query string")
    post = retrieval.postings(docs, "id", "text").cache()
    counts = retrieval.term_counts(post).cache()
    avg = sum(map(len, texts.values())) / 90
    idf = {w: math.log(90 - d + 0.5) - math.log(d + 0.5) for w, d in Counter(w for t in texts.values() for w in set(t)).items()}
    gain = lambda t, w: idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg))
    ways = {
        "bm25": (retrieval.bm25(post, counts, 90, "id", q, "query_id", "query", depth=6), lambda t, ws: round(sum(gain(t, w) for w in ws), 6)),
        "share": (retrieval.word_share(post, counts, "id", q, "query_id", "query", depth=6), lambda t, ws: round(len(set(t) & set(ws)) / len(ws), 6)),
    }
    for got, score in ways.values():
        want = [(k, i, -s, rank) for k, ws in asked.items() for rank, (s, i) in enumerate(sorted((-score(t, ws), i) for i, t in texts.items() if score(t, ws) > 0)[:6], 1)]
        assert sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)


def test_rankings_without_queries_or_documents(spark):
    docs = spark.createDataFrame([(f"D{i}", "red fox") for i in range(5)] + [("E", "owl"), ("F", None)], "id string, text string")
    q = spark.createDataFrame([("Q", "owl")], "query_id string, query string")
    for some, asked, want in ((docs, q, ["E"]), (docs, q.limit(0), []), (docs.limit(0), q, [])):
        post = retrieval.postings(some, "id", "text")
        counts = retrieval.term_counts(post)
        for got in (retrieval.bm25(post, counts, some.count(), "id", asked, "query_id", "query"), retrieval.word_share(post, counts, "id", asked, "query_id", "query")):
            assert [r["id"] for r in got.collect()] == want


# Rows that a search may write for shuffles on sf0.01, its index there; one for each pair of query and chunk were more.
SEARCHES = {"evaluation": 14_000, "search_decisions": 17_000, "context_packs": 12_000, "fused_top": 8_000, "search_quality": 10_000}


@pytest.mark.parametrize("name", SEARCHES)
def test_search_writes_no_pairs(spark, name):
    folder = "/root/testdata/sf0.01"
    for part in relations._index(spark, folder)[:2]:
        part.count()
    since, _ = _shuffled(spark)
    assert relations.QUERIES[name](spark, folder).count() > 0
    assert _shuffled(spark, since)[1] < SEARCHES[name]
