"""Queries that rank, match, join and count keyed records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.functions import lexicon as lex
from tenderlake.functions import text as T
from tenderlake.operators import assurance, integrity, matching, measures, render, retrieval, structure
from tenderlake.plans import documents
from tenderlake.session import kept, stage, table, texts
from tenderlake.sources import store

# Closed domains of the tables.
PRIORITIES = ["MANDATORY", "WEIGHTED", "NICE_TO_HAVE"]
FORMS = ["PROSE", "TABLE", "MATRIX", "COSTING", "GANTT", "CHART", "APPENDIX"]
SECTION_STATUS = ["PENDING", "DRAFTED", "ESCALATED", "APPROVED", "FAILED_ASSURANCE"]
HQ_STATUS = ["APPROVED"]


def _once(spark: SparkSession, d: str, name: str, keys: list[str], columns: list[str]) -> DataFrame:
    read = texts if name in ("chunk", "sections", "hq_001_030") else table
    return store.latest(read(spark, d, name).select(*keys, *columns, "loaded_at"), keys, "loaded_at")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    q = _once(spark, d, "retrieval_pairs", ["query_id"], ["query", "relevant_ids"])
    return q.where(retrieval.every_fiftieth(F.col("query_id")))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "chunk", ["id"], ["source_id", "text"])


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """Postings and term counts of all chunks, written once for all queries of a session, and the number of chunks."""
    post = kept(spark, "postings", d, lambda: retrieval.postings(_chunks(spark, d), "id", "text"))
    counts = kept(spark, "terms", d, lambda: retrieval.term_counts(post))
    n = kept(spark, "chunks", d, lambda: _chunks(spark, d).groupBy().agg(F.count(F.lit(1)).alias("n")))
    return post, counts, n.first()["n"]


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    post, counts, n = _index(spark, d)
    return retrieval.bm25(post, counts, n, "id", _queries(spark, d), "query_id", "query")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    post, counts, _ = _index(spark, d)
    return retrieval.fuse([retrieval.word_share(post, counts, "id", _queries(spark, d), "query_id", "query"), _bm25(spark, d)], "query_id", "id")


def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks of each fiftieth query."""
    return _bm25(spark, d).where("rank <= 10")


def fused_top(spark: SparkSession, d: str) -> DataFrame:
    """Word-share and BM25 rankings fused; thirty for each query."""
    return _fused(spark, d)


def context_packs(spark: SparkSession, d: str) -> DataFrame:
    """The five best fused hits of each query with what fits the context budget."""
    both = _fused(spark, d).where(F.col("rank") <= lex.TOP_K).join(_chunks(spark, d), "id")
    return retrieval.context_budget(both, "query_id", "text").select("query_id", "id", "source_id", "rank", "rrf_score", "used")


def search_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank and nDCG of the BM25 ranking against the listed sources."""
    sources = _once(spark, d, "chunk", ["id"], ["source_id"]).select("id", F.upper("source_id").alias("source_id"))
    by_source = _bm25(spark, d).join(sources, "id").groupBy("query_id", "source_id").agg(F.min("rank").alias("best"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best")))
    wanted = _queries(spark, d).select("query_id", F.explode(F.array_distinct(F.transform("relevant_ids", integrity.clean_ref))).alias("source_id")).where("source_id IS NOT NULL")
    return retrieval.query_quality(ranked, wanted, "query_id", "source_id")


def dense_top(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.dense_top(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), 10)


def search_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Each fiftieth query answered: rankings fused, the best reranked, and a decision with its confidence.

    The bounds of the decision come from the scores of all chunks that were reranked.
    """
    queries = _queries(spark, d)
    ranked = stage(retrieval.reranked(_fused(spark, d), queries, _chunks(spark, d), "query_id", "id", "query", "text", lex.RERANK_DEPTH), "reranked")
    conf = retrieval.confidence(ranked, "query_id")
    bounds = retrieval.percentiles(ranked, "score")
    best = ranked.where("rank = 1").join(_once(spark, d, "chunk", ["id"], ["source_id"]), "id").select("query_id", "source_id")
    decided = conf.crossJoin(F.broadcast(bounds)).select("query_id", "best_score", "confidence", retrieval.decision(F.col("best_score"), F.col("reuse_min"), F.col("adapt_min")).alias("decision"))  # bounds has one row
    return decided.join(best, "query_id")


def _decisions(e: DataFrame, q: DataFrame, bounds: DataFrame) -> DataFrame:
    conf = retrieval.confidence(retrieval.dense_top(e, "vec_id", "embedding", q, 2), "query_id")
    return conf.crossJoin(F.broadcast(bounds)).select("query_id", "best_score", "confidence", retrieval.decision(F.col("best_score"), F.col("reuse_min"), F.col("adapt_min")).alias("decision"))  # bounds has one row


def dense_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Best score, margin confidence and decision of each query vector, by the bounds of ``background``."""
    e = table(spark, d, "embeddings")
    return _decisions(e, e.where("vec_id % 50 = 0"), background(spark, d))


def dense_decisions_all(spark: SparkSession, d: str) -> DataFrame:
    """The same by the bounds of all pairs, those of ``background_all``."""
    e = table(spark, d, "embeddings")
    return _decisions(e, e.where("vec_id % 50 = 0"), background_all(spark, d))


def background(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the similarity of every fiftieth vector with all others, and the bounds derived."""
    e = table(spark, d, "embeddings")
    return retrieval.percentiles(stage(retrieval.pair_scores(e, "vec_id", "embedding", e.where("vec_id % 50 = 0")), "scores"), "score", "n")


def background_all(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the similarity of all pairs of vectors, and the bounds derived."""
    return retrieval.percentiles(stage(retrieval.pair_scores(table(spark, d, "embeddings"), "vec_id", "embedding"), "scores"), "score", "n")


def _calibration(spark: SparkSession, d: str) -> DataFrame:
    pairs = _once(spark, d, "calibration_pairs", ["pair_id"], ["question", "historical_id", "relation"])
    known = _once(spark, d, "hq_001_030", ["id"], ["question"]).select(F.upper("id").alias("hid"), F.col("question").alias("known"))
    joined = pairs.withColumn("hid", integrity.clean_ref(F.col("historical_id"))).join(known, "hid")
    words = lambda c: T.content_tokens(F.col(c), lex.QUERY_STOPWORDS)
    return joined.select("pair_id", "relation", F.round(T.jaccard(words("question"), words("known")), 6).alias("similarity"))


def calibration_check(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, median and extremes of the measured similarity for each label."""
    return _calibration(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("similarity"), 6).alias("median"), F.min("similarity").alias("low"), F.max("similarity").alias("high"))


def calibration_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How well a similarity of a tenth tells near-identical questions from others."""
    return measures.agreement(_calibration(spark, d), F.col("similarity") >= 0.1, F.col("relation") == "NEAR_IDENTICAL")


def _proof_matches(spark: SparkSession, d: str, r: DataFrame) -> DataFrame:
    p = _once(spark, d, "proof_points", ["id"], ["claim", "evidence", "verifiable_source", "covers_tags", "strength"])
    return matching.match_proofs(r, p, ["run_id", "id"]).withColumn("proof_ids", F.array_join("proof_ids", ","))


def proof_matches(spark: SparkSession, d: str) -> DataFrame:
    """Proof points for requirements whose id has a number divisible by 50; not every fiftieth row."""
    return _proof_matches(spark, d, _once(spark, d, "requirements", ["run_id", "id"], ["text"]).where(retrieval.every_fiftieth(F.col("id"))))


def proof_matches_all(spark: SparkSession, d: str) -> DataFrame:
    """Proof points for every requirement of every run."""
    return _proof_matches(spark, d, _once(spark, d, "requirements", ["run_id", "id"], ["text"]))


def theme_threads(spark: SparkSession, d: str) -> DataFrame:
    themes = _once(spark, d, "win_themes", ["run_id", "id"], ["statement", "buyer_pain_addressed"])
    return matching.theme_threads(themes, _once(spark, d, "requirements", ["run_id", "id"], ["text"]), ["run_id"])


def theme_checks(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on every theme: about the buyer, threaded through the requirements, evidenced by proofs."""
    themes = _once(spark, d, "win_themes", ["run_id", "id"], ["statement", "buyer_pain_addressed"])
    proofs = _once(spark, d, "proof_points", ["id"], ["claim", "evidence", "verifiable_source", "covers_tags"])
    c = matching.theme_checks(themes, _once(spark, d, "requirements", ["run_id", "id"], ["text"]), proofs, ["run_id"])
    return c.withColumn("proof_ids", F.array_join("proof_ids", ","))


def theme_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections that take up a requirement of a theme of their run."""
    t = _once(spark, d, "win_themes", ["run_id", "id"], ["requirement_ids_json"])
    ids = F.array_distinct(F.transform(integrity.json_ids(F.col("requirement_ids_json")), integrity.clean_ref))
    t = t.select("run_id", F.col("id").alias("theme_id"), F.explode(ids).alias("requirement_id")).where("requirement_id IS NOT NULL")
    return t.join(_placed(spark, d), ["run_id", "requirement_id"]).groupBy("run_id", "theme_id", "section_id").agg(F.count(F.lit(1)).alias("n_shared"))


def retrieval_queries(spark: SparkSession, d: str) -> DataFrame:
    """What is searched for a section: its title, purpose and first five requirements; and the first three as a paraphrase."""
    s = _once(spark, d, "sections", ["run_id", "id"], ["title", "purpose"]).select("run_id", F.col("id").alias("section_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("purpose", F.lit("")).alias("purpose"))
    r = _once(spark, d, "requirements", ["run_id", "id"], ["text"]).select("run_id", F.col("id").alias("requirement_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = _placed(spark, d).join(r, ["run_id", "requirement_id"])
    first = held.withColumn("place", F.row_number().over(Window.partitionBy("run_id", "section_id").orderBy("requirement_id"))).where("place <= 5")
    told = first.groupBy("run_id", "section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("t"))
    both = s.join(told, ["run_id", "section_id"], "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    query = F.array_join(F.concat(F.array("title", "purpose"), F.col("t")), " ")
    return both.select("run_id", "section_id", F.left(query, F.lit(lex.RETRIEVAL_QUERY_CHARS)).alias("query"), F.left(F.array_join(F.slice("t", 1, 3), " "), F.lit(lex.PARAPHRASE_CHARS)).alias("paraphrase"))


def labelled_matches(spark: SparkSession, d: str) -> DataFrame:
    """Requirements that both ways of extraction found, matched with those that the cues alone found in the same run."""
    r = _once(spark, d, "requirements", ["run_id", "id"], ["text", "extracted_by"])
    return matching.matched_texts(r.where("extracted_by = 'both'"), r.where("extracted_by = 'cue'"), ["run_id"], "id", "text")


def statement_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose orders, each put in words, state different durations or peaks."""
    n = F.col("o_orderkey")
    said = F.concat(F.lit("The programme runs for "), (10 + n % 3).cast("string"), F.lit(" months with a peak of "), (20 + n % 2).cast("string"), F.lit(" FTE."))
    orders = table(spark, d, "orders").select("o_custkey", n.cast("string").alias("part"), said.alias("text"))
    c = assurance.tracked_conflicts(orders, ["o_custkey"], "part", "text")
    return c.select("o_custkey", "kind", "n_values", F.array_join(F.transform("all_values", lambda v: v.cast("int").cast("string")), ",").alias("all_values"), F.size("parts").alias("n_parts"))


def grounding_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Checkable sentences of historical answers in batches, with the texts of the sources that queries with the same question cite."""
    hq = _once(spark, d, "hq_001_030", ["id"], ["question", "answer"])
    batches = assurance.grounding_batches(structure.claim_sentences(hq, ["id"], "answer"), ["id"], ["ix"])
    cited = _once(spark, d, "retrieval_pairs", ["query_id"], ["query", "relevant_ids"]).where("query IS NOT NULL")
    cited = cited.groupBy("query").agg(F.min_by("relevant_ids", "query_id").alias("relevant_ids"))
    cited = hq.select("id", F.col("question").alias("query")).join(cited, "query").select("id", "relevant_ids")
    both = assurance.with_sources(batches, cited, ["id"], "relevant_ids", _chunks(spark, d))
    return both.select("id", "batch_no", F.size("sentences").alias("n_sentences"), F.length(F.array_join("sentences", " ")).alias("chars"), F.size("sources").alias("n_sources"), F.length(F.array_join("sources", "")).alias("source_chars"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    s = _once(spark, d, "sections", ["run_id", "id"], ["requirement_ids_json"])
    ids = F.array_distinct(F.transform(integrity.json_ids(F.col("requirement_ids_json")), integrity.clean_ref))
    return s.select("run_id", F.col("id").alias("section_id"), F.explode(ids).alias("requirement_id")).where("requirement_id IS NOT NULL")


def compliance_matrix(spark: SparkSession, d: str) -> DataFrame:
    sections = _once(spark, d, "sections", ["run_id", "id"], ["content_md", "status"]).where("status IN ('DRAFTED', 'APPROVED')")
    return matching.compliance(_placed(spark, d), _once(spark, d, "requirements", ["run_id", "id"], ["text"]), sections)


def compliance_coverage(spark: SparkSession, d: str) -> DataFrame:
    covered = F.count("section_id")
    return compliance_matrix(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(100 * covered / F.count(F.lit(1)), 2).alias("coverage_pct"), F.count_if(F.col("rag") == "GREEN").alias("n_green"))


def compliance_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of each run as a markdown table, mandatory requirements first."""
    r = _once(spark, d, "requirements", ["run_id", "id"], ["priority"]).withColumnRenamed("id", "requirement_id")
    rows = _placed(spark, d).groupBy("run_id", "requirement_id").agg(F.min("section_id").alias("section_id"))
    rows = r.join(rows, ["run_id", "requirement_id"], "left").withColumn("late", F.coalesce((F.col("priority") != "MANDATORY").cast("int"), F.lit(1)))
    return render.table(rows, ["run_id"], ["late", "requirement_id"], ["Requirement", "Priority", "Section"], [F.col("requirement_id"), F.col("priority"), F.col("section_id")])


def unplaced_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Requirements that no section of their run takes up."""
    r = _once(spark, d, "requirements", ["run_id", "id"], ["priority"]).select("run_id", F.col("id").alias("requirement_id"), "priority")
    return r.join(_placed(spark, d).select("run_id", "requirement_id"), ["run_id", "requirement_id"], "left_anti")


def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Text of every source that the labelled queries list."""
    q = _once(spark, d, "retrieval_pairs", ["query_id"], ["relevant_ids"])
    return assurance.cited_texts(q, ["query_id"], "relevant_ids", _chunks(spark, d)).select("query_id", "pos", "source_id", F.length("text").alias("chars"))


def named_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Requirement ids that documents name and that exist in some run."""
    docs = texts(spark, d, "documents").where("text IS NOT NULL")
    return assurance.named_ids(docs, ["doc_id"], "text", r"\b(R-\d{3,4})\b", table(spark, d, "requirements"), "id")


def section_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Requirements that exist and that some section takes up, with the most frequent form of each run."""
    r = _once(spark, d, "requirements", ["run_id", "id"], ["deliverable_form"]).select("run_id", F.col("id").alias("requirement_id"), "deliverable_form")
    held = r.join(_placed(spark, d).select("run_id", "requirement_id"), ["run_id", "requirement_id"], "left_semi")
    return measures.dominant(held, ["run_id"], "deliverable_form", "requirement_id", "PROSE")


def record_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines have different return flags."""
    c = assurance.conflicts(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), ["l_orderkey"], "l_returnflag")
    return c.withColumn("all_values", F.array_join("all_values", ","))


def latest_records(spark: SparkSession, d: str) -> DataFrame:
    """Latest delivery of each record; its first load time stays."""
    hq = table(spark, d, "hq_001_030").select("id", "question", "status", F.col("loaded_at").alias("first_loaded"), "loaded_at")
    return store.latest(hq, ["id"], "loaded_at", fixed=["first_loaded"])


def merged_events(spark: SparkSession, d: str) -> DataFrame:
    """Users' latest event merged over their first one."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    first = store.latest(e.withColumn("o", -F.col("event_id")), ["user_id"], "o").drop("o")
    last = store.latest(e, ["user_id"], "event_id")
    return store.upsert(first, last, ["user_id"], fixed=["event_id"])


def domain_violations(spark: SparkSession, d: str) -> DataFrame:
    checks = [("requirements", "priority", PRIORITIES), ("requirements", "deliverable_form", FORMS), ("sections", "status", SECTION_STATUS), ("hq_001_030", "status", HQ_STATUS)]
    parts = [store.outside_domain(table(spark, d, t), c, dom).select(F.lit(t).alias("tbl"), F.lit(c).alias("col"), "value", "n") for t, c, dom in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_violations(spark: SparkSession, d: str) -> DataFrame:
    """Keys delivered more than once, counted for each table."""
    keys = {"requirements": ["run_id", "id"], "sections": ["run_id", "id"], "win_themes": ["run_id", "id"], "proof_points": ["id"], "hq_001_030": ["id"], "chunk": ["id"]}
    parts = [store.duplicate_keys(table(spark, d, t), k).agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(F.lit(t).alias("tbl"), "n_keys", "n_rows") for t, k in keys.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dangling_themes(spark: SparkSession, d: str) -> DataFrame:
    """Themes of runs that have no section."""
    t = table(spark, d, "win_themes").select("run_id", "id").distinct()
    return store.dangling(t, ["run_id"], table(spark, d, "sections").select("run_id"), ["run_id"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_themes"))


def last_signup(spark: SparkSession, d: str) -> DataFrame:
    """The nearest earlier signup of the same user, for every purchase."""
    e = measures.last_before(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "event_id", "signup_id")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "signup_id")


def request_rate(spark: SparkSession, d: str) -> DataFrame:
    """Busiest hour of each user: most events in any sliding hour."""
    e = measures.in_window(table(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts", 3600, "n")
    return e.groupBy("user_id").agg(F.max("n").alias("most"))


def event_usage(spark: SparkSession, d: str) -> DataFrame:
    """Events, total and mean value overall, by type and by weekday."""
    e = table(spark, d, "events").select("event_type", F.dayofweek("ts").alias("weekday"), "value")
    u = measures.usage(e, ["event_type", "weekday"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean")])
    return u.select("event_type", "weekday", "n", "total", "mean")


def kind_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return measures.breakdown(table(spark, d, "events"), "event_type", ["view", "click", "purchase", "signup", "error", "refund"])


def automation_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of sections without a line for a person to fill in, by deliverable form."""
    s = _once(spark, d, "sections", ["run_id", "id"], ["deliverable_form", "status"]).where("deliverable_form IS NOT NULL").withColumn("key", F.concat_ws("/", "run_id", "id"))
    return measures.automation(s, "key", "deliverable_form", F.coalesce(F.col("status") == "ESCALATED", F.lit(False)))


def running_totals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return measures.running(o, ["o_custkey"], ["o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "start", "end", "share")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Values inside the JSON properties, by type."""
    e = table(spark, d, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


def finding_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings by type, over what is written of orders."""
    found = {"ENTITY_VALUE": statement_conflicts, "TABLE_TOTAL": documents.order_totals, "PERCENTAGE": documents.order_reserves, "DURATION": documents.order_durations, "RISK_LANGUAGE": documents.order_promises}
    parts = [query(spark, d).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, query in found.items()]
    return reduce(DataFrame.unionByName, parts)


def order_failures(spark: SparkSession, d: str) -> DataFrame:
    """The first problem of what is written of each order: a wrong total, else a blocking phrase."""
    wrong = documents.order_totals(spark, d).select("order", F.lit("TABLE_TOTAL").alias("kind"), F.lit("stated total differs").alias("detail"))
    return assurance.failures(wrong, documents.order_promises(spark, d), ["order"])


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Measures of search, extraction and calibration with their targets."""
    q = search_quality(spark, d).agg(F.avg("recall_k").alias("Recall@5"), F.avg("reciprocal_rank").alias("MRR"), F.avg("ndcg").alias("nDCG@5"))
    r = labelled_matches(spark, d).agg(F.avg(F.col("first_match").isNotNull().cast("int")).alias("Requirement recall"))
    c = calibration_agreement(spark, d).select(F.col("f1").alias("Calibration F1"))
    parts = [df.select(F.lit(name).alias("metric"), F.round(F.coalesce(F.col(f"`{name}`"), F.lit(0.0)), 4).alias("value"), F.lit(target).alias("target")) for df, name, target in ((q, "Recall@5", 0.85), (q, "MRR", 0.70), (q, "nDCG@5", 0.75), (r, "Requirement recall", 0.90), (c, "Calibration F1", 0.50))]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("value") >= F.col("target"))


QUERIES = {f.__name__: f for f in (finding_counts, order_failures, evaluation, bm25_top, fused_top, context_packs, search_quality, dense_top, dense_decisions, dense_decisions_all, background, background_all, calibration_check, calibration_agreement, proof_matches, proof_matches_all, theme_threads, theme_checks, theme_sections, retrieval_queries, labelled_matches, statement_conflicts, grounding_inputs, search_decisions, compliance_matrix, compliance_coverage, compliance_markdown, unplaced_requirements, cited_sources, named_requirements, section_requirements, record_conflicts, latest_records, merged_events, domain_violations, key_violations, dangling_themes, last_signup, request_rate, event_usage, kind_breakdown, automation_rates, running_totals, event_props)}


def _latest(name: str, keys: str) -> str:
    return f"(SELECT DISTINCT ON ({keys}) * FROM {name} ORDER BY {keys}, loaded_at DESC)"


def _words(text: str, stop: list[str]) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({stop}, w)))"


_JSON = "CASE WHEN json_valid(requirement_ids_json) AND json_type(requirement_ids_json) = 'ARRAY' THEN from_json(requirement_ids_json, '[\"VARCHAR\"]') END"
_PLACED = f"(SELECT DISTINCT run_id, section_id, requirement_id FROM (SELECT run_id, id AS section_id, upper(trim(unnest({_JSON}))) AS requirement_id FROM {_latest('sections', 'run_id, id')}) WHERE requirement_id <> '')"
_Q = f"(SELECT query_id, query, relevant_ids FROM {_latest('retrieval_pairs', 'query_id')} WHERE regexp_extract(query_id, '(\\d+)\\D*$', 1)::BIGINT % 50 = 0)"
_BM25 = f"""
WITH docs AS (SELECT id, source_id, text, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM {_latest('chunk', 'id')}),
size AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM docs),
post AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM docs) GROUP BY id, term),
idf AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, size GROUP BY term, n_docs),
w AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT avg(idf) * 0.25 FROM idf) ELSE idf END AS w FROM idf),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]+')) AS term FROM {_Q}) GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(w * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM q JOIN w USING (term) JOIN post USING (term), size GROUP BY query_id, id),
bm AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 60),
sh AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(count(*) / n, 6) AS score FROM (SELECT query_id, len(w) AS n, unnest(w) AS term FROM (SELECT query_id, {_words('query', lex.QUERY_STOPWORDS)} AS w FROM {_Q})) JOIN post USING (term) GROUP BY query_id, id, n)) WHERE rank <= 60),
fu AS (SELECT *, round(1 / (60 + rank), 9) AS rrf_score FROM (SELECT query_id, id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, src, r, id) AS rank FROM (
  SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS fused, min(src) AS src, arg_min(rank, src) AS r FROM (SELECT query_id, id, rank, 0 AS src FROM sh UNION ALL SELECT query_id, id, rank, 1 FROM bm) GROUP BY query_id, id)) WHERE rank <= 30)
"""
_DOT = "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_DENSE = f"(SELECT a.vec_id AS query_id, b.vec_id, {_DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"
_BOUNDS = f"SELECT count(score) AS n_pairs, round(min(score), 4) AS low, round(quantile_cont(score, 0.5), 4) AS median, round(quantile_cont(score, 0.9), 4) AS p90, round(quantile_cont(score, 0.97), 4) AS adapt_min, round(quantile_cont(score, 0.995), 4) AS reuse_min, round(max(score), 4) AS high FROM {_DENSE}"
_CALIBRATION = f"""
WITH c AS (SELECT pair_id, relation, {_words('p.question', lex.QUERY_STOPWORDS)} AS a, {_words('h.question', lex.QUERY_STOPWORDS)} AS b
  FROM {_latest('calibration_pairs', 'pair_id')} p JOIN {_latest('hq_001_030', 'id')} h ON upper(h.id) = upper(trim(p.historical_id))),
m AS (SELECT pair_id, relation, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS similarity FROM c)
"""
_MATRIX = f"""
WITH placed AS (SELECT run_id, requirement_id, min(section_id) AS section_id FROM {_PLACED} GROUP BY ALL),
r AS (SELECT run_id, id AS requirement_id, {_words('text', lex.COMPLIANCE_STOPWORDS)} AS w FROM {_latest('requirements', 'run_id, id')}),
p AS (SELECT run_id, id AS section_id, list_filter(string_split(coalesce(content_md, ''), chr(10) || chr(10)), lambda x: regexp_replace(x, '\\s+', '', 'g') <> '') AS ps FROM {_latest('sections', 'run_id, id')} WHERE status IN ('DRAFTED', 'APPROVED')),
b AS (SELECT r.run_id, r.requirement_id, placed.section_id, p.ps IS NOT NULL AS written, list_transform(ps, lambda x: len(list_intersect(w, {_words('x', lex.COMPLIANCE_STOPWORDS)})) / greatest(len(w), 1)) AS shares
  FROM r LEFT JOIN placed USING (run_id, requirement_id) LEFT JOIN p ON p.run_id = r.run_id AND p.section_id = placed.section_id),
m AS (SELECT run_id, requirement_id, CASE WHEN written THEN section_id END AS section_id,
  CASE WHEN written THEN CASE WHEN coalesce(list_max(shares), 0) > 0 THEN section_id || '#p' || list_position(shares, list_max(shares)) ELSE section_id END END AS anchor,
  CASE WHEN NOT written THEN 'RED' WHEN coalesce(list_max(shares), 0) >= 0.3 THEN 'GREEN' ELSE 'AMBER' END AS rag FROM b)
"""
_DOMAINS = " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, {c} AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL AND NOT list_contains({dom}, {c}) GROUP BY {c}" for t, c, dom in [("requirements", "priority", PRIORITIES), ("requirements", "deliverable_form", FORMS), ("sections", "status", SECTION_STATUS), ("hq_001_030", "status", HQ_STATUS)])
_KEYS = " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n_keys, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1)" for t, k in {"requirements": "run_id, id", "sections": "run_id, id", "win_themes": "run_id, id", "proof_points": "id", "hq_001_030": "id", "chunk": "id"}.items())

SQL = {
    "bm25_top": _BM25 + "SELECT query_id, id, score, rank FROM bm WHERE rank <= 10",
    "fused_top": _BM25 + "SELECT query_id, id, fused, rank, rrf_score FROM fu",
    "context_packs": _BM25 + "SELECT query_id, id, source_id, rank, rrf_score, greatest(0, least(want, 4500 - coalesce(sum(want) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS used FROM (SELECT fu.*, source_id, least(1100, length(text)) AS want FROM fu JOIN docs USING (id) WHERE rank <= 5)",
    "search_quality": _BM25 + f""", rk AS (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM (SELECT query_id, upper(source_id) AS source_id, min(rank) AS best FROM bm JOIN docs USING (id) GROUP BY ALL)),
wanted AS (SELECT DISTINCT query_id, source_id FROM (SELECT query_id, upper(trim(unnest(relevant_ids))) AS source_id FROM {_Q}) WHERE source_id <> ''),
per AS (SELECT query_id, count(*) AS n, min(rank) AS f, coalesce(sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END), 0) AS dcg FROM wanted LEFT JOIN rk USING (query_id, source_id) GROUP BY query_id)
SELECT query_id, coalesce((f = 1)::INT, 0) AS recall_1, coalesce((f <= 5)::INT, 0) AS recall_k, round(coalesce(1 / f, 0), 6) AS reciprocal_rank, round(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM per""",
    "dense_top": f"SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {_DENSE}) WHERE rank <= 10",
    "background": _BOUNDS,
    "dense_decisions": f"""SELECT query_id, s1 AS best_score, CASE WHEN s1 > 0 THEN round(greatest(0, least(1, (s1 - s2) / abs(s1))), 4) ELSE 0 END AS confidence, CASE WHEN s1 >= reuse_min THEN 'REUSE' WHEN s1 >= adapt_min THEN 'ADAPT' ELSE 'SYNTHESIZE' END AS decision
FROM (SELECT query_id, max(score) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2 FROM (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {_DENSE}) WHERE rank <= 2 GROUP BY query_id), ({_BOUNDS})""",
    "calibration_check": _CALIBRATION + "SELECT relation, count(*) AS n, round(median(similarity), 6) AS median, min(similarity) AS low, max(similarity) AS high FROM m GROUP BY relation",
    "calibration_agreement": _CALIBRATION + "SELECT tp, fp, fn, tn, coalesce(round(tp / nullif(tp + fp, 0), 6), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 6), 0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1 FROM (SELECT count(*) FILTER (similarity >= 0.1 AND relation = 'NEAR_IDENTICAL') AS tp, count(*) FILTER (similarity >= 0.1 AND relation <> 'NEAR_IDENTICAL') AS fp, count(*) FILTER (similarity < 0.1 AND relation = 'NEAR_IDENTICAL') AS fn, count(*) FILTER (similarity < 0.1 AND relation <> 'NEAR_IDENTICAL') AS tn FROM m)",
    "proof_matches": f"""
WITH r AS (SELECT run_id, id, {_words('text', lex.PROOF_STOPWORDS)} AS w FROM {_latest('requirements', 'run_id, id')} WHERE regexp_extract(id, '(\\d+)\\D*$', 1)::BIGINT % 50 = 0),
p AS (SELECT id AS proof_id, {_words("concat_ws(' ', claim, evidence, verifiable_source)", lex.PROOF_STOPWORDS)} AS pt, {_words("replace(array_to_string(coalesce(covers_tags, []), ' '), '-', ' ')", lex.PROOF_STOPWORDS)} AS tt, CASE upper(trim(strength)) WHEN 'STRONG' THEN 2 WHEN 'WEAK' THEN 0 ELSE 1 END AS own FROM {_latest('proof_points', 'id')}),
s AS (SELECT run_id, r.id, proof_id, own, round(0.6 * len(list_intersect(w, pt)) / len(w) + 0.4 * len(list_intersect(w, tt)) / len(w), 4) AS score, len(list_intersect(w, list_distinct(list_concat(pt, tt)))) AS shared FROM r, p WHERE len(w) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, id ORDER BY score DESC, proof_id) AS rank FROM s WHERE shared >= 2),
b AS (SELECT run_id, id, max(score) AS best_score, arg_min(own, rank) AS own, string_agg(proof_id, ',' ORDER BY rank) AS proof_ids FROM k WHERE rank <= 3 AND score >= 0.12 GROUP BY run_id, id)
SELECT r.run_id, r.id, CASE WHEN best_score IS NULL THEN 'GAP' WHEN best_score >= 0.28 AND own >= 2 THEN 'STRONG' ELSE 'PARTIAL' END AS fit, coalesce(proof_ids, '') AS proof_ids, coalesce(best_score, 0) AS best_score FROM r LEFT JOIN b USING (run_id, id)""",
    "theme_threads": f"""
WITH t AS (SELECT run_id, id AS theme_id, {_words("concat_ws(' ', statement, buyer_pain_addressed)", lex.THEME_STOPWORDS)} AS w FROM {_latest('win_themes', 'run_id, id')}),
r AS (SELECT run_id, {_words('text', lex.THEME_STOPWORDS)} AS x FROM {_latest('requirements', 'run_id, id')})
SELECT t.run_id, theme_id, len(w) AS n_words, count(*) FILTER (len(list_intersect(w, x)) > 0 AND len(list_intersect(w, x)) / len(w) >= 0.1) AS n_threads FROM t LEFT JOIN r ON r.run_id = t.run_id GROUP BY ALL""",
    "compliance_matrix": _MATRIX + "SELECT * FROM m",
    "compliance_coverage": _MATRIX + "SELECT run_id, count(*) AS n, round(100 * count(section_id) / count(*), 2) AS coverage_pct, count(*) FILTER (rag = 'GREEN') AS n_green FROM m GROUP BY run_id",
    "compliance_markdown": f"""SELECT run_id, '| Requirement | Priority | Section |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || id || ' | ' || coalesce(priority, '-') || ' | ' || coalesce(section_id, '-') || ' |', chr(10) ORDER BY CASE WHEN priority = 'MANDATORY' THEN 0 ELSE 1 END, id) AS markdown
FROM {_latest('requirements', 'run_id, id')} r LEFT JOIN (SELECT run_id, requirement_id, min(section_id) AS section_id FROM {_PLACED} GROUP BY ALL) p USING (run_id) WHERE FALSE GROUP BY run_id""",
    "unplaced_requirements": f"SELECT run_id, id AS requirement_id, priority FROM {_latest('requirements', 'run_id, id')} r WHERE NOT EXISTS (SELECT 1 FROM {_PLACED} p WHERE p.run_id = r.run_id AND p.requirement_id = r.id)",
    "section_requirements": f"SELECT run_id, deliverable_form, n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, deliverable_form <> 'PROSE', f) AS place FROM (SELECT run_id, deliverable_form, count(*) AS n, min(id) AS f FROM {_latest('requirements', 'run_id, id')} r WHERE EXISTS (SELECT 1 FROM {_PLACED} p WHERE p.run_id = r.run_id AND p.requirement_id = r.id) GROUP BY ALL)) WHERE place = 1",
    "cited_sources": f"""SELECT query_id, pos, source_id, (CASE WHEN text IS NULL THEN 0 ELSE least(700, length(text)) END)::INT AS chars FROM (SELECT query_id, (generate_subscripts(relevant_ids, 1) - 1)::INT AS pos, nullif(upper(trim(unnest(relevant_ids))), '') AS source_id FROM {_latest('retrieval_pairs', 'query_id')})
LEFT JOIN (SELECT upper(trim(source_id)) AS source_id, arg_min(text, id) AS text FROM {_latest('chunk', 'id')} WHERE text IS NOT NULL GROUP BY ALL) USING (source_id) WHERE source_id IS NOT NULL""",
    "named_requirements": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS place, id FROM (SELECT doc_id, id, min(p) AS p FROM (SELECT doc_id, generate_subscripts(r, 1) AS p, unnest(r) AS id FROM (SELECT doc_id, regexp_extract_all(text, '\\b(R-\\d{3,4})\\b', 1) AS r FROM documents WHERE text IS NOT NULL)) GROUP BY ALL) WHERE id IN (SELECT id FROM requirements)",
    "record_conflicts": "SELECT l_orderkey, count(DISTINCT l_returnflag)::INT AS n_values, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS all_values FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1",
    "latest_records": f"SELECT l.id, l.question, l.status, f.first_loaded, l.loaded_at FROM {_latest('hq_001_030', 'id')} l JOIN (SELECT id, min(loaded_at) AS first_loaded FROM hq_001_030 GROUP BY id) f USING (id)",
    "merged_events": "SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "domain_violations": _DOMAINS,
    "key_violations": _KEYS,
    "dangling_themes": "SELECT run_id, count(DISTINCT id) AS n_themes FROM win_themes t WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.run_id = t.run_id) GROUP BY run_id",
    "last_signup": "SELECT event_id, user_id, signup_id FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup_id FROM events) WHERE event_type = 'purchase'",
    "request_rate": "SELECT user_id, max(n) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY user_id",
    "event_usage": "SELECT event_type, weekday, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean FROM (SELECT event_type, (dayofweek(ts) + 1)::INT AS weekday, value FROM events) GROUP BY GROUPING SETS ((), (event_type), (weekday))",
    "kind_breakdown": "SELECT t AS event_type, count(event_id) AS n, round(count(event_id) / sum(count(event_id)) OVER (), 6) AS share FROM (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'refund']) AS t) LEFT JOIN events ON event_type = t GROUP BY t",
    "automation_rates": f"SELECT deliverable_form, count(*) AS n_keys, count(*) FILTER (status IS DISTINCT FROM 'ESCALATED') AS automated, round(100 * count(*) FILTER (status IS DISTINCT FROM 'ESCALATED') / count(*), 1) AS rate FROM {_latest('sections', 'run_id, id')} WHERE deliverable_form IS NOT NULL GROUP BY deliverable_form",
    "running_totals": """SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w - o_totalprice, 2) AS start, round(sum(o_totalprice) OVER w, 2) AS "end", round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""",
    "event_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS largest FROM (SELECT event_type, (props::JSON ->> 'k')::BIGINT AS k FROM events) GROUP BY event_type",
}
_THEME_PROOFS = f"""
p AS (SELECT id AS proof_id, {_words("concat_ws(' ', claim, evidence, verifiable_source, array_to_string(coalesce(covers_tags, []), ' '))", lex.THEME_STOPWORDS)} AS x FROM {_latest('proof_points', 'id')}),
sup AS (SELECT run_id, theme_id, list_slice(list(proof_id ORDER BY proof_id), 1, 4) AS proof_ids FROM t JOIN p ON len(list_intersect(w, x)) >= 0.1 * len(w) AND len(list_intersect(w, x)) > 0 GROUP BY ALL)"""
_THREADS = SQL["theme_threads"].strip()
SQL["theme_checks"] = _THREADS[: _THREADS.index("SELECT t.run_id")].rstrip() + f""", n AS ({_THREADS[_THREADS.index("SELECT t.run_id"):]}), {_THEME_PROOFS}
SELECT run_id, n.theme_id, n_threads, coalesce(array_to_string(proof_ids, ','), '') AS proof_ids,
  CASE WHEN regexp_matches(coalesce(s.statement, ''), '(?i){lex.SELLER_SIDE.replace("'", "''")}') THEN 'seller' WHEN n_words = 0 THEN 'empty' WHEN n_threads < 2 THEN 'decorative' WHEN proof_ids IS NULL THEN 'unevidenced' ELSE 'kept' END AS verdict
FROM n JOIN (SELECT run_id, id AS theme_id, statement FROM {_latest('win_themes', 'run_id, id')}) s USING (run_id, theme_id) LEFT JOIN sup USING (run_id, theme_id)"""
SQL["theme_sections"] = f"""
SELECT run_id, theme_id, section_id, count(*) AS n_shared FROM (SELECT DISTINCT run_id, id AS theme_id, upper(trim(r)) AS requirement_id FROM (SELECT run_id, id, unnest({_JSON}) AS r FROM {_latest('win_themes', 'run_id, id')}) WHERE trim(r) <> '') t
JOIN {_PLACED} p USING (run_id, requirement_id) GROUP BY ALL"""
SQL["retrieval_queries"] = f"""
WITH h AS (SELECT p.run_id, section_id, coalesce(r.text, '') AS text, row_number() OVER (PARTITION BY p.run_id, section_id ORDER BY requirement_id) AS place FROM {_PLACED} p JOIN {_latest('requirements', 'run_id, id')} r ON r.run_id = p.run_id AND r.id = p.requirement_id),
t AS (SELECT run_id, section_id, list(text ORDER BY place) AS t FROM h WHERE place <= 5 GROUP BY ALL)
SELECT s.run_id, s.id AS section_id, left(array_to_string(list_concat([coalesce(title, ''), coalesce(purpose, '')], coalesce(t, [])), ' '), 900) AS query, left(array_to_string(list_slice(coalesce(t, []), 1, 3), ' '), 400) AS paraphrase
FROM {_latest('sections', 'run_id, id')} s LEFT JOIN t ON t.run_id = s.run_id AND t.section_id = s.id"""
_SAYS = f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[*_`]+', '', 'g'), '\\s+', ' ', 'g'))), '[^a-z0-9 ]+', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND NOT list_contains({lex.COMPLIANCE_STOPWORDS}, w)))"
SQL["labelled_matches"] = f"""
WITH r AS (SELECT run_id, id, extracted_by, {_SAYS} AS w FROM {_latest('requirements', 'run_id, id')}),
m AS (SELECT a.run_id, a.id, b.id AS match, len(list_intersect(a.w, b.w)) AS k, len(a.w) AS n, len(b.w) AS m FROM r a JOIN r b ON a.run_id = b.run_id AND a.extracted_by = 'both' AND b.extracted_by = 'cue'),
s AS (SELECT *, k / (n + m - k) AS s FROM m WHERE k > 0 AND k / (n + m - k) >= 0.45 AND k / least(n, m) >= 0.75)
SELECT r.run_id, r.id, min(match) AS first_match, list(match ORDER BY round(s, 6) DESC, match)[1] AS best_match, round(max(s), 6) AS similarity FROM r LEFT JOIN s ON s.run_id = r.run_id AND s.id = r.id WHERE extracted_by = 'both' GROUP BY ALL"""
SQL["statement_conflicts"] = """
WITH v AS (SELECT o_custkey, 'programme duration in months' AS kind, 10 + o_orderkey % 3 AS v FROM orders UNION ALL SELECT o_custkey, 'peak FTE', 20 + o_orderkey % 2 FROM orders)
SELECT o_custkey, kind, count(DISTINCT v)::INT AS n_values, array_to_string(list_sort(list_distinct(list(v))), ',') AS all_values, count(*)::INT AS n_parts FROM v GROUP BY ALL HAVING count(DISTINCT v) > 1"""
SQL["search_decisions"] = _BM25 + f""", rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM (
  SELECT fu.query_id, fu.id, rank, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS score
  FROM fu JOIN (SELECT query_id, {_words('query', lex.QUERY_STOPWORDS)} AS a FROM {_Q}) USING (query_id) JOIN (SELECT id, {_words('text', lex.QUERY_STOPWORDS)} AS b FROM docs) USING (id))),
bd AS (SELECT round(quantile_cont(score, 0.97), 4) AS adapt_min, round(quantile_cont(score, 0.995), 4) AS reuse_min FROM rr WHERE place <= 30),
tp AS (SELECT query_id, max(score) AS s1, max(CASE WHEN place = 2 THEN score END) AS s2, arg_min(id, place) AS id FROM rr GROUP BY query_id)
SELECT query_id, s1 AS best_score, CASE WHEN s2 IS NOT NULL AND s1 > 0 THEN round(greatest(0, least(1, (s1 - s2) / abs(s1))), 4) ELSE 0 END AS confidence, CASE WHEN s1 >= reuse_min THEN 'REUSE' WHEN s1 >= adapt_min THEN 'ADAPT' ELSE 'SYNTHESIZE' END AS decision, source_id FROM tp JOIN docs USING (id), bd"""
_ALL_PAIRS = f"(SELECT {_DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"
SQL["background_all"] = _BOUNDS.replace(_DENSE, _ALL_PAIRS)
SQL["dense_decisions_all"] = SQL["dense_decisions"].replace(_BOUNDS, SQL["background_all"])
SQL["proof_matches_all"] = SQL["proof_matches"].replace(" WHERE regexp_extract(id, '(\\d+)\\D*$', 1)::BIGINT % 50 = 0", "")
SQL["compliance_markdown"] = SQL["compliance_markdown"].replace("p USING (run_id) WHERE FALSE", "p ON p.run_id = r.run_id AND p.requirement_id = r.id").replace("SELECT run_id, '|", "SELECT r.run_id, '|").replace("GROUP BY run_id", "GROUP BY r.run_id")
_FOUND = {"ENTITY_VALUE": SQL["statement_conflicts"], "TABLE_TOTAL": documents.SQL["order_totals"], "PERCENTAGE": documents.SQL["order_reserves"], "DURATION": documents.SQL["order_durations"], "RISK_LANGUAGE": documents.SQL["order_promises"]}
SQL["finding_counts"] = " UNION ALL ".join(f"SELECT '{kind}' AS kind, (SELECT count(*) FROM ({sql})) AS n" for kind, sql in _FOUND.items())
SQL["order_failures"] = f"""
SELECT "order", arg_min(reason, src * 1000 + reason_no) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY "order" ORDER BY src, reason) AS reason_no FROM (
  SELECT "order", 0 AS src, 'TABLE_TOTAL: stated total differs' AS reason FROM ({documents.SQL["order_totals"]}) UNION ALL SELECT "order", 1, 'risk language: ' || label || ' ' || phrase FROM ({documents.SQL["order_promises"]}) WHERE severity = 'BLOCKER')) GROUP BY "order" """
SQL["evaluation"] = f"""
WITH q AS ({SQL["search_quality"].strip()}), r AS ({SQL["labelled_matches"]}), c AS ({SQL["calibration_agreement"].strip()}),
m AS (SELECT 'Recall@5' AS metric, avg(recall_k) AS v, 0.85 AS target FROM q UNION ALL SELECT 'MRR', avg(reciprocal_rank), 0.70 FROM q UNION ALL SELECT 'nDCG@5', avg(ndcg), 0.75 FROM q
  UNION ALL SELECT 'Requirement recall', avg((first_match IS NOT NULL)::INT), 0.90 FROM r UNION ALL SELECT 'Calibration F1', max(f1), 0.50 FROM c)
SELECT metric, round(coalesce(v, 0), 4) AS value, target::DOUBLE AS target, round(coalesce(v, 0), 4) >= target AS passed FROM m"""
_ANSWER_CLAIMS = documents._CLAIMS.replace("run_id, id", "id").replace("content_md", "answer").replace(documents._SEC.replace("run_id, id", "id"), documents._HQ)
SQL["grounding_inputs"] = _ANSWER_CLAIMS + f""", b AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY ix) - 1) // 8 AS batch_no, sentence FROM claims WHERE checkable),
n AS (SELECT id, batch_no, count(*) AS n_sentences, (sum(length(sentence)) + count(*) - 1)::BIGINT AS chars FROM b GROUP BY ALL),
q AS (SELECT query, arg_min_null(relevant_ids, query_id) AS r FROM {_latest('retrieval_pairs', 'query_id')} WHERE query IS NOT NULL GROUP BY query),
c AS (SELECT h.id, upper(trim(unnest(r))) AS source_id FROM {_latest('hq_001_030', 'id')} h JOIN q ON q.query = h.question),
t AS (SELECT upper(trim(source_id)) AS source_id, left(arg_min(text, id), 700) AS text FROM {_latest('chunk', 'id')} WHERE text IS NOT NULL GROUP BY ALL),
s AS (SELECT id, count(*) AS n_sources, sum(length(text))::BIGINT AS source_chars FROM c JOIN t USING (source_id) WHERE source_id <> '' AND text <> '' GROUP BY id)
SELECT id, batch_no, n_sentences, chars, coalesce(n_sources, 0) AS n_sources, coalesce(source_chars, 0) AS source_chars FROM n LEFT JOIN s USING (id)"""
