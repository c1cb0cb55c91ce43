"""Queries over texts: structure, chunks, sentences, requirements, wording and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions import lexicon as lex
from tenderlake.functions import text as T
from tenderlake.operators import assurance, chunking, matching, profile, render, structure
from tenderlake.operators import requirements as req
from tenderlake.session import table, texts
from tenderlake.sources import store


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections once each, as delivered first."""
    s = texts(spark, d, "sections").select("run_id", "id", "title", "status", "order_index", "requirement_ids_json", "content_md", "loaded_at")
    return store.latest(s, ["run_id", "id"], "loaded_at")


def _requirements(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "requirements").select("run_id", "id", "source_section", "text", "req_type", "priority", "deliverable_form", "extracted_by", "loaded_at")
    return store.latest(r, ["run_id", "id"], "loaded_at")


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk")
    return c.groupBy("kind").agg(F.countDistinct("id").alias("n_chunks"), F.countDistinct("source_id").alias("n_sources"))


def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d, "documents").where("text IS NOT NULL")
    s = docs.select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.aggregate("s", F.lit(0), lambda a, x: F.greatest(a, F.length(x))).alias("longest"))


def top_terms(spark: SparkSession, d: str) -> DataFrame:
    t = texts(spark, d, "documents").select(F.explode(T.tokenize(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(100)


def heading_tree(spark: SparkSession, d: str) -> DataFrame:
    nodes = structure.headings(texts(spark, d, "documents"), ["doc_id"], "text")
    return nodes.select("doc_id", "node_ord", "level", "title", "parent_ord", F.length("body").alias("body_chars"))


def section_tables(spark: SparkSession, d: str) -> DataFrame:
    cells = structure.table_cells(_sections(spark, d), ["run_id", "id"], "content_md")
    return assurance.column_sums(cells, ["run_id", "id"])


def table_totals(spark: SparkSession, d: str) -> DataFrame:
    cells = structure.table_cells(_sections(spark, d), ["run_id", "id"], "content_md")
    return assurance.table_totals(cells, ["run_id", "id"])


def percentage_rows(spark: SparkSession, d: str) -> DataFrame:
    cells = structure.table_cells(_sections(spark, d), ["run_id", "id"], "content_md")
    return assurance.percentage_rows(cells, ["run_id", "id"])


def phase_durations(spark: SparkSession, d: str) -> DataFrame:
    s = _sections(spark, d)
    return assurance.durations(s, structure.table_cells(s, ["run_id", "order_index", "id"], "content_md"), ["run_id"], ["run_id", "order_index", "id"], "content_md")


def section_facts(spark: SparkSession, d: str) -> DataFrame:
    f = assurance.facts(_sections(spark, d), ["run_id", "id"], "content_md")
    return f.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n_facts"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("largest"))


def claim_counts(spark: SparkSession, d: str) -> DataFrame:
    claims = structure.claim_sentences(_sections(spark, d), ["run_id", "id"], "content_md")
    return claims.groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("n_claims"), F.sum(T.checkable(F.col("sentence")).cast("int")).alias("n_checkable"))


def grounding_batches(spark: SparkSession, d: str) -> DataFrame:
    claims = structure.claim_sentences(_sections(spark, d), ["run_id", "id"], "content_md")
    return assurance.grounding_batches(claims, ["run_id", "id"], ["ix"]).groupBy("run_id", "id", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.min("ix").alias("first_ix"))


def risky_wording(spark: SparkSession, d: str) -> DataFrame:
    answers = store.latest(texts(spark, d, "hq_001_030").select("id", "answer", "loaded_at"), ["id"], "loaded_at")
    return assurance.risks(answers, ["id"], "answer")


def voice_drift(spark: SparkSession, d: str) -> DataFrame:
    return assurance.voice_drift(_sections(spark, d).where("content_md IS NOT NULL"), ["run_id"], "id", "content_md")


def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.markdown_chunks(texts(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_no", "title", F.length("text").alias("chars"))


def qa_chunks(spark: SparkSession, d: str) -> DataFrame:
    hq = store.latest(texts(spark, d, "hq_001_030"), ["id"], "loaded_at")
    c = chunking.qa_chunks(hq)
    return c.select("id", "kind", "text", F.size("metadata").alias("n_fields"))


def proof_chunks(spark: SparkSession, d: str) -> DataFrame:
    proofs = store.latest(table(spark, d, "proof_points"), ["id"], "loaded_at")
    return chunking.proof_chunks(proofs).select("id", "text", "title", F.col("metadata")["strength"].alias("strength"))


def requirement_rules(spark: SparkSession, d: str) -> DataFrame:
    r = _requirements(spark, d)
    text, title = F.coalesce("text", F.lit("")), F.coalesce("source_section", F.lit(""))
    band = req.priority(text)
    return r.select("run_id", "id", band.alias("band"), req.cue_word(text).alias("cue"), req.section_priority(title).alias("section_band"), req.req_type(text, title, band).alias("kind"), req.deliverable_form(text, title).alias("form"), req.plausible(text).alias("plausible"))


def requirement_extract(spark: SparkSession, d: str) -> DataFrame:
    nodes = structure.headings(texts(spark, d, "documents"), ["doc_id"], "text")
    return req.extract(nodes, ["doc_id"]).select("doc_id", "id", "source_section", "text", "req_type", "priority", "deliverable_form", "cue_evidence", "n_found")


def document_rules(spark: SparkSession, d: str) -> DataFrame:
    nodes = structure.headings(texts(spark, d, "documents"), ["doc_id"], "text")
    return profile.rules(nodes, ["doc_id"])


def evaluation_criteria(spark: SparkSession, d: str) -> DataFrame:
    nodes = structure.headings(texts(spark, d, "documents"), ["doc_id"], "text")
    return profile.criteria(nodes, ["doc_id"])


def document_roles(spark: SparkSession, d: str) -> DataFrame:
    return profile.roles(texts(spark, d, "documents").where("text IS NOT NULL"), ["doc_id"], "text")


def requirement_dedupe(spark: SparkSession, d: str) -> DataFrame:
    r = _requirements(spark, d).where("text IS NOT NULL")
    one = r.withColumn("key", T.dedupe_key(F.col("text"))).groupBy("run_id", "key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.max(req.rank(F.col("priority"))).alias("top_rank"), (F.countDistinct("extracted_by") > 1).alias("by_both"))
    return one.select("run_id", "first_id", "n", "top_rank", "by_both")


def section_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = _sections(spark, d).where("title IS NOT NULL")
    w = Window.partitionBy("run_id").orderBy(T.natural_key(F.col("title")), "id")
    return s.select("run_id", "id", F.row_number().over(w).alias("place"))


def outline(spark: SparkSession, d: str) -> DataFrame:
    """One section for each source section of a run, in natural order, long enough for its requirements."""
    from pyspark.sql import Window

    r = _requirements(spark, d).groupBy("run_id", F.coalesce(F.nullif("source_section", F.lit("")), F.lit("Unnumbered")).alias("source_section")).agg(F.count(F.lit(1)).alias("n_requirements"))
    w = Window.partitionBy("run_id").orderBy(T.natural_key(F.col("source_section")), "source_section")
    return r.select("run_id", "source_section", "n_requirements", (F.row_number().over(w) - 1).alias("order_index"), F.greatest(F.lit(250), 120 * F.col("n_requirements")).alias("target_words"))


def narrative_outline(spark: SparkSession, d: str) -> DataFrame:
    """The sections of a narrative response to each run's requirements."""
    return matching.narrative_outline(_requirements(spark, d), ["run_id"])


def outline_modes(spark: SparkSession, d: str) -> DataFrame:
    """COMPLIANCE for runs whose submission rules demand the buyer's own structure, else NARRATIVE."""
    rules = F.when(F.col("req_type") == "SUBMISSION_RULE", F.struct("id", F.coalesce("text", F.lit("")).alias("text")))
    r = _requirements(spark, d).groupBy("run_id").agg(F.sort_array(F.collect_list(rules)).alias("rules"))
    said = F.array_join(F.transform("rules", lambda x: x["text"]), " ")
    return r.select("run_id", F.size("rules").alias("n_rules"), F.when(said.rlike("(?i)" + lex.COMPLIANCE_SIGNALS), "COMPLIANCE").otherwise("NARRATIVE").alias("mode"))


def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the corpus by kind: knowledge base, answers, proofs and templates, with ids that occur more than once."""
    chunks = store.latest(texts(spark, d, "chunk").select("id", "source_id", "kind", "text", "title", "loaded_at"), ["id"], "loaded_at")
    hq = store.latest(texts(spark, d, "hq_001_030"), ["id"], "loaded_at")
    proofs = store.latest(table(spark, d, "proof_points"), ["id"], "loaded_at")
    files = chunks.where("kind = 'TEMPLATE'").select(F.concat(F.lit("tmpl_"), F.replace("id", F.lit("TMPL-"), F.lit(""))).alias("stem"), "text")
    every = chunking.corpus([chunks.where("kind = 'KNOWLEDGE_BASE'"), chunking.qa_chunks(hq), chunking.proof_chunks(proofs), chunking.template_chunks(files)])
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("n_same") > 1).alias("n_repeated"), F.sum(F.length("text")).alias("chars"))


def answer_keys(spark: SparkSession, d: str) -> DataFrame:
    hq = store.latest(texts(spark, d, "hq_001_030").select("id", "question", "category", "loaded_at"), ["id"], "loaded_at")
    return hq.select("id", T.cache_key(F.col("question"), F.col("category")).alias("cache_key"))


def _order_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of each order, a total (off by a tenth for every seventh order) and a reserve of 10 % (wrong for every fifth)."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("no"), F.concat(F.lit("Item "), F.col("l_partkey").cast("string")).alias("item"), F.round("l_quantity", 0).cast("bigint").alias("qty"))
    total = lines.groupBy("order").agg(F.lit(1000).alias("no"), F.lit("TOTAL").alias("item"), F.sum("qty").alias("qty"))
    total = total.withColumn("qty", F.when(F.col("order") % 7 == 0, (F.col("qty") * 1.1 + 1).cast("bigint")).otherwise(F.col("qty")))
    tenth = lines.groupBy("order").agg(F.lit(900).alias("no"), F.lit("Reserve (10%)").alias("item"), (F.sum("qty") / 10).alias("qty"))
    tenth = tenth.withColumn("qty", F.when(F.col("order") % 5 == 0, F.col("qty") * 2 + 1).otherwise(F.col("qty")))
    return lines, total, tenth


def order_totals(spark: SparkSession, d: str) -> DataFrame:
    lines, total, _ = _order_tables(spark, d)
    md = render.table(lines.unionByName(total), ["order"], ["no", "item"], ["Item", "Quantity"], [F.col("item"), F.col("qty")])
    return assurance.table_totals(structure.table_cells(md, ["order"], "markdown"), ["order"]).select("order", "computed", "stated")


def order_reserves(spark: SparkSession, d: str) -> DataFrame:
    lines, _, tenth = _order_tables(spark, d)
    rows = lines.withColumn("qty", F.col("qty").cast("double")).unionByName(tenth.withColumn("qty", F.round("qty", 4)))
    md = render.table(rows, ["order"], ["no", "item"], ["Item", "Quantity"], [F.col("item"), F.col("qty")])
    return assurance.percentage_rows(structure.table_cells(md, ["order"], "markdown"), ["order"]).select("order", "expected", "stated")


def order_durations(spark: SparkSession, d: str) -> DataFrame:
    """Weeks of each customer's orders as a phase table, with a stated duration in months."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("no"), (F.col("o_orderkey") % 9 + 1).alias("weeks"))
    md = render.table(o, ["cust"], ["no"], ["Phase", "Weeks"], [F.concat(F.lit("Phase "), F.col("no").cast("string")), F.col("weeks")])
    months = o.groupBy("cust").agg(F.round(F.sum("weeks") / lex.WEEKS_PER_MONTH, 1).alias("m"))
    said = md.join(months, "cust").withColumn("stated", F.when(F.col("cust") % 4 == 0, F.col("m") * 2).otherwise(F.col("m")))
    docs = said.select("cust", F.concat("markdown", F.lit("\n\nThe programme runs for "), F.col("stated").cast("string"), F.lit(" months.")).alias("text"))
    return assurance.durations(docs, structure.table_cells(docs, ["cust"], "text"), ["cust"], ["cust"], "text")


def order_promises(spark: SparkSession, d: str) -> DataFrame:
    """Risky wording in sentences written for each order."""
    n = F.col("o_orderkey")
    promises = ["We guarantee delivery.", "We guarantee delivery subject to stock.", "100% uptime, no exceptions.", "We accept full responsibility.", "Zero defects and unlimited support.", "Delivered in 3 days."]
    said = F.element_at(F.array(*[F.lit(p) for p in promises]), (n % 6 + 1).cast("int"))
    return assurance.risks(table(spark, d, "orders").select(n.alias("order"), said.alias("text")), ["order"], "text")


def part_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Criteria of an evaluation table written for each brand from its parts, with their sizes as weights."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("no"), "p_name", F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("weight"))
    md = render.table(p, ["brand"], ["no"], ["Criterion", "Weight"], [F.col("p_name"), F.col("weight")])
    docs = md.select("brand", F.concat(F.lit("## Evaluation\n\n"), "markdown").alias("text"))
    return profile.criteria(structure.headings(docs, ["brand"], "text"), ["brand"])


QUERIES = {f.__name__: f for f in (chunk_counts, sentence_stats, top_terms, heading_tree, section_tables, table_totals, percentage_rows, phase_durations, section_facts, claim_counts, grounding_batches, risky_wording, voice_drift, markdown_chunks, qa_chunks, proof_chunks, requirement_rules, requirement_extract, document_rules, evaluation_criteria, document_roles, requirement_dedupe, section_order, outline, narrative_outline, outline_modes, corpus_counts, answer_keys, order_totals, order_reserves, order_durations, order_promises, part_criteria)}

_ABBR = "regexp_replace(trim(regexp_replace(regexp_replace({}, '[*_`]+', '', 'g'), '\\s+', ' ', 'g')), '$', '')"
for _a in lex.ABBREVIATIONS:
    _ABBR = f"replace({_ABBR}, '{_a}', '{_a.replace('.', '§')}')"
_ABBR = f"regexp_replace({_ABBR}, '(\\d)\\.(\\d)', '\\1§\\2', 'g')"
_SENTENCES = f"list_filter(string_split(regexp_replace({_ABBR}, '([.!?])\\s+([A-Z(\\[])', '\\1¦\\2', 'g'), '¦'), lambda x: trim(x) <> '')"
_SEC = "(SELECT DISTINCT ON (run_id, id) * FROM sections ORDER BY run_id, id, loaded_at DESC)"
_REQ = "(SELECT DISTINCT ON (run_id, id) * FROM requirements ORDER BY run_id, id, loaded_at DESC)"
_HQ = "(SELECT DISTINCT ON (id) * FROM hq_001_030 ORDER BY id, loaded_at DESC)"


def _re(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''")


_CELLS = f"""
WITH lines AS (
  SELECT run_id, id, i - 1 AS line_no, trim(l[i], chr(32) || chr(9)) AS s
  FROM (SELECT run_id, id, string_split(replace(content_md, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM {_SEC} WHERE content_md IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)
), runs AS (
  SELECT *, sum(CASE WHEN s LIKE '|%' AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, id ORDER BY line_no) AS run
  FROM (SELECT *, lag(s LIKE '|%') OVER (PARTITION BY run_id, id ORDER BY line_no) AS p FROM lines)
), tab AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, id, run ORDER BY line_no) - 1 AS row_ix, dense_rank() OVER (PARTITION BY run_id, id ORDER BY run) - 1 AS table_ix
  FROM runs WHERE s LIKE '|%' AND NOT regexp_matches(s, '^\\s*\\|[\\s:|-]+\\|\\s*$') AND regexp_matches(s, '^\\|.+\\|$')
), cells AS (
  SELECT run_id, id, table_ix, row_ix, i - 1 AS col_ix, trim(c[i]) AS cell, trim(c[1]) AS label
  FROM (SELECT *, string_split(regexp_extract(s, '^\\|(.+)\\|$', 1), '|') AS c FROM tab), unnest(range(1, len(c) + 1)) AS u(i)
), num AS (
  SELECT *, regexp_matches(label, '(?i)\\b(total|sum|grand total)\\b') AS total,
    TRY_CAST(replace(nullif(regexp_extract(trim(regexp_replace(cell, '[*₹€]', '', 'g')), '^(-?\\d[\\d,]*(?:\\.\\d+)?)\\s*%?$', 1), ''), ',', '') AS DOUBLE) AS number,
    max(row_ix) OVER (PARTITION BY run_id, id, table_ix) + 1 AS n_rows FROM cells
), headed AS (SELECT *, min(CASE WHEN NOT total THEN row_ix END) OVER (PARTITION BY run_id, id, table_ix) AS head FROM num)
"""
_OFF = "NOT (abs({a} - {b}) <= 0.01 OR abs({a} - {b}) / greatest(abs({a}), abs({b}), 1.0) <= 0.02)"
_FACT = " UNION ALL ".join(f"SELECT run_id, '{k}' AS kind, unnest(regexp_extract_all(content_md, '{p}', 1)) AS raw FROM {_SEC}" for k, p in lex.MEASURABLE.items())
_SYL = "CASE WHEN w = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 AND w NOT LIKE '%le' AND w NOT LIKE '%ee' THEN 1 ELSE 0 END) END"
_FORMS = " ".join(f"WHEN regexp_matches({{}}, '{_re(p)}') THEN '{f}'" for f, p in lex.FORM_HINTS)

_LINES = "(SELECT l_orderkey, round(l_quantity)::BIGINT AS q FROM lineitem)"

SQL = {
    "order_totals": f"""SELECT l_orderkey AS "order", computed, stated FROM (SELECT l_orderkey, sum(q)::DOUBLE AS computed,
  (CASE WHEN l_orderkey % 7 = 0 THEN floor(sum(q) * 1.1 + 1) ELSE sum(q) END)::DOUBLE AS stated, count(*) AS n FROM {_LINES} GROUP BY l_orderkey) WHERE n >= 2 AND {_OFF.format(a='computed', b='stated')}""",
    "order_reserves": f"""SELECT l_orderkey AS "order", expected, stated FROM (SELECT l_orderkey, round(sum(q) / 10, 4) AS expected,
  round(CASE WHEN l_orderkey % 5 = 0 THEN sum(q) / 10 * 2 + 1 ELSE sum(q) / 10 END, 4) AS stated, count(*) AS n FROM {_LINES} GROUP BY l_orderkey) WHERE n >= 2 AND {_OFF.format(a='expected', b='stated')}""",
    "order_durations": f"""SELECT cust, round(w / 4.345, 4) AS implied_months, stated AS stated_months FROM (SELECT o_custkey AS cust, sum(o_orderkey % 9 + 1) AS w, count(*) AS n,
  CASE WHEN o_custkey % 4 = 0 THEN round(sum(o_orderkey % 9 + 1) / 4.345, 1) * 2 ELSE round(sum(o_orderkey % 9 + 1) / 4.345, 1) END AS stated FROM orders GROUP BY o_custkey)
  WHERE n >= 2 AND {_OFF.format(a='w / 4.345', b='stated').replace('0.02', '0.12')}""",
    "chunk_counts": "SELECT kind, count(DISTINCT id) AS n_chunks, count(DISTINCT source_id) AS n_sources FROM chunk GROUP BY kind",
    "sentence_stats": f"SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(trim(x)))), 0) AS longest FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents WHERE text IS NOT NULL)",
    "top_terms": "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 100",
    "section_tables": _CELLS + "SELECT run_id, id, table_ix, col_ix, count(*) AS n_numbers, round(sum(number), 4) AS column_sum FROM headed WHERE col_ix >= 1 AND NOT total AND row_ix > head AND number IS NOT NULL GROUP BY ALL",
    "table_totals": _CELLS + f"""SELECT * FROM (SELECT run_id, id, table_ix, col_ix, round(sum(CASE WHEN NOT total AND row_ix > head THEN number END), 4) AS computed,
  arg_max(number, row_ix) FILTER (total) AS stated, count(CASE WHEN NOT total AND row_ix > head THEN number END) AS n FROM headed WHERE n_rows >= 3 AND col_ix >= 1 GROUP BY ALL)
  SELECT_COLS WHERE n >= 2 AND stated IS NOT NULL AND {_OFF.format(a='computed', b='stated')}""".replace("SELECT * FROM (", "SELECT run_id, id, table_ix, col_ix, computed, stated FROM (").replace("SELECT_COLS", ""),
    "section_facts": f"SELECT run_id, kind, count(*) AS n_facts, round(sum(v), 2) AS total, max(v) AS largest FROM (SELECT run_id, kind, TRY_CAST(replace(raw, ',', '') AS DOUBLE) AS v FROM ({_FACT})) GROUP BY ALL",
    "voice_drift": f"""
WITH s AS (SELECT run_id, id, content_md FROM {_SEC} WHERE len(list_filter(regexp_split_to_array(content_md, '\\s+'), lambda x: x <> '')) >= 60),
w AS (SELECT run_id, id, len({_SENTENCES.format("regexp_replace(content_md, '(?m)^#+\\s.*$', '', 'g')")}) AS ns, list_transform(regexp_extract_all(content_md, '[A-Za-z'']+'), lambda x: regexp_replace(lower(x), '^''+|''+$', '', 'g')) AS ws FROM s),
v AS (SELECT run_id, id, CASE WHEN ns > 0 AND len(ws) > 0 THEN round(round(206.835 - 1.015 * (len(ws) / ns) - 84.6 * (list_sum(list_transform(ws, lambda w: {_SYL})) / len(ws)), 6), 2) ELSE 0 END AS readability FROM w),
st AS (SELECT run_id, count(*) AS n, avg(readability) AS mean, stddev_pop(readability) AS spread FROM v GROUP BY run_id)
SELECT run_id, id, readability, round(abs(readability - mean) / spread, 4) AS deviation FROM v JOIN st USING (run_id) WHERE n >= 4 AND spread >= 1e-6 AND round(abs(readability - mean) / spread, 4) >= 1.8""",
    "qa_chunks": f"SELECT id, 'HISTORICAL_QA' AS kind, 'Q: ' || coalesce(question, '') || chr(10) || chr(10) || 'A: ' || coalesce(answer, '') AS text, (category IS NOT NULL)::INT + (owner_dept IS NOT NULL)::INT + (client_industry IS NOT NULL)::INT + (status IS NOT NULL)::INT + (date_approved IS NOT NULL)::INT AS n_fields FROM {_HQ}",
    "proof_chunks": "SELECT id, 'Claim: ' || coalesce(claim, '') || chr(10) || chr(10) || 'Evidence: ' || coalesce(evidence, '') || CASE WHEN verifiable_source <> '' THEN chr(10) || chr(10) || 'Source: ' || verifiable_source ELSE '' END AS text, left(claim, 120) AS title, coalesce(strength, '') AS strength FROM (SELECT DISTINCT ON (id) * FROM proof_points ORDER BY id, loaded_at DESC)",
    "requirement_rules": f"""
WITH r AS (SELECT run_id, id, coalesce(text, '') AS t, coalesce(source_section, '') AS s FROM {_REQ}),
b AS (SELECT *, CASE WHEN regexp_matches(t, '{_re(lex.MANDATORY_CUES)}') THEN 'MANDATORY' WHEN regexp_matches(t, '{_re(lex.WEIGHTED_CUES)}') THEN 'WEIGHTED' WHEN regexp_matches(t, '{_re(lex.OPTIONAL_CUES)}') THEN 'NICE_TO_HAVE' END AS band FROM r)
SELECT run_id, id, band,
  CASE band WHEN 'MANDATORY' THEN lower(regexp_extract(t, '{_re(lex.MANDATORY_CUES)}')) WHEN 'WEIGHTED' THEN lower(regexp_extract(t, '{_re(lex.WEIGHTED_CUES)}')) WHEN 'NICE_TO_HAVE' THEN lower(regexp_extract(t, '{_re(lex.OPTIONAL_CUES)}')) END AS cue,
  CASE WHEN regexp_matches(s, '{_re(lex.SECTION_OPTIONAL)}') THEN 'NICE_TO_HAVE' WHEN regexp_matches(s, '{_re(lex.SECTION_MANDATORY)}') THEN 'MANDATORY' WHEN regexp_matches(s, '{_re(lex.SECTION_WEIGHTED)}') THEN 'WEIGHTED' END AS section_band,
  CASE WHEN regexp_matches(t, '\\?\\s*$') THEN 'EXPLICIT_QUESTION' WHEN regexp_matches(lower(s), '{lex.SUBMISSION_TITLE}') THEN 'SUBMISSION_RULE' WHEN regexp_matches(lower(s), '{lex.EVALUATION_TITLE}') THEN 'EVAL_CRITERION'
    WHEN regexp_matches(lower(s || ' ' || t), '{lex.SUBMISSION_TEXT}') THEN 'SUBMISSION_RULE' WHEN regexp_matches(lower(s || ' ' || t), '{lex.CONSTRAINT_TEXT}') THEN 'CONSTRAINT' WHEN band = 'MANDATORY' THEN 'SHALL_REQUIREMENT' ELSE 'IMPLIED_DELIVERABLE' END AS kind,
  CASE {_FORMS.replace('{}', 't')} {_FORMS.replace('{}', "(s || ' ' || t)")} ELSE 'PROSE' END AS form,
  len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) >= 4 AND NOT regexp_matches(t, '^[-:| ]*$') AND len(list_distinct(regexp_extract_all(t, '{lex.LONG_REQUIREMENT_ID}'))) <= 1 AND NOT regexp_matches(t, '(^|\\s)---+(\\s|$)|(^|\\s)###?\\s') AS plausible
FROM b""",
    "requirement_dedupe": f"""
SELECT run_id, min(id) AS first_id, count(*) AS n, max(CASE priority WHEN 'MANDATORY' THEN 3 WHEN 'WEIGHTED' THEN 2 WHEN 'NICE_TO_HAVE' THEN 1 ELSE 0 END) AS top_rank, count(DISTINCT extracted_by) > 1 AS by_both
FROM (SELECT *, left(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(text, '[*_`]+', '', 'g'), '\\s+', ' ', 'g'))), '{lex.DEDUPE_WORDS}', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+'), lambda x: x <> ''))), ' '), 220) AS key FROM {_REQ} WHERE text IS NOT NULL)
GROUP BY run_id, key""",
    "section_order": f"""
SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY len(n) = 0, n, CASE WHEN len(n) = 0 THEN title ELSE '' END, id) AS place
FROM (SELECT run_id, id, title, list_transform(regexp_extract_all(title, '\\d+'), lambda x: x::BIGINT) AS n FROM {_SEC} WHERE title IS NOT NULL)""",
    "outline": f"""
SELECT run_id, source_section, n_requirements, row_number() OVER (PARTITION BY run_id ORDER BY len(k) = 0, k, CASE WHEN len(k) = 0 THEN source_section ELSE '' END, source_section) - 1 AS order_index, greatest(250, 120 * n_requirements) AS target_words
FROM (SELECT run_id, coalesce(nullif(source_section, ''), 'Unnumbered') AS source_section, count(*) AS n_requirements, list_transform(regexp_extract_all(coalesce(nullif(source_section, ''), 'Unnumbered'), '\\d+'), lambda x: x::BIGINT) AS k FROM {_REQ} GROUP BY ALL)""",
    "document_roles": f"""
WITH f AS (SELECT doc_id, generate_subscripts(r, 1) AS p, unnest(r) AS role FROM (SELECT doc_id, regexp_extract_all(trim(regexp_replace(regexp_replace(text, '[*_`]+', '', 'g'), '\\s+', ' ', 'g')), '(?i){lex.ROLE}', 1) AS r FROM documents WHERE text IS NOT NULL)),
o AS (SELECT doc_id, lower(trim(role)) AS k, min(p) AS p, trim(arg_min(role, p)) AS role FROM f GROUP BY doc_id, lower(trim(role)))
SELECT doc_id, place, role FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS place, role FROM o) WHERE place <= {lex.ROLE_CAP}""",
    "answer_keys": f"SELECT id, sha256(coalesce(question, '') || chr(0) || coalesce(category, '') || chr(0)) AS cache_key FROM {_HQ}",
    "heading_tree": """
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, s[i] AS line, regexp_extract(s[i], '^(#{1,6})\\s+(.*?)\\s*$', 1) AS h, regexp_extract(s[i], '^(#{1,6})\\s+(.*?)\\s*$', 2) AS head
  FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) AS u(i)
), k AS (SELECT *, sum(CASE WHEN h <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM l)
, g AS (
  SELECT doc_id, island, max(length(h)) AS level, max(CASE WHEN h <> '' THEN head END) AS head, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (h = ''), ''), '^\\s+|\\s+$', '', 'g') AS body
  FROM k GROUP BY ALL
), a AS (SELECT *, max(island) OVER (PARTITION BY doc_id) > 0 AS heads FROM g)
, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS node_ord, CASE WHEN heads THEN level ELSE 1 END AS lv, trim(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')[1]) AS first_line FROM a WHERE island > 0 OR NOT heads OR body <> '')
SELECT doc_id, node_ord, lv AS level,
  CASE WHEN island = 0 THEN CASE WHEN first_line IS NOT NULL AND len(list_filter(regexp_split_to_array(first_line, '\\s+'), lambda x: x <> '')) <= 14 AND NOT regexp_matches(first_line, '[.;,]$') THEN first_line ELSE 'Untitled section' END
    WHEN regexp_extract(head, '^\\s*((?:\\d+|[A-Z])(?:\\.\\d+)*)[.)]?\\s+(.*)$', 1) <> '' THEN regexp_extract(head, '^\\s*((?:\\d+|[A-Z])(?:\\.\\d+)*)[.)]?\\s+(.*)$', 2) ELSE head END AS title,
  (SELECT max(p.node_ord) FROM f p WHERE p.doc_id = f.doc_id AND p.node_ord < f.node_ord AND p.lv < f.lv) AS parent_ord, length(body) AS body_chars
FROM f""",
}

_CLAIMS = f"""
WITH lines AS (
  SELECT run_id, id, i AS line_no, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS s
  FROM (SELECT run_id, id, string_split(replace(replace(content_md, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM {_SEC} WHERE content_md IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)
), fenced AS (SELECT *, s LIKE '```%' AS fence, sum(CASE WHEN s LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, id ORDER BY line_no) % 2 = 1 AS inside FROM lines)
, live AS (SELECT *, regexp_matches(s, '{lex.TABLE_SEPARATOR}') AS sep FROM fenced WHERE NOT fence AND NOT inside AND s <> '')
, heads AS (SELECT *, s LIKE '|%' AND coalesce(lead(sep) OVER (PARTITION BY run_id, id ORDER BY line_no), false) AS header FROM live)
, parts AS (
  SELECT run_id, id, line_no, CASE WHEN s LIKE '|%' THEN [trim(regexp_replace(regexp_replace(s, '[*_`]+', '', 'g'), '\\s+', ' ', 'g'))]
    ELSE list_transform({_SENTENCES.format("regexp_replace(s, '^\\s*([-*+]|[0-9]+[.)])\\s+', '')")}, lambda x: trim(replace(x, '§', '.'))) END AS p
  FROM heads WHERE NOT sep AND NOT header AND NOT regexp_matches(s, '^#{{1,6}}\\s')
), said AS (SELECT run_id, id, line_no, i AS pos, p[i] AS sentence FROM parts, unnest(range(1, len(p) + 1)) AS u(i) WHERE p[i] <> '')
, claims AS (SELECT *, row_number() OVER (PARTITION BY run_id, id ORDER BY line_no, pos) - 1 AS ix,
    len(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda w: w <> '')) >= 4 AND (regexp_matches(sentence, '{lex.CHECKABLE}') OR regexp_matches(sentence, '{lex.ACRONYM}')) AS checkable FROM said)
"""
SQL["claim_counts"] = _CLAIMS + "SELECT run_id, id, count(*) AS n_claims, sum(checkable::INT)::BIGINT AS n_checkable FROM claims GROUP BY ALL"
SQL["grounding_batches"] = _CLAIMS + "SELECT run_id, id, batch_no, count(*) AS n, min(ix) AS first_ix FROM (SELECT *, (row_number() OVER (PARTITION BY run_id, id ORDER BY ix) - 1) // 8 AS batch_no FROM claims WHERE checkable) GROUP BY ALL"
_NODES = f"({SQL['heading_tree'].replace('length(body) AS body_chars', 'body')})"
SQL["document_rules"] = f"""
WITH said AS (SELECT doc_id, node_ord, title, i AS pos, trim(replace(p[i], '§', '.')) AS sentence FROM (SELECT doc_id, node_ord, coalesce(title, '') AS title, {_SENTENCES.format('body')} AS p FROM {_NODES}), unnest(range(1, len(p) + 1)) AS u(i)),
n AS (SELECT *, len(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda w: w <> '')) AS words, left(regexp_replace(lower(sentence), '[^a-z0-9 ]', '', 'g'), 120) AS key FROM said),
k AS (
  SELECT 'submission' AS kind, * FROM n WHERE words >= 4 AND regexp_matches(title, '{_re(lex.SUBMISSION_SECTION)}')
  UNION ALL SELECT 'constraint', * FROM n WHERE words >= 4 AND regexp_matches(sentence, '{_re(lex.CONSTRAINT)}')
  UNION ALL SELECT 'red_line', * FROM n WHERE words >= 3 AND regexp_matches(sentence, '{_re(lex.RED_LINE)}')
), o AS (SELECT doc_id, kind, key, min(node_ord * 1000000 + pos) AS ord, arg_min(sentence, node_ord * 1000000 + pos) AS sentence FROM k GROUP BY ALL)
SELECT doc_id, kind, place, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY ord) AS place FROM o) WHERE place <= {lex.RULE_CAP}"""
_HITS = ", ".join(f"len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\\b(?:{'|'.join(w)})'))) + CASE WHEN aff = '{t}' THEN 0.5 ELSE 0 END" for t, _, w in lex.NARRATIVE_SPINE if w)
_KEYED = [t for t, _, w in lex.NARRATIVE_SPINE if w]
_SPINE = ", ".join(f"({i}, '{t}', {w})" for i, (t, w, _) in enumerate(lex.NARRATIVE_SPINE))
SQL["narrative_outline"] = f"""
WITH a AS (SELECT run_id, req_type, text, CASE deliverable_form {' '.join(f"WHEN '{f}' THEN '{t}'" for f, t in lex.FORM_AFFINITY.items())} END AS aff FROM {_REQ}),
h AS (SELECT *, [{_HITS}] AS s FROM a),
b AS (SELECT run_id, CASE WHEN req_type = 'SUBMISSION_RULE' THEN 'Submission compliance' WHEN list_max(s) > 0 THEN {_KEYED}[list_position(s, list_max(s))] ELSE coalesce(aff, 'Additional requirements') END AS title FROM h),
n AS (SELECT run_id, title, count(*) AS n_requirements FROM b GROUP BY ALL UNION ALL SELECT DISTINCT run_id, 'Executive summary', 0 FROM a)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY spine_no) - 1 AS order_index, title, n_requirements, greatest(least_words, 110 * n_requirements) AS target_words FROM n JOIN (VALUES {_SPINE}) AS v(spine_no, title, least_words) USING (title)"""
SQL["outline_modes"] = f"""SELECT run_id, count(*) FILTER (req_type = 'SUBMISSION_RULE') AS n_rules,
  CASE WHEN regexp_matches(coalesce(string_agg(coalesce(text, ''), ' ' ORDER BY id) FILTER (req_type = 'SUBMISSION_RULE'), ''), '{_re(lex.COMPLIANCE_SIGNALS)}') THEN 'COMPLIANCE' ELSE 'NARRATIVE' END AS mode FROM {_REQ} GROUP BY run_id"""
SQL["corpus_counts"] = f"""
WITH c AS (SELECT DISTINCT ON (id) * FROM chunk ORDER BY id, loaded_at DESC),
e AS (SELECT id, kind, text FROM c WHERE kind = 'KNOWLEDGE_BASE' UNION ALL SELECT id, 'HISTORICAL_QA', 'Q: ' || coalesce(question, '') || chr(10) || chr(10) || 'A: ' || coalesce(answer, '') FROM {_HQ}
  UNION ALL SELECT id, 'PROOF_POINT', text FROM ({SQL['proof_chunks']}) UNION ALL SELECT id, kind, regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM c WHERE kind = 'TEMPLATE' AND regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> '')
SELECT kind, count(*) AS n_chunks, count(*) FILTER (n > 1) AS n_repeated, sum(length(text))::BIGINT AS chars FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM e) GROUP BY kind"""
SQL["order_promises"] = """
SELECT o_orderkey AS "order", label, severity, phrase FROM orders JOIN (VALUES (0, 'unqualified guarantee', 'BLOCKER', 'we guarantee'), (2, 'absolute performance claim', 'BLOCKER', '100% uptime'), (2, 'absolute commitment', 'WARN', 'no exceptions'),
  (3, 'unbounded responsibility', 'BLOCKER', 'we accept full responsibility'), (4, 'absolute quality claim', 'BLOCKER', 'zero defects'), (4, 'unbounded liability', 'BLOCKER', 'unlimited support')) AS v(m, label, severity, phrase) ON o_orderkey % 6 = m"""
SQL["part_criteria"] = """
SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY no) AS place, name, weight FROM (SELECT p_brand AS brand, min(p_partkey) AS no, trim(regexp_replace(arg_min(p_name, p_partkey), '\\s+', ' ', 'g')) AS name, arg_min(p_size, p_partkey)::DOUBLE AS weight FROM part GROUP BY p_brand, lower(p_name))"""
_NUMBERED = SQL["heading_tree"].replace("length(body) AS body_chars", f"body, nullif(regexp_extract(head, '{lex.NUMBERING}', 1), '') AS numbering")
_NORMAL = "trim(regexp_replace(regexp_replace({}, '[*_`]+', '', 'g'), '\\s+', ' ', 'g'))"
_BAND = f"CASE WHEN regexp_matches(t, '{_re(lex.MANDATORY_CUES)}') THEN 'MANDATORY' WHEN regexp_matches(t, '{_re(lex.WEIGHTED_CUES)}') THEN 'WEIGHTED' WHEN regexp_matches(t, '{_re(lex.OPTIONAL_CUES)}') THEN 'NICE_TO_HAVE' END"
_CUE = f"coalesce(nullif(lower(regexp_extract(t, '{_re(lex.MANDATORY_CUES)}')), ''), nullif(lower(regexp_extract(t, '{_re(lex.WEIGHTED_CUES)}')), ''), nullif(lower(regexp_extract(t, '{_re(lex.OPTIONAL_CUES)}')), ''))"
_KEY = f"left(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({_NORMAL.format('t')}), '{lex.DEDUPE_WORDS}', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+'), lambda x: x <> ''))), ' '), 220)"
SQL["requirement_extract"] = f"""
WITH nodes AS (SELECT doc_id, node_ord, coalesce(title, '') AS title, coalesce(numbering, nullif(coalesce(title, ''), ''), 'n' || node_ord) AS section, body FROM ({_NUMBERED})),
line AS (SELECT doc_id, node_ord, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, node_ord, string_split(body, chr(10)) AS l FROM nodes), unnest(range(1, len(l) + 1)) AS u(i)),
lab AS (SELECT doc_id, node_ord, 0 AS pass, line_no, {_NORMAL.format(f"regexp_extract(line, '{lex.LABELLED}', 2)")} AS t, 'labelled ' || regexp_extract(line, '{lex.LABELLED}', 1) AS evidence FROM line),
cells AS (SELECT doc_id, node_ord, line_no, list_filter(list_transform(string_split(regexp_extract(line, '{lex.TABLE_ROW}', 1), '|'), lambda c: {_NORMAL.format('c')}), lambda c: NOT regexp_matches(c, '^[-: ]*$')) AS c FROM line WHERE regexp_extract(line, '{lex.TABLE_ROW}', 1) <> ''),
rowed AS (SELECT doc_id, node_ord, 1 AS pass, line_no, list_filter(c, lambda x: length(x) = list_max(list_transform(c, lambda y: length(y))))[1] AS t, list_filter(c, lambda x: regexp_full_match(x, '{lex.REQUIREMENT_ID}'))[1] AS rid FROM cells WHERE len(c) > 0),
sents AS (SELECT doc_id, node_ord, 2 AS pass, i - 1 AS line_no, trim(replace(p[i], '§', '.')) AS t FROM (SELECT doc_id, node_ord, {_SENTENCES.format('body')} AS p FROM nodes), unnest(range(1, len(p) + 1)) AS u(i)),
cued AS (
  SELECT doc_id, node_ord, pass, line_no, t, coalesce('cue ' || chr(39) || {_CUE} || chr(39), 'imperative ' || chr(39) || nullif(lower(regexp_extract(t, '{_re(lex.IMPERATIVE)}', 1)), '') || chr(39), CASE WHEN regexp_matches(t, '{_re(lex.DECLARATIVE_RULE)}') THEN 'declarative submission rule' END) AS evidence FROM sents
), every AS (
  SELECT * FROM lab WHERE t <> ''
  UNION ALL SELECT doc_id, node_ord, pass, line_no, t, 'table row' || coalesce(' ' || rid, '') FROM rowed WHERE rid IS NOT NULL OR {_BAND} IS NOT NULL
  UNION ALL SELECT * FROM cued WHERE evidence IS NOT NULL
), good AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, node_ord, lower(t) ORDER BY pass, line_no) AS n, pass * 10000000 + line_no AS ord FROM every
  WHERE len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) >= {lex.MIN_REQUIREMENT_WORDS} AND NOT regexp_matches(t, '^[-:| ]*$') AND len(list_distinct(regexp_extract_all(t, '{lex.LONG_REQUIREMENT_ID}'))) <= 1 AND NOT regexp_matches(t, '{lex.SCAFFOLDING}')
), c AS (
  SELECT g.*, title AS s, section, {_BAND} AS said, regexp_matches(evidence, '^(labelled|table row)') AS explicit, regexp_matches(t, '{_re(lex.IMPERATIVE)}') OR regexp_matches(t, '{_re(lex.DECLARATIVE_RULE)}') AS directive FROM good g JOIN nodes USING (doc_id, node_ord) WHERE n = 1
), k AS (
  SELECT doc_id, node_ord * 100000000 + ord AS at_ord, t, s, section, evidence || CASE WHEN said IS NULL THEN '; no modal cue, priority from section' ELSE '' END AS evidence, {_KEY} AS key,
    coalesce(said, CASE WHEN regexp_matches(s, '{_re(lex.SECTION_OPTIONAL)}') THEN 'NICE_TO_HAVE' WHEN regexp_matches(s, '{_re(lex.SECTION_MANDATORY)}') THEN 'MANDATORY' WHEN regexp_matches(s, '{_re(lex.SECTION_WEIGHTED)}') THEN 'WEIGHTED' END, CASE WHEN directive AND explicit THEN 'MANDATORY' ELSE 'WEIGHTED' END) AS band
  FROM c WHERE said IS NOT NULL OR explicit OR directive
), f AS (
  SELECT doc_id, key, min(at_ord) AS at_ord, arg_min(t, at_ord) AS t, arg_min(s, at_ord) AS s, arg_min(section, at_ord) AS section, arg_min(evidence, at_ord) AS evidence, arg_min(band, at_ord) AS band, max(CASE band WHEN 'MANDATORY' THEN 3 WHEN 'WEIGHTED' THEN 2 ELSE 1 END) AS top, count(*) AS n_found FROM k GROUP BY doc_id, key
)
SELECT doc_id, 'R-' || CASE WHEN no < 1000 THEN lpad(no::VARCHAR, 3, '0') ELSE no::VARCHAR END AS id, section AS source_section, t AS text,
  CASE WHEN regexp_matches(t, '\\?\\s*$') THEN 'EXPLICIT_QUESTION' WHEN regexp_matches(lower(s), '{lex.SUBMISSION_TITLE}') THEN 'SUBMISSION_RULE' WHEN regexp_matches(lower(s), '{lex.EVALUATION_TITLE}') THEN 'EVAL_CRITERION'
    WHEN regexp_matches(lower(s || ' ' || t), '{lex.SUBMISSION_TEXT}') THEN 'SUBMISSION_RULE' WHEN regexp_matches(lower(s || ' ' || t), '{lex.CONSTRAINT_TEXT}') THEN 'CONSTRAINT' WHEN band = 'MANDATORY' THEN 'SHALL_REQUIREMENT' ELSE 'IMPLIED_DELIVERABLE' END AS req_type,
  CASE top WHEN 3 THEN 'MANDATORY' WHEN 2 THEN 'WEIGHTED' ELSE 'NICE_TO_HAVE' END AS priority,
  CASE {_FORMS.replace('{}', 't')} {_FORMS.replace('{}', "(s || ' ' || t)")} ELSE 'PROSE' END AS deliverable_form, evidence AS cue_evidence, n_found
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY at_ord) AS no FROM f)"""
