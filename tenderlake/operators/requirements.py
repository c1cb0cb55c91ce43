"""Requirements: found by their wording, classified by ordered rules, merged by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import lexicon as lex
from tenderlake.functions import text as T

CUES = [("MANDATORY", lex.MANDATORY_CUES), ("WEIGHTED", lex.WEIGHTED_CUES), ("NICE_TO_HAVE", lex.OPTIONAL_CUES)]


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def priority(text: Column) -> Column:
    """Band of the first cue that occurs; null without one."""
    return F.coalesce(*[F.when(_has(text, p), F.lit(name)) for name, p in CUES])


def cue_word(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.lower(F.regexp_extract(text, "(?i)" + p, 0)), F.lit("")) for _, p in CUES])


def section_priority(title: Column) -> Column:
    return F.when(_has(title, lex.SECTION_OPTIONAL), "NICE_TO_HAVE").when(_has(title, lex.SECTION_MANDATORY), "MANDATORY").when(_has(title, lex.SECTION_WEIGHTED), "WEIGHTED")


def plausible(text: Column) -> Column:
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(lex.LONG_REQUIREMENT_ID), F.lit(0)))
    return (T.word_count(text) >= lex.MIN_REQUIREMENT_WORDS) & ~text.rlike(r"\A[-:| ]*\z") & (F.size(ids) <= 1) & ~text.rlike(lex.SCAFFOLDING)


def req_type(text: Column, title: Column, priority_: Column) -> Column:
    blob = F.lower(F.concat(title, F.lit(" "), text))
    return (
        F.when(text.rlike(lex.QUESTION), "EXPLICIT_QUESTION")
        .when(F.lower(title).rlike(lex.SUBMISSION_TITLE), "SUBMISSION_RULE")
        .when(F.lower(title).rlike(lex.EVALUATION_TITLE), "EVAL_CRITERION")
        .when(blob.rlike(lex.SUBMISSION_TEXT), "SUBMISSION_RULE")
        .when(blob.rlike(lex.CONSTRAINT_TEXT), "CONSTRAINT")
        .when(priority_ == "MANDATORY", "SHALL_REQUIREMENT")
        .otherwise("IMPLIED_DELIVERABLE")
    )


def deliverable_form(text: Column, title: Column) -> Column:
    both = F.concat(title, F.lit(" "), text)
    rules = [F.when(_has(blob, p), F.lit(form)) for blob in (text, both) for form, p in lex.FORM_HINTS]
    return F.coalesce(*rules, F.lit("PROSE"))


def candidates(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_ord, ord, text, evidence): labelled lines, table rows and sentences of each node."""
    at = [*keys, "node_ord"]
    line = nodes.select(*at, F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    labelled = line.select(*at, F.lit(0).alias("pass"), "line_no", F.lit(0).alias("pos"), T.normalize(F.regexp_extract("line", lex.LABELLED, 2)).alias("text"), F.concat(F.lit("labelled "), F.regexp_extract("line", lex.LABELLED, 1)).alias("evidence")).where("text <> ''")
    raw = F.regexp_extract("line", lex.TABLE_ROW, 1)
    cells = F.filter(F.transform(F.split(raw, r"\|"), T.normalize), lambda c: ~c.rlike(lex.BLANK_CELL))
    rows = line.where(raw != "").select(*at, "line_no", cells.alias("cells")).where("size(cells) > 0")
    longest = F.aggregate("cells", F.lit(""), lambda best, c: F.when(F.length(c) > F.length(best), c).otherwise(best))
    rid = F.get(F.filter("cells", lambda c: c.rlike(rf"\A{lex.REQUIREMENT_ID}\z")), F.lit(0))
    rows = rows.select(*at, F.lit(1).alias("pass"), "line_no", F.lit(0).alias("pos"), longest.alias("text"), rid.alias("rid"))
    rows = rows.where(F.col("rid").isNotNull() | priority(F.col("text")).isNotNull()).withColumn("evidence", F.concat(F.lit("table row"), F.coalesce(F.concat(F.lit(" "), "rid"), F.lit("")))).drop("rid")
    said = nodes.select(*at, F.posexplode(T.split_sentences(F.col("body"))).alias("line_no", "text"))
    evidence = F.coalesce(
        F.concat(F.lit("cue '"), cue_word(F.col("text")), F.lit("'")),
        F.when(_has(F.col("text"), lex.IMPERATIVE), F.concat(F.lit("imperative '"), F.lower(F.regexp_extract("text", "(?i)" + lex.IMPERATIVE, 1)), F.lit("'"))),
        F.when(_has(F.col("text"), lex.DECLARATIVE_RULE), "declarative submission rule"),
    )
    said = said.select(*at, F.lit(2).alias("pass"), "line_no", F.lit(0).alias("pos"), "text", evidence.alias("evidence")).where("evidence IS NOT NULL")
    every = labelled.unionByName(rows).unionByName(said).where(plausible(F.col("text")))
    order = Window.partitionBy(*at, F.lower("text")).orderBy("pass", "line_no")
    return every.withColumn("n", F.row_number().over(order)).where("n = 1").select(*at, (F.col("pass") * 10_000_000 + F.col("line_no")).alias("ord"), "text", "evidence")


def extract(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Requirements of each document, from the nodes of ``structure.headings``.

    A candidate without a cue needs a label, a table row or an imperative, and takes the priority
    of its section's title. Equal content (``dedupe_key``) counts once, at its first place, with
    the highest priority seen. Ids run R-001, R-002, ... within a document.
    """
    titled = nodes.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("section", F.coalesce("numbering", F.nullif("title", F.lit("")), F.concat(F.lit("n"), F.col("node_ord").cast("string"))))
    c = candidates(titled, keys).join(titled.select(*keys, "node_ord", "title", "section"), [*keys, "node_ord"])
    explicit = F.col("evidence").rlike("^(labelled|table row)")
    directive = _has(F.col("text"), lex.IMPERATIVE) | _has(F.col("text"), lex.DECLARATIVE_RULE)
    said = priority(F.col("text"))
    fallback = F.coalesce(section_priority(F.col("title")), F.when(directive & explicit, "MANDATORY").otherwise("WEIGHTED"))
    c = c.withColumn("said", said).where(F.col("said").isNotNull() | explicit | directive)
    c = c.withColumn("priority", F.coalesce("said", fallback)).withColumn("evidence", F.when(F.col("said").isNull(), F.concat("evidence", F.lit("; no modal cue, priority from section"))).otherwise(F.col("evidence")))
    return merge(c.withColumn("ordinal", F.struct("node_ord", "ord")), keys, "section", "title")


def rank(priority_: Column) -> Column:
    return F.when(priority_ == "MANDATORY", 3).when(priority_ == "WEIGHTED", 2).when(priority_ == "NICE_TO_HAVE", 1).otherwise(0)


def merge(found: DataFrame, keys: list[str], section: str, title: str) -> DataFrame:
    """First of each content, with the highest priority, numbered in order of appearance."""
    first = F.min_by(F.struct("text", "evidence", "priority", F.col(section).alias("section"), F.col(title).alias("title")), "ordinal")
    one = found.withColumn("key", T.dedupe_key(F.col("text"))).groupBy(*keys, "key").agg(first.alias("f"), F.min("ordinal").alias("ordinal"), F.max(rank(F.col("priority"))).alias("top"), F.count(F.lit(1)).alias("n_found"))
    band = F.when(F.col("top") == 3, "MANDATORY").when(F.col("top") == 2, "WEIGHTED").otherwise("NICE_TO_HAVE")
    no = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal"))
    kind = req_type(F.col("f.text"), F.col("f.title"), F.col("f.priority"))
    return one.select(*keys, F.format_string("R-%03d", no).alias("id"), F.col("f.section").alias("source_section"), F.col("f.text").alias("text"), kind.alias("req_type"), band.alias("priority"), deliverable_form(F.col("f.text"), F.col("f.title")).alias("deliverable_form"), F.col("f.evidence").alias("cue_evidence"), "n_found")
