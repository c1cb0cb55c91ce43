"""Checks of written sections: figures, table arithmetic, wording and register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import lexicon as lex
from tenderlake.functions import text as T
from tenderlake.operators.integrity import clean_ref


def facts(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, kind, value): every measurable figure, with repeats."""
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("raws")) for kind, p in lex.MEASURABLE.items()])
    each = docs.where(F.col(text).isNotNull()).select(*keys, F.explode(found).alias("f")).select(*keys, "f.kind", F.explode("f.raws").alias("raw"))
    return each.select(*keys, "kind", T.parse_number(F.col("raw")).alias("value"))


def tracked(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, kind, value): quantities that a document may state only one value of."""

    def found(pattern: str, groups: int):
        each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
        return each[0] if groups == 1 else reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(F.nullif(x, F.lit("")), y)), each)

    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), found(p, n).alias("raws")) for kind, (p, n) in lex.TRACKED.items()])
    each = docs.where(F.col(text).isNotNull()).select(*keys, F.explode(kinds).alias("f")).select(*keys, "f.kind", F.explode("f.raws").alias("raw"))
    return each.select(*keys, "kind", T.parse_number(F.col("raw")).alias("value")).where("value IS NOT NULL")


def tracked_conflicts(docs: DataFrame, scope: list[str], part: str, text: str) -> DataFrame:
    """(scope, kind, n_values, all_values, parts): tracked quantities that the parts of one scope state differently."""
    values = tracked(docs, [*scope, part], text).groupBy(*scope, "kind").agg(F.array_sort(F.collect_set("value")).alias("all_values"), F.array_sort(F.collect_set(part)).alias("parts"))
    return values.where("size(all_values) > 1").select(*scope, "kind", F.size("all_values").alias("n_values"), "all_values", "parts")


def conflicts(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one different value: (keys, n_values, all_values)."""
    one = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("all_values"))
    return one.where("size(all_values) > 1").select(*keys, F.size("all_values").alias("n_values"), "all_values")


def _labelled(cells: DataFrame, keys: list[str]) -> DataFrame:
    row = [*keys, "table_ix", "row_ix"]
    label = F.max(F.when(F.col("col_ix") == 0, F.col("cell"))).over(Window.partitionBy(*row))
    c = cells.withColumn("label", label).withColumn("total", F.col("label").rlike(lex.TOTAL_LABEL)).withColumn("number", T.cell_number(F.col("cell")))
    table = Window.partitionBy(*keys, "table_ix")
    return c.withColumn("n_rows", F.max("row_ix").over(table) + 1).withColumn("head", F.min(F.when(~F.col("total"), F.col("row_ix"))).over(table))


def column_sums(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_ix, col_ix, n_numbers, column_sum) of body rows below the header."""
    body = _labelled(cells, keys).where((F.col("col_ix") >= 1) & ~F.col("total") & (F.col("row_ix") > F.col("head")) & F.col("number").isNotNull())
    return body.groupBy(*keys, "table_ix", "col_ix").agg(F.count(F.lit(1)).alias("n_numbers"), F.round(F.sum("number"), 4).alias("column_sum"))


def table_totals(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Columns whose stated total is not the sum of their values: (keys, table_ix, col_ix, computed, stated).

    Tables need three rows, two of them no totals; columns two numbers. The last total row states.
    """
    c = _labelled(cells, keys).where(F.col("n_rows") >= 3)
    last_total = F.max(F.when(F.col("total"), F.struct("row_ix", "number")))
    body = F.when(~F.col("total") & (F.col("row_ix") > F.col("head")), F.col("number"))
    per = c.where("col_ix >= 1").groupBy(*keys, "table_ix", "col_ix").agg(last_total.alias("t"), F.count(body).alias("n"), F.sum(body).alias("computed"))
    found = per.where((F.col("n") >= 2) & F.col("t.number").isNotNull()).select(*keys, "table_ix", "col_ix", F.round("computed", 4).alias("computed"), F.col("t.number").alias("stated"))
    return found.where(~T.matches(F.col("computed"), F.col("stated")))


def percentage_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows labelled ``(n%)`` whose first number is not n % of the other rows' sum: (keys, table_ix, row_ix, expected, stated)."""
    c = _labelled(cells, keys).where((F.col("n_rows") >= 3) & (F.col("col_ix") == 1))
    c = c.withColumn("pct", T.parse_number(F.nullif(F.regexp_extract("label", rf"\(({lex.NUMBER})\s*%\)", 1), F.lit(""))))
    base = F.when(F.col("pct").isNull() & ~F.col("total") & (F.col("row_ix") > 0), F.col("number"))
    table = Window.partitionBy(*keys, "table_ix")
    c = c.withColumn("base", F.sum(base).over(table)).withColumn("n", F.count(base).over(table))
    c = c.where("pct IS NOT NULL AND number IS NOT NULL AND n >= 2").withColumn("expected", F.round(F.col("base") * F.col("pct") / 100, 4))
    return c.where(~T.matches(F.col("expected"), F.col("number"))).select(*keys, "table_ix", "row_ix", "expected", F.col("number").alias("stated"))


def durations(docs: DataFrame, cells: DataFrame, doc: list[str], keys: list[str], text: str) -> DataFrame:
    """Stated months that disagree with the weeks of the last table that has a week column.

    ``doc`` are the keys of a whole document, ``keys`` those of its parts, ordered by the last of
    them. (doc, implied_months, stated_months), each once.
    """
    c = _labelled(cells, keys)
    week = c.where((F.col("row_ix") == 0) & F.lower("cell").contains("week")).groupBy(*keys, "table_ix").agg(F.min("col_ix").alias("col_ix"))
    col = c.join(week, [*keys, "table_ix", "col_ix"])
    per = col.groupBy(*keys, "table_ix").agg(F.min(F.when(F.col("total"), F.struct("row_ix", "number"))).alias("t"), F.sum(F.when(~F.col("total") & (F.col("row_ix") >= 1), F.col("number"))).alias("s"), F.count(F.when(~F.col("total") & (F.col("row_ix") >= 1), F.col("number"))).alias("n"))
    weeks = per.select(*keys, "table_ix", F.when(F.col("t").isNotNull(), F.col("t.number")).when(F.col("n") >= 2, F.col("s")).alias("weeks")).where("weeks IS NOT NULL AND weeks <> 0")
    last = weeks.groupBy(*doc).agg(F.max_by("weeks", F.struct(*keys, "table_ix")).alias("weeks"))
    stated = docs.select(*doc, F.explode(F.regexp_extract_all(text, F.lit(lex.DURATION_MONTHS), F.lit(1))).alias("raw")).select(*doc, T.parse_number(F.col("raw")).alias("stated_months"))
    both = stated.join(last, doc).withColumn("implied_months", F.round(F.col("weeks") / lex.WEEKS_PER_MONTH, 4))
    return both.where(~T.matches(F.col("implied_months"), F.col("stated_months"), lex.DURATION_TOLERANCE)).select(*doc, "implied_months", "stated_months").distinct()


def risks(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, label, severity, phrase): risky wording, each phrase once for each label."""
    found = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(severity).alias("severity"), F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.lower)).alias("phrases")) for label, severity, p in lex.RISKS])
    each = docs.where(F.col(text).isNotNull()).select(*keys, F.explode(F.filter(found, lambda f: F.size(f["phrases"]) > 0)).alias("f"))
    return each.select(*keys, "f.label", "f.severity", F.explode("f.phrases").alias("phrase")).distinct()


def failures(contradictions: DataFrame, risks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason): the first problem of each part that a new draft could mend.

    ``contradictions`` has the keys, kind and detail, ``risks`` what ``risks`` gives;
    contradictions come before risky wording, of which only blockers count.
    """
    a = contradictions.select(*keys, F.lit(0).alias("src"), F.concat_ws(": ", "kind", "detail").alias("reason"))
    b = risks.where("severity = 'BLOCKER'").select(*keys, F.lit(1).alias("src"), F.concat(F.lit("risk language: "), "label", F.lit(" "), "phrase").alias("reason"))
    return a.unionByName(b).groupBy(*keys).agg(F.min(F.struct("src", "reason")).alias("f")).select(*keys, F.col("f.reason").alias("reason"))


def grounded_rate(verdicts: DataFrame, scope: list[str], ungrounded: str) -> DataFrame:
    """(scope, rate): per cent of the checkable sentences that are not ``ungrounded``."""
    bad = F.count_if(F.coalesce(F.col(ungrounded), F.lit(False)))
    return verdicts.groupBy(*scope).agg(F.round(100 * (1 - bad / F.count(F.lit(1))), 1).alias("rate"))


def voice_drift(docs: DataFrame, scope: list[str], key: str, text: str, sigma: float = lex.VOICE_SIGMA) -> DataFrame:
    """(scope, key, readability, deviation): parts whose readability stands out from their scope's."""
    scored = docs.where(T.word_count(F.col(text)) >= lex.VOICE_MIN_WORDS).select(*scope, key, T.readability(F.col(text)).alias("readability"))
    stats = scored.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg("readability").alias("mean"), F.stddev_pop("readability").alias("spread")).where((F.col("n") >= lex.VOICE_MIN_SECTIONS) & (F.col("spread") >= 1e-6))
    both = scored.join(stats, scope).withColumn("deviation", F.round(F.abs(F.col("readability") - F.col("mean")) / F.col("spread"), 4))
    return both.where(F.col("deviation") >= sigma).select(*scope, key, "readability", "deviation")


def grounding_batches(sentences: DataFrame, scope: list[str], order: list[str], size: int = lex.GROUNDING_BATCH) -> DataFrame:
    """Adds batch_no to checkable sentences: groups of ``size`` in order within their scope."""
    no = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return sentences.where(T.checkable(F.col("sentence"))).withColumn("batch_no", F.floor((no - 1) / size))


def with_sources(batches: DataFrame, citations: DataFrame, keys: list[str], ids: str, chunks: DataFrame) -> DataFrame:
    """(keys, batch_no, sentences, sources): each batch of sentences with the texts its part cites, in order.

    ``batches`` comes from ``grounding_batches`` (keys, ix, sentence, batch_no).
    """
    said = batches.groupBy(*keys, "batch_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "sentence"))), lambda x: x["sentence"]).alias("sentences"))
    cited = cited_texts(citations, keys, ids, chunks).where("text <> ''").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("sources"))
    return said.join(cited, keys, "left").select(*keys, "batch_no", "sentences", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def completeness(sentences: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Parts whose provenance records do not cover their claims one by one.

    ``records`` has the keys and sentence_index. (keys, n_claims, n_records, contiguous, coverage)
    of parts with a defect.
    """
    a = sentences.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_claims"))
    b = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("sentence_index").alias("n_ix"), F.max("sentence_index").alias("top"), F.min("sentence_index").alias("low"))
    both = a.join(b, keys, "full").na.fill(0, ["n_claims", "n_records", "n_ix"])
    ok = (F.col("n_records") == 0) | ((F.col("n_ix") == F.col("n_records")) & (F.col("top") + 1 == F.col("n_records")) & (F.col("low") == 0))
    cover = F.when(F.col("n_claims") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.round(F.col("n_records") / F.col("n_claims"), 4)))
    both = both.select(*keys, "n_claims", "n_records", ok.alias("contiguous"), cover.alias("coverage"))
    return both.where("n_claims <> n_records OR NOT contiguous")


def cited_texts(citations: DataFrame, keys: list[str], ids: str, chunks: DataFrame, chars: int = lex.GROUNDING_SOURCE_CHARS) -> DataFrame:
    """(keys, pos, source_id, text): the first chunk of each cited source, at most ``chars`` long; '' if it is unknown.

    ``chunks`` has id, source_id, text. Sources are compared trimmed and upper-cased; null and
    blank citations are left out, their positions stay.
    """
    cited = citations.select(*keys, F.posexplode(ids).alias("pos", "raw")).withColumn("source_id", clean_ref(F.col("raw"))).where("source_id IS NOT NULL").drop("raw")
    first = chunks.where("text IS NOT NULL").groupBy(clean_ref(F.col("source_id")).alias("source_id")).agg(F.left(F.min_by("text", "id"), F.lit(chars)).alias("text"))
    return cited.join(first, "source_id", "left").select(*keys, "pos", "source_id", F.coalesce("text", F.lit("")).alias("text"))


def named_ids(docs: DataFrame, keys: list[str], text: str, pattern: str, known: DataFrame, key: str) -> DataFrame:
    """(keys, place, id): ids of ``known`` that a text names, each once, in order of first mention."""
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    named = docs.select(*keys, F.posexplode(ids).alias("at", "id")).join(known.select(F.col(key).alias("id")).distinct(), "id")
    return named.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("at")).alias("place"), "id")
