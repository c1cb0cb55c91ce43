"""What the author of a document asks of its readers: rules, limits, red lines, criteria, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import lexicon as lex
from tenderlake.functions import text as T

RULE_KINDS = ["submission", "constraint", "red_line"]


def rules(nodes: DataFrame, keys: list[str], cap: int = lex.RULE_CAP) -> DataFrame:
    """(keys, kind, place, sentence): sentences of each kind in order, equal ones once.

    ``nodes`` are those of ``structure.headings``. Submission rules are sentences of submission
    sections; constraints and red lines are known by their wording. At most ``cap`` of a kind are
    reported for a document, as that is what the profile holds.
    """
    said = nodes.select(*keys, "node_ord", F.coalesce("title", F.lit("")).alias("title"), F.posexplode(T.split_sentences(F.col("body"))).alias("at", "sentence"))
    n = T.word_count(F.col("sentence"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("title").rlike("(?i)" + lex.SUBMISSION_SECTION) & (n >= 4), "submission"),
            F.when(F.col("sentence").rlike("(?i)" + lex.CONSTRAINT) & (n >= 4), "constraint"),
            F.when(F.col("sentence").rlike("(?i)" + lex.RED_LINE) & (n >= 3), "red_line"),
        )
    )
    key = F.left(F.regexp_replace(F.lower("sentence"), "[^a-z0-9 ]", ""), F.lit(120))
    long = said.select(*keys, F.struct("node_ord", "at").alias("ord"), "sentence", key.alias("key"), F.explode(kinds).alias("kind"))
    once = long.groupBy(*keys, "kind", "key").agg(F.min(F.struct("ord", "sentence")).alias("first"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("first.ord")))
    return placed.where(F.col("place") <= cap).select(*keys, "kind", "place", F.col("first.sentence").alias("sentence"))


def criteria(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, name, weight): evaluation criteria from table rows.

    The first cell names, the first other one with a per cent or points value weighs. Outside
    evaluation sections a row needs a weight. Header names and requirement ids are no criteria.
    """
    line = nodes.select(*keys, "node_ord", F.coalesce("title", F.lit("")).alias("title"), F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    raw = F.regexp_extract("line", lex.TABLE_ROW, 1)
    cells = F.filter(F.transform(F.split(raw, r"\|"), T.normalize), lambda c: ~c.rlike(lex.BLANK_CELL))
    rows = line.where(raw != "").select(*keys, "node_ord", "title", "line_no", cells.alias("cells")).where("size(cells) >= 2")
    number = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, lex.PERCENT_WEIGHT, 1), F.lit("")), F.nullif(F.regexp_extract(c, lex.POINTS_WEIGHT, 1), F.lit(""))).try_cast("double")
    weights = F.filter(F.transform(F.slice("cells", F.lit(2), F.greatest(F.size("cells"), F.lit(1))), number), lambda w: w.isNotNull())
    named = rows.select(*keys, F.struct("node_ord", "line_no").alias("ord"), "title", F.get("cells", F.lit(0)).alias("name"), F.get(weights, F.lit(0)).alias("weight"))
    named = named.where(~F.lower("name").isin(lex.CRITERION_HEADS) & ~F.col("name").rlike(rf"\A{lex.REQUIREMENT_ID}\z"))
    named = named.where(F.col("weight").isNotNull() | F.col("title").rlike("(?i)" + lex.EVALUATION_SECTION))
    once = named.groupBy(*keys, F.lower("name").alias("key")).agg(F.min(F.struct("ord", "name", "weight")).alias("first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first.ord"))
    return once.select(*keys, place.alias("place"), F.col("first.name").alias("name"), F.col("first.weight").alias("weight"))


def roles(docs: DataFrame, keys: list[str], text: str, cap: int = lex.ROLE_CAP) -> DataFrame:
    """(keys, place, role): roles named in a document, each spelling once, in order of appearance."""
    found = docs.select(*keys, F.posexplode(F.regexp_extract_all(T.normalize(F.col(text)), F.lit("(?i)" + lex.ROLE), F.lit(1))).alias("at", "role"))
    once = found.groupBy(*keys, F.lower(F.trim("role")).alias("key")).agg(F.min(F.struct("at", F.trim("role").alias("role"))).alias("first"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first.at")))
    return placed.where(F.col("place") <= cap).select(*keys, "place", F.col("first.role").alias("role"))
