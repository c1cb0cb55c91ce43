"""Rows rendered as markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: Column) -> Column:
    """Text of a table cell: white space collapsed, pipes escaped, empty as ``-``."""
    clean = F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s+", " "))
    return F.coalesce(F.nullif(F.replace(clean, F.lit("|"), F.lit("\\|")), F.lit("")), F.lit("-"))


def row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def table(rows: DataFrame, keys: list[str], order: list[str], header: list[str], cells: list[Column], name: str = "markdown") -> DataFrame:
    """(keys, name): one markdown table for each key, rows in order."""
    head = "| " + " | ".join(header) + " |\n|" + "---|" * len(header)
    made = rows.select(*keys, F.struct(*order, row(*[cell(c) for c in cells]).alias("_row")).alias("_r"))
    lines = F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_row"])
    return made.groupBy(*keys).agg(F.concat_ws("\n", F.lit(head), F.array_join(lines, "\n")).alias(name))


def document(parts: DataFrame, keys: list[str], order: list[str], text: str, name: str = "markdown") -> DataFrame:
    """(keys, name): the texts of each key joined in order with blank lines."""
    made = parts.select(*keys, F.struct(*order, F.coalesce(text, F.lit("")).alias("_t")).alias("_r"))
    return made.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_t"]), "\n\n").alias(name))


def with_markers(parts: DataFrame, records: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Texts with ``[KIND(sources)]`` behind every recorded sentence, longest sentences first.

    ``records`` has the keys, sentence, kind and source_ids.
    """
    mark = F.concat(F.lit(" ["), F.col("kind"), F.when(F.size("source_ids") > 0, F.concat(F.lit("("), F.array_join("source_ids", ","), F.lit(")"))).otherwise(""), F.lit("]"))
    one = records.where("sentence <> ''").select(*keys, F.struct((-F.length("sentence")).alias("n"), F.col("sentence"), mark.alias("mark")).alias("_m")).groupBy(*keys).agg(F.array_sort(F.collect_set("_m")).alias("_ms"))
    joined = parts.join(one, keys, "left")
    marked = F.aggregate(F.coalesce("_ms", F.array()), F.col(text), lambda t, m: F.replace(t, m["sentence"], F.concat(m["sentence"], m["mark"])))
    return joined.withColumn(text, F.when(F.col("_ms").isNull(), F.col(text)).otherwise(marked)).drop("_ms")
