"""Lines, headings, tables and claim sentences of markdown documents, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import lexicon as lex
from tenderlake.functions import text as T


def lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no from 0, line) of documents that have a text."""
    return docs.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "line"))


def headings(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Nodes of each document's heading tree.

    (keys, node_ord, level, title, numbering, parent_ord, body): body runs to the next heading;
    text before the first heading is node 0 of level 0 if there is any heading and it is not blank;
    a document without headings is one node of level 1 whose title is its first short line.
    parent_ord is the nearest earlier node of a smaller level, null at the top.
    """
    line = lines(docs, keys, text).withColumn("hashes", F.regexp_extract("line", lex.HEADING, 1)).withColumn("head", F.regexp_extract("line", lex.HEADING, 2))
    by_line = Window.partitionBy(*keys).orderBy("line_no")
    line = line.withColumn("island", F.sum((F.col("hashes") != "").cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("any_head", F.max("island").over(Window.partitionBy(*keys)) > 0)
    is_head = F.col("hashes") != ""
    nodes = line.groupBy(*keys, "island", "any_head").agg(
        F.max(F.length("hashes")).alias("level"),
        F.max(F.when(is_head, F.col("head"))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~is_head, F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    nodes = nodes.where((F.col("island") > 0) | ~F.col("any_head") | (T.strip(F.col("body")) != ""))
    first_line = T.strip(F.get(F.filter(F.split("body", "\n"), lambda x: T.strip(x) != ""), F.lit(0)))
    short = (T.word_count(first_line) <= lex.TITLE_WORDS) & ~first_line.rlike(lex.TITLE_END)
    numbering = F.regexp_extract("title", lex.NUMBERING, 1)
    rest = F.regexp_extract("title", lex.NUMBERING, 2)
    nodes = nodes.select(
        *keys,
        (F.row_number().over(Window.partitionBy(*keys).orderBy("island")) - 1).alias("node_ord"),
        F.when(~F.col("any_head"), 1).otherwise(F.col("level")).alias("level"),
        F.nullif(numbering, F.lit("")).alias("numbering"),
        F.when(F.col("island") == 0, F.when(short, first_line).otherwise(lex.UNTITLED)).when(numbering != "", rest).otherwise(F.col("title")).alias("title"),
        T.strip(F.col("body")).alias("body"),
    )
    before = Window.partitionBy(*keys).orderBy("node_ord").rowsBetween(Window.unboundedPreceding, -1)
    last_of = [F.max(F.when(F.col("level") == k, F.col("node_ord"))).over(before) for k in range(7)]
    found = nodes.select("*", *[c.alias(f"last{k}") for k, c in enumerate(last_of)])
    parent = F.greatest(F.lit(None).cast("int"), *[F.when(F.col("level") > k, F.col(f"last{k}")) for k in range(7)])
    return found.withColumn("parent_ord", parent).drop(*[f"last{k}" for k in range(7)])


def table_cells(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, table_ix, row_ix, col_ix, cell) of pipe tables.

    Lines that start with a pipe and follow each other form a table; separator rows are left out
    without ending it. Indices count from 0.
    """
    line = lines(docs, keys, text).withColumn("s", T.strip(F.col("line")))
    line = line.withColumn("piped", F.col("s").startswith("|"))
    by_line = Window.partitionBy(*keys).orderBy("line_no")
    line = line.withColumn("starts", F.col("piped") & ~F.coalesce(F.lag("piped").over(by_line), F.lit(False)))
    line = line.withColumn("run", F.sum(F.col("starts").cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = line.where(F.col("piped") & ~F.col("s").rlike(lex.TABLE_SEPARATOR) & F.col("s").rlike(r"^\|.+\|$"))
    cells = F.split(F.regexp_extract("s", r"^\|(.+)\|$", 1), r"\|")
    rows = rows.select(*keys, "run", "line_no", F.transform(cells, T.strip).alias("cells"))
    rows = rows.withColumn("row_ix", F.row_number().over(Window.partitionBy(*keys, "run").orderBy("line_no")) - 1).withColumn("table_ix", F.dense_rank().over(Window.partitionBy(*keys).orderBy("run")) - 1)
    return rows.select(*keys, "table_ix", "row_ix", F.posexplode("cells").alias("col_ix", "cell"))


def claim_sentences(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, ix, sentence) that carry a claim.

    Code fences, headings, table separators and the header row above one are left out; every other
    table row is one sentence; list marks are taken off; other lines are cut into sentences.
    """
    line = lines(docs, keys, text).withColumn("s", T.strip(F.col("line")))
    by_line = Window.partitionBy(*keys).orderBy("line_no")
    line = line.withColumn("fence", F.col("s").startswith("```"))
    line = line.withColumn("fenced", F.sum(F.col("fence").cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)
    live = line.where(~F.col("fence") & ~F.col("fenced") & (F.col("s") != "")).withColumn("separator", F.col("s").rlike(lex.TABLE_SEPARATOR))
    live = live.withColumn("header", F.col("s").startswith("|") & F.coalesce(F.lead("separator").over(by_line), F.lit(False)))
    live = live.where(~F.col("separator") & ~F.col("header") & ~F.col("s").rlike(r"^#{1,6}\s"))
    bare = F.regexp_replace("s", lex.LIST_MARK, "")
    parts = F.when(F.col("s").startswith("|"), F.array(T.normalize(F.col("s")))).otherwise(T.split_sentences(bare))
    out = live.select(*keys, "line_no", F.posexplode(F.filter(parts, lambda p: p != "")).alias("at", "sentence"))
    return out.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("line_no", "at")) - 1).alias("ix"), "sentence")
