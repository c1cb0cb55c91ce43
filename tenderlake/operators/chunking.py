"""Retrieval chunks of documents, question-answer records and proof points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions import lexicon as lex
from tenderlake.functions import text as T


def _packed(text: Column, most: int, overlap: int) -> Column:
    """Paragraphs packed up to ``most`` characters; a full buffer's tail starts the next piece.

    A paragraph that is too long on its own is cut with the same overlap if the buffer is empty.
    """
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("buf"))

    def hard(para: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.length(para) - 1, F.lit(0)), F.lit(most - overlap)), lambda i: F.substr(para, i + 1, F.lit(most)))

    def step(acc: Column, para: Column) -> Column:
        fits = F.length(acc["buf"]) + F.length(para) + 2 <= most
        joined = T.strip(F.concat(acc["buf"], F.lit("\n\n"), para))
        carried = T.strip(F.concat(F.right(acc["buf"], F.lit(overlap)), F.lit("\n\n"), para))
        return (
            F.when(fits, F.struct(acc["parts"].alias("parts"), joined.alias("buf")))
            .when(acc["buf"] != "", F.struct(F.concat(acc["parts"], F.array(acc["buf"])).alias("parts"), carried.alias("buf")))
            .otherwise(F.struct(F.concat(acc["parts"], hard(para)).alias("parts"), F.lit("").alias("buf")))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["buf"] != "", F.concat(acc["parts"], F.array(acc["buf"]))).otherwise(acc["parts"])

    clean = T.strip(text)
    whole = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.array(clean))
    pieces = F.when(F.length(clean) <= most, whole).otherwise(F.aggregate(F.split(clean, r"\n\s*\n"), start, step, finish))
    return F.filter(pieces, lambda p: T.strip(p) != "")


def _merged(sections: Column, least: int) -> Column:
    """Sections joined forward until each has ``least`` characters; a short end joins the last one."""
    empty = F.array().cast("array<struct<heading:string,body:string>>")
    start = F.struct(empty.alias("done"), F.lit("").alias("heading"), F.lit("").alias("body"))

    def step(acc: Column, s: Column) -> Column:
        heading = F.when(acc["heading"] == "", F.coalesce(s["heading"], F.lit(""))).otherwise(acc["heading"])
        body = T.strip(F.concat(acc["body"], F.lit("\n\n"), s["body"]))
        full = F.length(body) >= least
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.struct(heading.alias("heading"), body.alias("body"))))).otherwise(acc["done"]).alias("done"),
            F.when(full, "").otherwise(heading).alias("heading"),
            F.when(full, "").otherwise(body).alias("body"),
        )

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        last = F.element_at(acc["done"], F.greatest(n, F.lit(1)))
        rest = F.struct(acc["heading"].alias("heading"), acc["body"].alias("body"))
        joined = F.struct(last["heading"].alias("heading"), T.strip(F.concat(last["body"], F.lit("\n\n"), acc["body"])).alias("body"))
        return F.when(acc["body"] == "", acc["done"]).when(n == 0, F.array(rest)).otherwise(F.concat(F.slice(acc["done"], 1, n - 1), F.array(joined)))

    return F.aggregate(sections, start, step, finish)


def markdown_chunks(docs: DataFrame, key: str, text: str, most: int = lex.MAX_CHARS, overlap: int = lex.OVERLAP_CHARS, least: int = lex.MIN_CHARS) -> DataFrame:
    """(key, chunk_no from 0, title, text): documents cut at headings of level 2 to 4, then by size.

    Headings keep their bodies, what stands before the first of them is the document title's.
    Documents without text give no chunks.
    """
    body = F.regexp_replace(text, r"\r\n?", "\n")
    title = F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+(.*)$", 1))
    parts = F.split(body, r"(?m)(?=^#{2,4}[ \t]+\S?)")
    heading = lambda s: F.trim(F.regexp_extract(s, r"\A#{2,4}[ \t]+(.*)", 1))
    named = docs.where(F.col(text).isNotNull()).select(key, title.alias("doc_title"), parts.alias("parts"))
    named = named.select(key, "doc_title", F.transform(F.filter("parts", lambda s: s != ""), lambda s: F.struct(F.when(s.rlike(r"\A#{2,4}[ \t]"), heading(s)).otherwise(F.col("doc_title")).alias("heading"), s.alias("body"))).alias("sections"))
    blocks = named.select(key, "doc_title", F.posexplode(_merged(F.col("sections"), least)).alias("block_no", "block"))
    pieces = blocks.select(key, "doc_title", "block_no", F.col("block.heading").alias("heading"), F.posexplode(_packed(F.col("block.body"), most, overlap)).alias("piece_no", "text"))
    ordered = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_no", "piece_no", "doc_title", "heading", "text"))).alias("all"))
    out = ordered.select(key, F.posexplode("all").alias("chunk_no", "c"))
    name = F.when(F.col("c.heading") == "", F.col("c.doc_title")).otherwise(F.regexp_replace(F.concat(F.col("c.doc_title"), F.lit(" — "), F.col("c.heading")), r"\A[ —]+|[ —]+\z", ""))
    return out.select(key, "chunk_no", name.alias("title"), F.col("c.text").alias("text"))


def qa_chunks(hq: DataFrame) -> DataFrame:
    """One chunk of each question and answer record; null fields are left out of the metadata."""
    fields = ["category", "owner_dept", "client_industry", "status", "date_approved"]
    metadata = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]), lambda _, v: v.isNotNull())
    return hq.select("id", F.col("id").alias("source_id"), F.lit("HISTORICAL_QA").alias("kind"), F.concat(F.lit("Q: "), F.coalesce("question", F.lit("")), F.lit("\n\nA: "), F.coalesce("answer", F.lit(""))).alias("text"), F.col("question").alias("title"), "tags", metadata.alias("metadata"))


def proof_chunks(proofs: DataFrame) -> DataFrame:
    """One chunk of each proof point; the source only if there is one."""
    source = F.when(F.col("verifiable_source") != "", F.concat(F.lit("Source: "), "verifiable_source"))
    text = F.concat_ws("\n\n", F.concat(F.lit("Claim: "), F.coalesce("claim", F.lit(""))), F.concat(F.lit("Evidence: "), F.coalesce("evidence", F.lit(""))), source)
    return proofs.select("id", F.col("id").alias("source_id"), F.lit("PROOF_POINT").alias("kind"), text.alias("text"), F.left("claim", F.lit(120)).alias("title"), F.col("covers_tags").alias("tags"), F.create_map(F.lit("type"), F.coalesce("type", F.lit("")), F.lit("strength"), F.coalesce("strength", F.lit(""))).alias("metadata"))


def template_chunks(files: DataFrame) -> DataFrame:
    """One chunk of each template file (stem, text) that is not blank; ids are ``TMPL-`` and the stem without ``tmpl_``."""
    text = T.strip(F.coalesce("text", F.lit("")))
    name = F.concat(F.lit("TMPL-"), F.replace("stem", F.lit("tmpl_"), F.lit("")))
    head = F.nullif(T.strip(F.regexp_extract("text", r"(?m)^#[ \t]+(.*)$", 1)), F.lit(""))
    return files.where(text != "").select(name.alias("id"), name.alias("source_id"), F.lit("TEMPLATE").alias("kind"), text.alias("text"), F.coalesce(head, "stem").alias("title"))


def corpus(parts: list[DataFrame]) -> DataFrame:
    """(id, source_id, kind, text, title, n_same) of all chunks; n_same counts those with the same id, which should be one."""
    every = reduce(DataFrame.unionByName, [p.select("id", "source_id", "kind", "text", "title") for p in parts])
    counts = every.groupBy("id").agg(F.count(F.lit(1)).alias("n_same"))
    return every.join(counts, "id")
