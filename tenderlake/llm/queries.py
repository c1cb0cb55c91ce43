"""Queries of the text operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import answers, language, mixing, neardup, packing, setjoin, splitting, tokens
from tenderlake.session import stage, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defective_pairs(table(spark, d, "hq_001_030"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Defects of each department, with the records they are found in."""
    hq = table(spark, d, "hq_001_030")
    held = hq.select("id", F.coalesce(F.trim("owner_dept"), F.lit("")).alias("owner_dept")).distinct()
    return answers.defective_pairs(hq).join(held, "id").groupBy("owner_dept", "defect").agg(F.countDistinct("id").alias("n"))


def _near(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(neardup.word_sets(table(spark, d, "hq_001_030"), "id", ["question", "answer"]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(_near(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        splitting.items("chunk", "text", table(spark, d, "chunk"), F.lit(""), F.col("id")),
        splitting.items("sections", "content_md", table(spark, d, "sections"), F.col("run_id"), F.col("id")),
    ]
    return splitting.split(parts, table(spark, d, "split_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 1").select("tbl", "run_id", "item_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p3_cuts(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut_report(_pieces(spark, d))


def p3_whole(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each cut item by its pieces, the overlaps counted once: those of the item itself."""
    limits = table(spark, d, "split_limits").groupBy("tbl").agg(F.coalesce(F.min("overlap_chars"), F.lit(0)).alias("overlap"))
    pieces = _pieces(spark, d).groupBy("tbl", "run_id", "item_id").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))
    return pieces.join(F.broadcast(limits), "tbl").select("tbl", "run_id", "item_id", (F.col("chars") - F.col("overlap") * (F.col("n") - 1)).alias("chars"))  # two rows


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = [(table(spark, d, "hq_001_030"), "id", "tags"), (table(spark, d, "proof_points"), "id", "covers_tags")]
    return setjoin.similar_records(setjoin.tag_sets(parts))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_pairs(*_similar(spark, d))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.link_counts(*_similar(spark, d))


def p4_class_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class representatives; ``p4_links`` has the members."""
    return setjoin.class_links(*_similar(spark, d))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack(docs, table(spark, d, "pack_limits"), "doc_id", tokens.n_tokens(F.col("text")))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, d), table(spark, d, "pack_limits"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    wanted = docs.join(F.broadcast(targets.select(mixing.clean_source(F.col("source")).alias("s")).distinct()), mixing.clean_source(F.col("source")) == F.col("s"), "left_semi")
    sized = stage(wanted.select("doc_id", "source", tokens.n_tokens(F.col("text")).alias("n_tokens")), "sizes")
    return mixing.mix(sized, targets, "doc_id", weight=F.sqrt("n_tokens"))  # long documents are likelier


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(language.languages(table(spark, d, "documents"), table(spark, d, "lang_codes")))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "documents"), table(spark, d, "lang_codes"))


QUERIES = {
    "p1_found": p1_found,
    "p1_shares": p1_shares,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_cuts": p3_cuts,
    "p3_whole": p3_whole,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p4_class_links": p4_class_links,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_languages": p8_languages,
}

_TOO_LONG = """
SELECT DISTINCT i.tbl, i.run_id, i.item_id
FROM (SELECT 'chunk' AS tbl, '' AS run_id, id AS item_id, text FROM chunk UNION ALL SELECT 'sections', run_id, id, content_md FROM sections) i
JOIN split_limits l ON l.tbl = i.tbl AND l.field = CASE i.tbl WHEN 'chunk' THEN 'text' ELSE 'content_md' END
WHERE length(trim(i.text, chr(32) || chr(9) || chr(13) || chr(10))) > l.max_chars
"""
_TAGS = """
WITH r AS (
  SELECT id, tags AS t FROM hq_001_030 UNION ALL SELECT id, covers_tags FROM proof_points
), tags AS (
  SELECT DISTINCT id, replace(replace(lower(trim(x)), ' ', '-'), '_', '-') AS tag FROM (SELECT id, unnest(t) AS x FROM r) WHERE trim(x) <> ''
), n AS (SELECT id, count(*) AS n FROM tags GROUP BY id)
, shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS both_have FROM tags a JOIN tags b ON a.tag = b.tag AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM shared JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE both_have >= 0.6 * (x.n + y.n - both_have)
"""
_CLASSES = """
WITH r AS (
  SELECT id, tags AS t FROM hq_001_030 UNION ALL SELECT id, covers_tags FROM proof_points
), clean AS (
  SELECT DISTINCT id, list_sort(list_distinct(list_filter(list_transform(t, lambda x: replace(replace(lower(trim(x)), ' ', '-'), '_', '-')), lambda x: x IS NOT NULL AND x <> ''))) AS t FROM r
), m AS (SELECT id, t, min(id) OVER (PARTITION BY t) AS class, count(*) OVER (PARTITION BY t) - 1 AS n_equal FROM clean WHERE len(t) > 0)
, k AS (SELECT DISTINCT class, t FROM m), tag AS (SELECT class, len(t) AS n, unnest(t) AS tag FROM k)
, links AS (SELECT a.class AS class_a, b.class AS class_b FROM tag a JOIN tag b ON a.tag = b.tag AND a.class < b.class GROUP BY ALL HAVING count(*) >= 0.6 * (any_value(a.n) + any_value(b.n) - count(*)))
"""
_NEAR = """
WITH RECURSIVE w AS (
  SELECT id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(question, '') || ' ' || coalesce(answer, '')), '[\\p{L}\\p{M}\\p{Nd}]+'))) AS w FROM (SELECT DISTINCT ON (id) * FROM hq_001_030 ORDER BY id, loaded_at DESC) WHERE id IS NOT NULL
), k AS (SELECT id, w, min(id) OVER (PARTITION BY w) AS class FROM w WHERE len(w) >= 40)
, t AS (SELECT class, len(w) AS n, unnest(w) AS word FROM (SELECT DISTINCT class, w FROM k))
, one AS (SELECT a.class AS a, b.class AS b FROM t a JOIN t b ON a.word = b.word AND a.class < b.class GROUP BY ALL HAVING count(*) >= 0.7 * (any_value(a.n) + any_value(b.n) - count(*)))
, links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one)
, reach(a, b) AS (SELECT class, class FROM k UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
, g AS (SELECT id, class, grp FROM k JOIN (SELECT a AS class, min(b) AS grp FROM reach GROUP BY a) USING (class))
"""
_LENGTHS = """
SELECT i.tbl, i.run_id, i.item_id, length(trim(i.text, chr(32) || chr(9) || chr(13) || chr(10))) AS chars
FROM (SELECT 'chunk' AS tbl, '' AS run_id, id AS item_id, text FROM (SELECT DISTINCT ON (id) * FROM chunk ORDER BY id, loaded_at DESC)
  UNION ALL SELECT 'sections', run_id, id, content_md FROM (SELECT DISTINCT ON (run_id, id) * FROM sections ORDER BY run_id, id, loaded_at DESC)) i
JOIN split_limits l ON l.tbl = i.tbl AND l.field = CASE i.tbl WHEN 'chunk' THEN 'text' ELSE 'content_md' END
WHERE length(trim(i.text, chr(32) || chr(9) || chr(13) || chr(10))) > l.max_chars
"""
SQL: dict[str, str] = {
    "p2_found": _NEAR + "SELECT x.id AS id_a, y.id AS id_b FROM g x JOIN g y ON x.grp = y.grp AND x.id < y.id",
    "p2_groups": _NEAR + "SELECT id, class, grp FROM g",
    "p3_whole": _LENGTHS,
    "p3_found": _TOO_LONG,
    "p4_found": _TAGS,
    "p4_links": _CLASSES + "SELECT id, class, n_equal, (SELECT count(*) FROM links WHERE class IN (class_a, class_b)) AS n_links FROM m",
    "p4_class_links": _CLASSES + "SELECT class_a, class_b FROM links",
}
