"""Queries of problem 5 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderlake.operators import integrity as op
from tenderlake.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    refs = op.references(t("sections"), t("win_themes"), t("retrieval_pairs"), t("calibration_pairs"))
    keys = op.targets(t("requirements"), t("proof_points"), t("hq_001_030"), t("chunk"))
    return op.orphan_references(refs, keys, op.removals_of(t("removals")))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return op.orphan_counts(p5_found(spark, d))


_CLEAN = "nullif(upper(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"
_FOUND = rf"""
WITH sec AS (
  SELECT run_id, id, min(loaded_at) AS loaded_at, arg_min(requirement_ids_json, loaded_at) AS j FROM sections GROUP BY ALL
), themes AS (
  SELECT run_id, id, min(loaded_at) AS loaded_at, arg_min(proof_ids_json, loaded_at) AS j FROM win_themes GROUP BY ALL
), refs0 AS (
  SELECT 'sections' AS tbl, run_id, id AS rec_id, 'requirements' AS target, run_id AS scope, loaded_at,
         unnest(CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' THEN from_json(j, '["VARCHAR"]') END) AS ref FROM sec
  UNION ALL
  SELECT 'win_themes', run_id, id, 'proof_points', '', loaded_at,
         unnest(CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' THEN from_json(j, '["VARCHAR"]') END) FROM themes
  UNION ALL
  SELECT 'retrieval_pairs', '', query_id, NULL, '', loaded_at, unnest(relevant_ids)
  FROM (SELECT query_id, min(loaded_at) AS loaded_at, arg_min(relevant_ids, loaded_at) AS relevant_ids FROM retrieval_pairs GROUP BY ALL)
  UNION ALL
  SELECT 'calibration_pairs', '', pair_id, 'hq_001_030', '', loaded_at, historical_id
  FROM (SELECT pair_id, min(loaded_at) AS loaded_at, arg_min(historical_id, loaded_at) AS historical_id FROM calibration_pairs GROUP BY ALL)
), refs AS (
  SELECT DISTINCT tbl, run_id, rec_id, scope, loaded_at, {_CLEAN.format('ref')} AS ref_id,
    coalesce(target, CASE left({_CLEAN.format('ref')}, 3) WHEN 'HQ-' THEN 'hq_001_030' WHEN 'PP-' THEN 'proof_points' WHEN 'KB-' THEN 'chunk' ELSE 'none' END) AS target
  FROM refs0
), keys AS (
  SELECT 'requirements' AS target, run_id AS scope, upper(id) AS ref_id, min(loaded_at) AS there FROM requirements GROUP BY ALL
  UNION ALL SELECT 'proof_points', '', upper(id), min(loaded_at) FROM proof_points GROUP BY ALL
  UNION ALL SELECT 'hq_001_030', '', upper(id), min(loaded_at) FROM hq_001_030 GROUP BY ALL
  UNION ALL SELECT 'chunk', '', upper(source_id), min(loaded_at) FROM chunk GROUP BY ALL
), gone AS (
  SELECT tbl AS target, CASE WHEN tbl = 'requirements' THEN coalesce(run_id, '') ELSE '' END AS scope, upper(trim(ref_id)) AS ref_id, min(removed_at) AS gone
  FROM removals GROUP BY ALL
), found AS (
  SELECT r.tbl, r.run_id, r.rec_id, r.ref_id, strftime(r.loaded_at, '%Y-%m') AS period
  FROM refs r LEFT JOIN keys USING (target, scope, ref_id) LEFT JOIN gone USING (target, scope, ref_id)
  WHERE r.ref_id IS NOT NULL AND (there IS NULL OR there > r.loaded_at OR gone <= r.loaded_at)
)
"""

QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
SQL = {
    "p5_found": _FOUND + "SELECT tbl, run_id, rec_id, ref_id, period FROM found",
    "p5_counts": _FOUND + "SELECT tbl, period, count(*) AS n_orphans, count(DISTINCT (run_id, rec_id)) AS n_records FROM found GROUP BY ALL",
}
