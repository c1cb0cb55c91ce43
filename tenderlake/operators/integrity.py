"""References to records that do not exist.

References and the keys they should meet are tagged, put in one long table and grouped by
target table and key. Groups whose target is missing, late or removed for any of their
references are kept; only the references of those groups are looked at again, one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.session import stage

#: References to one key that are looked at in one task, at least; keys with more than this, or than a
#: thousandth of all references, are spread. So there are at most a thousand of them.
HOT_REFERENCES, HOT_KEYS = 100_000, 1000
REFERENCE_COLUMNS = ["tbl", "run_id", "rec_id", "target", "scope", "ref_id", "loaded_at"]
TARGET_COLUMNS = ["target", "scope", "ref_id", "loaded_at"]
REMOVAL_COLUMNS = ["target", "scope", "ref_id", "removed_at"]


def clean_ref(ref: Column) -> Column:
    """Trimmed (all white space) and upper-cased; blank becomes null."""
    return F.nullif(F.upper(F.regexp_replace(ref, r"\A\s+|\s+\z", "")), F.lit(""))


def json_ids(text: Column) -> Column:
    """The strings of a JSON array; null where ``text`` is not a valid one."""
    whole = F.when(text.rlike(r"(?s)\A\s*\[.*\]\s*\z"), text)
    return F.try_variant_get(F.try_parse_json(whole), "$", "array<string>")


def first_delivery(df: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """One row for each key: earliest ``loaded_at`` and what came with it."""
    payload = F.min_by(F.struct(*carry), F.struct("loaded_at", *carry)).alias("_p")
    grouped = df.groupBy(*keys).agg(payload, F.min("loaded_at").alias("loaded_at"))
    return grouped.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in carry], "loaded_at")


def exploded(df: DataFrame, tbl: str, run_id: Column, rec_id: Column, ids: Column, target: Column, scope: Column) -> DataFrame:
    refs = df.select(run_id.alias("run_id"), rec_id.alias("rec_id"), "loaded_at", F.explode(F.array_distinct(F.transform(ids, clean_ref))).alias("ref_id")).where("ref_id IS NOT NULL")
    return refs.select(F.lit(tbl).alias("tbl"), "run_id", "rec_id", target.alias("target"), scope.alias("scope"), "ref_id", "loaded_at")


def references(sections: DataFrame, win_themes: DataFrame, retrieval_pairs: DataFrame, calibration_pairs: DataFrame) -> DataFrame:
    """Long form of every reference, each record at its earliest delivery."""
    none, run = F.lit(""), F.col("run_id")
    by_prefix = F.when(F.col("ref_id").startswith("HQ-"), "hq_001_030").when(F.col("ref_id").startswith("PP-"), "proof_points").when(F.col("ref_id").startswith("KB-"), "chunk").otherwise("none")
    parts = [
        exploded(first_delivery(sections, ["run_id", "id"], ["requirement_ids_json"]), "sections", run, F.col("id"), json_ids(F.col("requirement_ids_json")), F.lit("requirements"), run),
        exploded(first_delivery(win_themes, ["run_id", "id"], ["proof_ids_json"]), "win_themes", run, F.col("id"), json_ids(F.col("proof_ids_json")), F.lit("proof_points"), none),
        exploded(first_delivery(retrieval_pairs, ["query_id"], ["relevant_ids"]), "retrieval_pairs", none, F.col("query_id"), F.col("relevant_ids"), by_prefix, none),
        exploded(first_delivery(calibration_pairs, ["pair_id"], ["historical_id"]), "calibration_pairs", none, F.col("pair_id"), F.array("historical_id"), F.lit("hq_001_030"), none),
    ]
    return reduce(DataFrame.unionByName, parts)


def targets(requirements: DataFrame, proof_points: DataFrame, hq: DataFrame, chunk: DataFrame) -> DataFrame:
    def of(df: DataFrame, name: str, key: str, scope: Column) -> DataFrame:
        return df.select(F.lit(name).alias("target"), scope.alias("scope"), clean_ref(F.col(key)).alias("ref_id"), "loaded_at")

    none = F.lit("")
    parts = [of(requirements, "requirements", "id", F.col("run_id")), of(proof_points, "proof_points", "id", none), of(hq, "hq_001_030", "id", none), of(chunk, "chunk", "source_id", none)]
    return reduce(DataFrame.unionByName, parts)


def removals_of(removals: DataFrame) -> DataFrame:
    scope = F.when(F.col("tbl") == "requirements", F.coalesce("run_id", F.lit(""))).otherwise("")
    return removals.select(F.col("tbl").alias("target"), scope.alias("scope"), clean_ref(F.col("ref_id")).alias("ref_id"), "removed_at")


def orphan_references(refs: DataFrame, targets: DataFrame, removals: DataFrame) -> DataFrame:
    """References without a record behind them when they were loaded.

    ``refs`` has REFERENCE_COLUMNS, ``targets`` TARGET_COLUMNS, ``removals`` REMOVAL_COLUMNS;
    other columns are ignored. Returns tbl, run_id, rec_id, ref_id, period (``yyyy-MM``), no row
    twice. Null or blank references carry nothing; a target without a load time never existed;
    a reference without one is judged by existence and removal alone and has a null period.
    Empty tables are fine. A key that holds much of all references is spread over several tasks.
    """
    refs = refs.select(*REFERENCE_COLUMNS).where("ref_id IS NOT NULL AND ref_id <> ''").withColumn("scope", F.coalesce("scope", F.lit("")))
    none = F.lit(None).cast("timestamp")
    long = (
        refs.select("target", "scope", "ref_id", none.alias("there"), none.alias("gone"), F.col("loaded_at").alias("low"), F.col("loaded_at").alias("high"), F.lit(1).alias("n"))
        .unionByName(targets.select("target", F.coalesce("scope", F.lit("")).alias("scope"), "ref_id", F.col("loaded_at").alias("there"), none.alias("gone"), none.alias("low"), none.alias("high"), F.lit(0).alias("n")))
        .unionByName(removals.select("target", F.coalesce("scope", F.lit("")).alias("scope"), "ref_id", none.alias("there"), F.col("removed_at").alias("gone"), none.alias("low"), none.alias("high"), F.lit(0).alias("n")))
    )
    key = ["target", "scope", "ref_id"]
    groups = long.groupBy(*key).agg(F.min("there").alias("there"), F.min("gone").alias("gone"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    lacking = groups.where((F.col("n") > 0) & (F.col("there").isNull() | F.col("gone").isNotNull() | (F.col("low") < F.col("there"))))
    lacking = stage(lacking.select(*key, "there", "gone", "n"), "lacking")
    total = lacking.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(HOT_REFERENCES, total // HOT_KEYS)
    hot = lacking.where(F.col("n") > limit).select(*key, F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("tbl", "run_id", "rec_id"), F.coalesce("parts", F.lit(1))).cast("int")
    salted = refs.join(F.broadcast(hot), key, "left").withColumn("salt", part).drop("parts")  # at most HOT_KEYS rows
    lacking = lacking.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col("n") / limit, F.lit(1))).cast("int") - 1))).drop("n")
    orphan = F.col("there").isNull() | F.coalesce(F.col("there") > F.col("loaded_at"), F.lit(False)) | F.coalesce(F.col("gone") <= F.col("loaded_at"), F.lit(False)) | (F.col("loaded_at").isNull() & F.col("gone").isNotNull())
    found = salted.join(lacking, [*key, "salt"]).where(orphan)
    return found.select("tbl", F.coalesce("run_id", F.lit("")).alias("run_id"), "rec_id", "ref_id", F.date_format("loaded_at", "yyyy-MM").alias("period")).distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans for each referring table and month, with the number of records that hold them."""
    return orphans.groupBy("tbl", "period").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("run_id", "rec_id").alias("n_records"))
