"""Keyed tables on plain files: merging deliveries, and the checks that a database would make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.session import stage


def latest(df: DataFrame, keys: list[str], order: str, fixed: list[str] | None = None) -> DataFrame:
    """One row for each key: the latest by ``order`` (of equal ones the one with the greatest hash).

    Columns in ``fixed`` keep their first value. Rows with a null key column are dropped.
    """
    fixed = fixed or []
    ordered = [f.name for f in df.schema.fields if f.name not in keys and f.dataType.typeName() != "map"]
    rest = [c for c in df.columns if c not in keys]
    there = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    place = F.struct(order, F.xxhash64(*ordered))
    last = F.max_by(F.struct(*rest), place).alias("_last")
    first = [F.min_by(c, place).alias(f"_first_{c}") for c in fixed]
    one = there.groupBy(*keys).agg(last, *first)
    return one.select(*[F.col(f"_first_{c}").alias(c) if c in fixed else F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], fixed: list[str] | None = None) -> DataFrame:
    """``stored`` with ``incoming`` merged in by key; ``fixed`` columns of stored rows stay."""
    both = stored.withColumn("_seq", F.lit(0)).unionByName(incoming.withColumn("_seq", F.lit(1)))
    return latest(both, keys, "_seq", fixed).drop("_seq")


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table that ``df`` itself may read: staged first, then overwritten."""
    stage(df, "replace").write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def outside_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(value, n) of values that the domain lacks; null is allowed."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(domain)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def dangling(df: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Rows whose keys the parent lacks."""
    known = parent.select(*[F.col(p).alias(k) for k, p in zip(keys, parent_keys)]).distinct()
    return df.join(known, keys, "left_anti")


def set_status(df: DataFrame, key: str, updates: DataFrame, domain: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with the status of ``updates`` (key, status; the greatest counts) where it is in the domain, and the updates that are not valid or meet no row."""
    good = updates.where(F.col("status").isin(domain)).groupBy(key).agg(F.max("status").alias("_new"))
    done = df.join(good, key, "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    bad = updates.where(~F.coalesce(F.col("status").isin(domain), F.lit(False))).unionByName(updates.where(F.col("status").isin(domain)).join(df.select(key), key, "left_anti").select(*updates.columns))
    return done, bad
