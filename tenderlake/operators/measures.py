"""Counts, shares and running values over keyed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key from which its windows are cut, at least; more than a thousandth of all rows, so there are a thousand such keys at most.
HOT_ROWS, HOT_KEYS = 1_000_000, 1000


def breakdown(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(column, n, share) for every value of the domain, 0 where none occurs; other values are left out."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = rows.where(F.col(column).isin(domain)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    both = every.join(F.broadcast(counts), column, "left").na.fill(0, ["n"])  # one row for each value of the domain
    return both.select(column, "n", F.round(F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy())), F.lit(0.0)), 6).alias("share"))


def automation(parts: DataFrame, key: str, group: str, human: Column) -> DataFrame:
    """(group, n_keys, automated, rate): keys none of whose rows is ``human``, in per cent."""
    one = parts.groupBy(group, key).agg(F.bool_or(human).alias("human"))
    done = F.sum((~F.col("human")).cast("int"))
    return one.groupBy(group).agg(F.count(F.lit(1)).alias("n_keys"), done.alias("automated"), F.round(100 * done / F.count(F.lit(1)), 1).alias("rate"))


def dominant(rows: DataFrame, keys: list[str], value: str, order: str, preferred: str) -> DataFrame:
    """Most frequent value of each key; of equally frequent ones ``preferred``, then the first seen."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), F.col(value) != preferred, "first")
    return counts.withColumn("place", F.row_number().over(best)).where("place = 1").select(*keys, value, "n")


def _hot_limit(rows: DataFrame, keys: list[str]) -> int | None:
    """Rows from which a key is hot (a thousand keys at most can be), or null if none is."""
    n, most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(HOT_ROWS, n // HOT_KEYS)
    return limit if most > limit else None


def in_ranges(rows: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """Adds ``_block``: hot keys are cut in ranges of ``order``, in its order; other keys have one block."""
    place = F.col(order).cast("double")
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_low"), F.max(place).alias("_high")).where(F.col("_n") > limit)
    stats = stats.select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / limit).alias("_parts"), "_low", "_high")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    at = F.floor(F.try_divide(place - F.col("_low"), F.col("_high") - F.col("_low")) * F.col("_parts"))
    block = F.coalesce(F.least(at, F.col("_parts") - 1), F.lit(0)).cast("int")
    return rows.join(F.broadcast(stats), same, "left").withColumn("_block", block).drop("_parts", "_low", "_high", *[f"_{k}" for k in keys])  # at most HOT_KEYS rows


def _carried(blocked: DataFrame, keys: list[str], per_block: list[Column], carried: list[Column]) -> DataFrame:
    """Rows with columns worked out over the blocks of their key; ``carried`` are windows over ``per_block``, by block."""
    sums = blocked.groupBy(*keys, "_block").agg(*per_block).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_at"), *carried)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_block") == F.col("_at")]
    return blocked.join(sums, reduce(Column.__and__, same)).drop("_at", *[f"_{k}" for k in keys])


def running(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds start (before), end (after) and share of the key's total, in order.

    Keys with very many rows are worked on in ranges of the first order column; the sums of the
    ranges before are carried over.
    """
    limit = _hot_limit(rows, keys)
    if limit is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        end, total = F.coalesce(F.sum(value).over(w), F.lit(0.0)), F.sum(value).over(Window.partitionBy(*keys))
    else:
        over = Window.partitionBy(*keys)
        before = F.coalesce(F.sum("_sum").over(over.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rows = _carried(in_ranges(rows, keys, order[0], limit), keys, [F.sum(value).alias("_sum")], [before.alias("_before"), F.sum("_sum").over(over).alias("_total")])
        w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        end, total = F.col("_before") + F.coalesce(F.sum(value).over(w), F.lit(0.0)), F.col("_total")
    out = rows.withColumn("_end", end).withColumn("_all", total)
    out = out.withColumn("end", F.round("_end", 2)).withColumn("start", F.round(F.col("_end") - F.col(value), 2)).withColumn("share", F.round(F.col(value) / F.col("_all"), 6))
    return out.drop("_end", "_all", "_block", "_before", "_total")


def last_before(rows: DataFrame, keys: list[str], order: list[str], marker: Column, value: str, name: str) -> DataFrame:
    """Adds ``name``: the value of the nearest earlier or same row that is a marker; hot keys as in ``running``."""
    limit = _hot_limit(rows, keys)
    marked = F.when(marker, F.col(value))
    last = lambda over: F.last(marked, ignorenulls=True).over(over.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if limit is None:
        return rows.withColumn(name, last(Window.partitionBy(*keys)))
    newest = F.max_by(marked, F.when(marked.isNotNull(), F.struct(*order))).alias("_last")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    out = _carried(in_ranges(rows, keys, order[0], limit), keys, [newest], [before.alias("_before")])
    return out.withColumn(name, F.coalesce(last(Window.partitionBy(*keys, "_block")), F.col("_before"))).drop("_before", "_block")


def in_window(rows: DataFrame, keys: list[str], time: str, seconds: int, name: str) -> DataFrame:
    """Adds ``name``: rows of the same key in the ``seconds`` up to each row.

    If a key is hot, rows are counted in slots of that length, each with the rows of the slot before.
    """
    at, span = F.unix_micros(F.col(time).cast("timestamp")), seconds * 1_000_000
    count = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy(at).rangeBetween(-span, 0))
    if _hot_limit(rows, keys) is None:
        return rows.withColumn(name, count(*keys))
    slot = F.floor(at / span)
    both = rows.withColumn("_own", slot).withColumn("_slot", F.explode(F.array(slot, slot + 1)))
    return both.withColumn(name, count(*keys, "_slot")).where("_own = _slot").drop("_own", "_slot")


def usage(rows: DataFrame, dimensions: list[str], measures: list[Column]) -> DataFrame:
    """Measures over all rows and by each dimension alone, in one pass; unused dimensions are null."""
    sets = [[]] + [[d] for d in dimensions]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dimensions]).agg(*measures, F.grouping_id().alias("grouping"))


def agreement(rows: DataFrame, said: Column, true: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 of a yes/no prediction; 0 where undefined."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = rows.agg(n(said & true).alias("tp"), n(said & ~true).alias("fp"), n(~said & true).alias("fn"), n(~said & ~true).alias("tn"))
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return counts.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))
