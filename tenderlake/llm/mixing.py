"""Mixing sources to target shares of the total size.

Every source gets as many copies of its records as its target needs: whole copies of all records
first, then a Pareto sample for the rest. Records are ranked by random odds over inclusion odds;
the cut that meets the size wanted is found from a histogram of the ranks, so that no source is
ever sorted or gathered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.session import stage

#: Bins of the histogram of ranks; one bin of each source is sorted.
BINS = 65536
SEED = 20240117


def clean_source(source: Column) -> Column:
    """Trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"\A\s+|\s+\z", "")), r"[\s\-]+", "_")


def allocate(shares: list[tuple[str, float, int]], sizes: dict[str, int]) -> dict[str, float]:
    """Times each source is used.

    The total of all sources is handed out by target share. A source that cannot fill its part
    within its repeats gives all it may; what is missing goes to the others by share, until all
    are within their limits (or none is left).
    """
    total = float(sum(sizes.get(s, 0) for s, _, _ in shares))
    most = {s: float(sizes.get(s, 0)) * max(0, reps) for s, _, reps in shares}
    share = {s: max(0.0, t) for s, t, _ in shares}
    given: dict[str, float] = {s: 0.0 for s in share}
    free = {s for s in share if share[s] > 0 and most[s] > 0}
    rest = total
    while free and rest > 0:
        weight = sum(share[s] for s in free)
        full = {s for s in free if most[s] <= rest * share[s] / weight}
        if not full:
            given |= {s: rest * share[s] / weight for s in free}
            break
        given |= {s: most[s] for s in full}
        rest -= sum(most[s] for s in full)
        free -= full
    return {s: given[s] / sizes[s] if sizes.get(s) else 0.0 for s in share}


def rate(bins: list[tuple[float, float]], cap: float, wanted: float) -> float:
    """Repeats per unit of weight with which (weight, size) bins, none used more than ``cap`` times, come to ``wanted``."""
    rest, free = wanted, sorted(bins, reverse=True)
    while free:
        c = max(rest, 0.0) / sum(w * t for w, t in free)
        if c * free[0][0] <= cap:
            return c
        rest -= cap * free.pop(0)[1]
    return cap / min((w for w, _ in bins), default=1.0)


def mix(sized: DataFrame, targets: DataFrame, key: str, weight: Column | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Copies of each record, and the report.

    ``sized`` has ``key``, source and n_tokens; ``targets`` has source, target_share and
    max_repeats (a handful of rows; of a source given twice the first by share counts). Sources are
    compared after ``clean_source``; records of no or another source, and records without tokens,
    take no part. ``weight`` (null and what is not positive count as 1) makes records of a source
    more or less likely than others: the repeats wanted of a record are in proportion to it, up to
    ``max_repeats``, whatever that leaves going to the others of its source.

    Returns (key, source, n_tokens, copies) for records used at least once, and for each source
    target_share, max_repeats, n_docs, tokens_available, tokens_used, actual_share, most_copies.
    Ranks are hashes of ``seed`` and key: the same input gives the same mix on any cluster, and
    equal keys share their rank. Empty tables give an empty mix and a report of zeros.
    """
    plan = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").collect()]
    spark = sized.sparkSession
    names = [s for s, _, _ in plan]
    w = F.lit(1.0) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(1.0)
    rows = sized.select(F.col(key).alias("key"), clean_source(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens"), w.alias("w")).where(F.col("source").isin(names) & (F.col("n_tokens") > 0))
    # sizes by source and eighth of an octave of the weight
    octave = F.floor(F.log2("w") * 8).alias("octave")
    by_weight = rows.groupBy("source", octave).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("w") * F.col("n_tokens")).alias("wt")).collect()
    bins = {s: [(r["wt"] / r["t"], float(r["t"])) for r in by_weight if r["source"] == s] for s in names}
    totals = {s: sum(int(r["t"]) for r in by_weight if r["source"] == s) for s in names}
    times = allocate(plan, totals)
    caps = {s: reps for s, _, reps in plan}
    #: One row for each source of ``targets``.
    per_source = spark.createDataFrame([(s, times[s], float(caps[s]), float(rate(bins[s], caps[s], times[s] * totals[s]))) for s in names], "source string, times double, cap double, scale double")
    # repeats of a record: certain whole copies and the odds of one more
    want = F.least(F.col("w") * F.col("scale"), F.col("cap"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    ranked = (
        rows.join(F.broadcast(per_source), "source")
        .withColumn("want", want)
        .withColumn("whole", F.floor("want").cast("bigint"))
        .withColumn("odds", F.col("want") - F.col("whole"))
        # random odds u / (1 - u) over inclusion odds, as q / (1 + q)
        .withColumn("p", F.when(F.col("odds") > 1e-9, F.try_divide(u * (1 - F.col("odds")), u * (1 - F.col("odds")) + (1 - u) * F.col("odds"))))
        .withColumn("bin", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)))
        .select("key", "source", "n_tokens", "times", "whole", "p", "bin")
    )
    bins = ranked.groupBy("source", "bin").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("whole")).alias("certain"), F.first("times").alias("times"))
    bins = stage(bins, "mix-bins")
    need = bins.groupBy("source").agg((F.first("times") * F.sum("t") - F.sum("certain")).alias("need"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cum = bins.where("bin IS NOT NULL").withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0)))
    # at most one row for each source
    cut = cum.join(F.broadcast(need), "source").where("before < need").groupBy("source").agg(F.max("bin").alias("last"), F.max("before").alias("before"), F.first("need").alias("need"))
    marked = ranked.join(F.broadcast(cut), "source", "left")
    edge = marked.where("bin = last").withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("p", F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the record that crosses the wanted size is taken if that comes nearer to it
    edge = edge.withColumn("extra", (F.col("before") + F.col("upto") - F.col("n_tokens") / 2 <= F.col("need")).cast("bigint"))
    rest = marked.where("bin IS NULL OR last IS NULL OR bin <> last").withColumn("extra", F.coalesce((F.col("bin") < F.col("last")).cast("bigint"), F.lit(0)))
    cols = [F.col("key").alias(key), "source", "n_tokens", (F.col("whole") + F.col("extra")).alias("copies")]
    mixed = rest.select(*cols).unionByName(edge.select(*cols)).where("copies > 0")
    mixed = stage(mixed, "mix")
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    have = spark.createDataFrame([(s, t, r, totals[s]) for s, t, r in plan], "source string, target_share double, max_repeats int, tokens_available bigint")
    docs = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    report = have.join(F.broadcast(used), "source", "left").join(F.broadcast(docs), "source", "left")
    all_used = F.sum("tokens_used").over(Window.partitionBy())
    report = report.na.fill(0, ["tokens_used", "most_copies", "n_docs"]).withColumn("actual_share", F.coalesce(F.try_divide("tokens_used", all_used), F.lit(0.0)))
    return mixed, report.select("source", "target_share", "actual_share", "max_repeats", "most_copies", "n_docs", "tokens_available", "tokens_used")
