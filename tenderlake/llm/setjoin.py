"""All similar pairs between set-valued records by chosen-path splitting.

In every tree the records of a node are split on tokens chosen at random, the same for all of
them: a record that needs m more shared tokens for a similar partner follows each token it has
left with odds 1/m, so that a similar pair stays together in one branch or more on average while
others part. Small nodes are compared by brute force. In a large node, records that are on
average about as similar to the node as a pair has to be are compared with the whole node, in
blocks; the others are split on. As many trees are grown as the wanted recall takes at the depth
that was reached, and what was found is verified exactly.

Tokens of one record alone join nothing, so only the others are chosen from, and records with too
few of those have no partner. Of the trees that choose a token at the root, the one with the least
draw holds every record of the others there: if that node is small, it alone is compared.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.groups import expand, in_blocks
from tenderlake.session import stage

THRESHOLD = 0.6
#: Share of the similar pairs to be found at least, and the depth that the first trees are meant for.
RECALL, DEPTH = 0.999, 3
#: Records up to which a node is compared by brute force.
SMALL = 128
#: Records of a large node that stand for it, and how near to the needed overlap a record's mean with them is hot.
PIVOTS, HOT = 4, 0.9
SEED = 41


def clean_tags(tags: Column) -> Column:
    """Distinct tags, trimmed, lower case, blanks and underscores as hyphens; blank ones dropped; sorted."""
    clean = F.transform(tags, lambda t: F.regexp_replace(F.lower(F.regexp_replace(t, r"\A[\s\x{00A0}]+|[\s\x{00A0}]+\z", "")), r"[\s\x{00A0}_]", "-"))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != ""))))


def tag_sets(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(id, tags) of (table, id column, tags column); records without tags take no part.

    An id delivered more than once, with whatever ``loaded_at``, counts once for each set it has.
    """
    rows = [df.select(F.col(i).cast("string").alias("id"), clean_tags(F.col(t)).alias("tags")) for df, i, t in parts]
    return reduce(DataFrame.unionByName, rows).where("id IS NOT NULL AND size(tags) > 0").distinct()


def survival(depth: int) -> float:
    """Odds that a pair that has one branch in common on average still meets after ``depth`` splits."""
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-s)
    return s


def trees_for(recall: float, depth: int) -> int:
    """Trees in one of which at least a share ``recall`` of the similar pairs meets."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth))) if depth else 1


def _draw(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def _near(depth: int, threshold: float) -> Column:
    """Are the records a and b, which share ``depth`` tokens by their path, similar?"""
    enough = threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-9 - depth
    possible = F.least(F.size("a.left"), F.size("b.left")) >= enough
    return possible & (F.size(F.array_intersect("a.left", "b.left")) >= enough)


def _brute(nodes: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Similar pairs of small nodes."""
    a, b = nodes.alias("a"), nodes.alias("b")
    return a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.sid") < F.col("b.sid")) & _near(depth, threshold)).select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"))


def _hot_pairs(large: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Similar pairs of hot records with any records of their node, in blocks of both."""
    a, b = in_blocks(large.where("hot"), large, "node", "sid")
    a, b = a.alias("a"), b.alias("b")
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("node", "i", "j")]
    once = F.when(F.col("b.hot"), F.col("a.sid") < F.col("b.sid")).otherwise(F.col("a.sid") != F.col("b.sid"))
    return a.join(b, reduce(Column.__and__, met) & once & _near(depth, threshold)).select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b"))


def _marked(large: DataFrame, depth: int) -> DataFrame:
    """Records of large nodes with ``hot``: as similar to the node's pivots as a pair has to be, or with all tokens needed on the path."""
    pivot = _draw(F.col("sid"), F.col("node")) * F.col("size") < PIVOTS
    pivots = large.where(pivot).groupBy("node").agg(F.collect_list("left").alias("pivots"))
    shared = F.aggregate(F.transform("pivots", lambda p: F.size(F.array_intersect("left", p))), F.lit(0), lambda a, s: a + s)
    mean = depth + F.coalesce(shared / F.size("pivots"), F.lit(0.0))
    hot = (mean >= HOT * F.col("need")) | (depth >= F.col("need"))
    return large.join(pivots, "node", "left").select("node", "sid", "n", "need", "left", hot.alias("hot"))


def _follow(rows: DataFrame, depth: int) -> DataFrame:
    """One row for each branch that a record of a node of ``depth`` path tokens takes."""
    below = rows.withColumn("token", F.explode("left"))
    chosen = below.where(_draw(F.col("node"), F.col("token")) * (F.col("need") - depth) < 1)
    return chosen.select(F.xxhash64("node", "token", F.lit(depth)).alias("node"), "sid", "n", "need", F.array_remove("left", F.col("token")).alias("left"))


def _sized(rows: DataFrame, depth: int, threshold: float, name: str) -> DataFrame:
    """Rows that may have a partner in their node, with the number of those as ``size``.

    Judged by shape alone: a pair of n tokens and k known ones each shares the lesser k at most.
    """
    shaped = rows.withColumn("k", F.size("left") + depth)
    shapes = shaped.groupBy("node", "n", "k").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.collect_list(F.struct("n", "k", "c")).alias("shapes"))
    shapes = shapes.where("size(shapes) > 1 OR shapes[0].c > 1")
    fits = lambda x, y: (F.least(x["k"], y["k"]) >= threshold / (1 + threshold) * (x["n"] + y["n"]) - 1e-9) & ((x["n"] != y["n"]) | (x["k"] != y["k"]) | (x["c"] > 1))
    kept = shapes.select("node", F.filter("shapes", lambda x: F.exists("shapes", lambda y: fits(x, y))).alias("kept")).where("size(kept) > 0")
    kept = kept.select("node", F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, x: a + x["c"]).alias("size"), F.explode("kept").alias("s"))
    kept = kept.select("node", "size", F.col("s.n").alias("n"), F.col("s.k").alias("k"))
    return stage(shaped.join(kept, ["node", "n", "k"]).drop("k"), name)


def _grow(coded: DataFrame, trees: range, threshold: float, small: int) -> tuple[list[DataFrame], int]:
    """Pairs that meet in some of ``trees``, and the number of splits it took."""
    root = lambda tree: _draw(F.col("token"), F.lit(tree), F.lit(SEED))
    first = coded.withColumn("token", F.explode("left")).withColumn("left", F.array_remove("left", F.col("token")))
    least = F.least(*[root(t) for t in trees]) if len(trees) > 1 else root(trees[0])
    rows = _sized(first.where(least * F.col("need") < 1).select(F.col("token").alias("node"), "sid", "n", "need", "left"), 1, threshold, "roots")
    pairs = [_brute(rows.where(F.col("size") <= small), 1, threshold)]
    large = rows.where(F.col("size") > small).withColumn("token", F.col("node"))
    chosen = large.withColumn("tree", F.explode(F.filter(F.array(*[F.when(root(t) * F.col("need") < 1, F.lit(t)) for t in trees]), lambda t: t.isNotNull())))
    rows, depth = chosen.select(F.xxhash64("tree", "token").alias("node"), "sid", "n", "need", "left"), 1
    while True:
        rows = _sized(rows, depth, threshold, f"nodes{depth}")
        pairs.append(_brute(rows.where(F.col("size") <= small), depth, threshold))
        large = rows.where(F.col("size") > small)
        if large.isEmpty():
            return pairs, depth
        marked = stage(_marked(large, depth), f"large{depth}")
        if not marked.where("hot").isEmpty():
            pairs.append(_hot_pairs(marked, depth, threshold))
        rows = _follow(marked.where("NOT hot"), depth)
        depth += 1


def similar_classes(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL) -> DataFrame:
    """(a, b), a < b: sids of different sets with at least ``threshold`` Jaccard similarity.

    ``sets`` has sid (bigint) and tags, no set twice. A pair is missed only if it is parted in
    every tree, with odds of 1 - ``recall`` at most.
    """
    tokens = F.transform("tags", lambda t: F.xxhash64(t))
    base = sets.select("sid", F.size("tags").alias("n"), F.ceil(threshold * F.size("tags") - 1e-9).cast("int").alias("need"), tokens.alias("tokens"))
    # tokens of one record alone, found without a join on the others
    lone = base.select("sid", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("sid").alias("sid")).where("df = 1")
    lone = lone.groupBy("sid").agg(F.collect_list("token").alias("lone"))
    left = F.when(F.col("lone").isNull(), F.col("tokens")).otherwise(F.array_except("tokens", "lone"))
    coded = base.join(lone, "sid", "left").select("sid", "n", "need", left.alias("left")).where("size(left) >= need")
    coded = stage(coded, "coded")
    trees = trees_for(recall, DEPTH)
    pairs, depth = _grow(coded, range(trees), threshold, small)
    while trees_for(recall, depth) > trees:
        more, deeper = _grow(coded, range(trees, trees_for(recall, depth)), threshold, small)
        trees, pairs, depth = trees_for(recall, depth), pairs + more, max(depth, deeper)
    met = reduce(DataFrame.unionByName, pairs).distinct()
    x, y = sets.select(F.col("sid").alias("a"), F.col("tags").alias("ta")), sets.select(F.col("sid").alias("b"), F.col("tags").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    return met.join(x, "a").join(y, "b").where(shared >= threshold * (F.size("ta") + F.size("tb") - shared) - 1e-9).select("a", "b")


def classes(records: DataFrame) -> DataFrame:
    """(id, sid, class, tags): equal sets have the same sid (a number) and class (their least id)."""
    named = records.groupBy("tags").agg(F.min("id").alias("class"))
    sid = F.xxhash64(F.xxhash64("tags"), F.xxhash64(F.lit(SEED), "tags"), "class")
    return records.join(named.select("tags", "class", sid.alias("sid")), "tags").select("id", "sid", "class", "tags")


def similar_records(records: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Membership (id, sid, class) of all records and links (a, b) between the sids of similar sets."""
    members = stage(classes(records), "members")
    sets = stage(members.groupBy("sid").agg(F.first("tags").alias("tags")), "sets")
    return members.select("id", "sid", "class").distinct(), stage(similar_classes(sets, threshold, recall, small), "similar")


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different records with equal or similar sets."""
    members = members.select("id", "sid")
    several = members.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = several.select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    every = expand(members, links.select("a", "b").unionByName(inside), "sid").where("x <> y")
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class, n_equal, n_links): other records with the same set, and similar sets."""
    degree = links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("n_links"))
    equal = members.groupBy("sid").agg((F.count(F.lit(1)) - 1).alias("n_equal"))
    return members.join(equal, "sid").join(degree, "sid", "left").select("id", "class", "n_equal", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def class_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(class_a, class_b), class_a < class_b: classes with similar sets; with ``link_counts`` every pair can be told."""
    name = members.groupBy("sid").agg(F.first("class").alias("class"))
    both = links.join(name.select(F.col("sid").alias("a"), F.col("class").alias("ca")), "a").join(name.select(F.col("sid").alias("b"), F.col("class").alias("cb")), "b")
    return both.select(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b"))
