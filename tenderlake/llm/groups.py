"""Classes of equal items, groups of linked ones, and the pairs they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.session import stage

#: Ids of one key that are paired with others in one part.
PAIR_BLOCK = 1000
#: Rows of a side of one key that are compared in one part.
COMPARE_BLOCK = 2000


def connected(links: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that can be reached over links.

    ``links`` has columns a and b. Stars are contracted in turn (every node is linked to the least
    of its greater and smaller neighbours) until nothing changes, in a number of rounds that grows
    with the logarithm of the longest path. Each round is written to the shared folder. Nodes of
    ``nodes`` (column node) without links are components of their own.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["c"]).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(low, large["u"] == low["c"])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "stars")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    if nodes is None:
        return found
    return found.unionByName(nodes.select("node").join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def in_blocks(left: DataFrame, right: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with part numbers i and j: every two rows of an equal ``key`` share exactly one part.

    Rows of a key are spread by the hash of ``by`` over blocks of about COMPARE_BLOCK of each side.
    """
    blocks = lambda df, name: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / COMPARE_BLOCK).cast("int").alias(name))
    n = blocks(left, "_nx").join(blocks(right, "_ny"), key)
    own, every = lambda c: F.pmod(F.xxhash64(by), c).cast("int"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = left.join(n, key).withColumn("i", own("_nx")).withColumn("j", every("_ny"))
    b = right.join(n, key).withColumn("i", every("_nx")).withColumn("j", own("_ny"))
    return a.drop("_nx", "_ny"), b.drop("_nx", "_ny")


def expand(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(x, y) for each id x of ``a`` and y of ``b`` of every link; ids of a large key come in blocks.

    ``members`` has id and ``key``, no row twice; ``links`` has a and b, keys that may be equal.
    """
    sizes = members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")
    blocks = stage(members.join(sizes, key).select(key, "id", part).groupBy(key, "part").agg(F.collect_list("id").alias("ids")), "blocks")
    keys = blocks.select(F.col(key).alias("k"), "part")
    met = links.join(keys.select(F.col("k").alias("a"), F.col("part").alias("pa")), "a").join(keys.select(F.col("k").alias("b"), F.col("part").alias("pb")), "b")
    x = blocks.select(F.col(key).alias("a"), F.col("part").alias("pa"), F.col("ids").alias("xs"))
    y = blocks.select(F.col(key).alias("b"), F.col("part").alias("pb"), F.col("ids").alias("ys"))
    both = met.join(x, ["a", "pa"]).join(y, ["b", "pb"])
    return both.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))


def pairs_in_groups(members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids in the same group; ``members`` has id and grp."""
    busy = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    kept = members.select("id", "grp").join(busy, "grp").distinct()
    pairs = expand(kept, busy.select(F.col("grp").alias("a"), F.col("grp").alias("b")), "grp")
    return pairs.where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
