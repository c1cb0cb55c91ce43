"""Near duplicates of records with small edits.

The distinct words of a record form a weighted set. DartMinHash throws darts, fixed by hashes,
at the regions (weight x rank) of its elements; the dart of least rank in each coordinate is kept,
so that two sets agree in a coordinate with a probability of their weighted Jaccard similarity.
Bands of coordinates are joined; a bit sketch of all coordinates drops most chance meetings, and
the rest is verified exactly on the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.groups import connected, in_blocks, pairs_in_groups
from tenderlake.session import stage

THRESHOLD = 0.7
MIN_WORDS = 40
#: Bands and coordinates of each: a pair at 0.7 is missed with a probability of (1 - 0.7^6)^48 < 0.3 %.
BANDS, ROWS = 48, 6
SKETCH_BITS = 256
#: Agreeing sketch bits wanted: a pair at 0.7 has 217.6 of 256 on average, with a deviation of 5.7.
SKETCH_AGREE = 190
#: Buckets with more records than this are compared by way of a hub.
BUSY = 200
SEED = 0xD1B54A32D192ED03
WIDTH = 4  # ranks that one cell of darts covers

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class DartMinHash:
    """Signatures of ``k`` coordinates for weighted sets of 64-bit elements."""

    def __init__(self, k: int, seed: int = SEED):
        self.k, self.seed = k, np.uint64(seed)
        self.darts = k * (math.log(k) + 2)  # expected inside a set's region, so that few coordinates stay empty
        rate, p, cdf = float(WIDTH), math.exp(-WIDTH), []
        total, n = 0.0, 0
        while total < 1 - 1e-12:
            total += p
            cdf.append(total)
            n += 1
            p *= rate / n
        self.poisson = np.array(cdf)

    def signatures(self, elements: np.ndarray, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One row of ``k`` values for each of the consecutive sets; sets must not be empty."""
        sets = len(lengths)
        out = np.full((sets, self.k), np.iinfo(np.uint64).max, dtype=np.uint64)
        owner = np.repeat(np.arange(sets), lengths)
        mass = np.bincount(owner, weights, sets)
        todo, reach = np.arange(sets), self.darts / mass
        while len(todo):
            pick = np.isin(owner, todo) if len(todo) < sets else slice(None)
            self._throw(out, elements[pick].astype(np.uint64), weights[pick], owner[pick], reach)
            todo = todo[(out[todo] == np.iinfo(np.uint64).max).any(1)]
            out[todo] = np.iinfo(np.uint64).max
            reach[todo] *= 2
        return out

    def _throw(self, out: np.ndarray, elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, reach: np.ndarray) -> None:
        """Keep the earliest dart of each coordinate among those below ``reach`` and within the weight.

        Darts depend on the element alone, so those of an element that many sets have are thrown once.
        """
        for layer in range(int(math.ceil(weights.max()))):
            inside = weights > layer
            e, w, o = elements[inside], weights[inside] - layer, owner[inside]
            cells = np.ceil(reach[o] / WIDTH).astype(np.int64)
            single, of = np.unique(e, return_inverse=True)
            most = np.zeros(len(single), dtype=np.int64)
            np.maximum.at(most, of, cells)
            at, before = np.repeat(np.arange(len(single)), most), np.cumsum(most) - most
            cell = np.arange(len(at)) - before[at]
            base = _mixed(single[at] ^ self.seed ^ _mixed((cell.astype(np.uint64) << np.uint64(8)) + np.uint64(layer + 1)))
            n = np.searchsorted(self.poisson, (base >> np.uint64(11)).astype(np.float64) / (1 << 53))
            which, start = np.repeat(np.arange(len(at)), n), np.concatenate([[0], np.cumsum(n)])
            no = np.arange(len(which)) - start[which]
            dart = _mixed(base[which] + (no.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            place = _mixed(dart ^ np.uint64(0xA0761D6478BD642F))
            rank = (cell[which] + (dart >> np.uint64(32)).astype(np.float64) / (1 << 32)) * WIDTH
            # rank first, then bits of the dart: the least value names the earliest dart
            value = ((rank * (1 << 20)).astype(np.uint64) << np.uint64(24)) | (_mixed(dart) >> np.uint64(40))
            slot, height = (place % np.uint64(self.k)).astype(np.int64), (place >> np.uint64(40)).astype(np.float64) / (1 << 24)
            # the darts of an element's first cells lie side by side
            low, high = start[before[of]], start[before[of] + cells]
            hit = np.repeat(np.arange(len(e)), high - low)
            mine = np.arange(len(hit)) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)
            good = rank[mine] < reach[o][hit]
            if (w < 1).any():
                good &= height[mine] < w[hit]
            mine, hit = mine[good], hit[good]
            np.minimum.at(out.reshape(-1), (o * self.k)[hit] + slot[mine], value[mine])


def words(*texts: Column) -> Column:
    """Distinct runs of letters, marks and digits of the joined texts, lower-cased."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(r"[\p{L}\p{M}\p{Nd}]+"), F.lit(0)))


def word_sets(df: DataFrame, id_col: str, texts: list[str], min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h): sorted hashes of each record's words; of an id delivered more than once the latest counts."""
    h = F.sort_array(F.transform(words(*[F.col(t) for t in texts]), lambda w: F.xxhash64(w)))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "loaded_at", h.alias("h")).where(F.size("h") >= min_words)
    return rows.groupBy("id").agg(F.max(F.struct("loaded_at", "h")).alias("last")).select("id", F.col("last.h").alias("h"))


def _signed(bands: int, rows: int, bits: int):
    k = bands * rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = DartMinHash(k)
        for batch in batches:
            for at in range(0, len(batch), 400):
                part = batch.iloc[at : at + 400]
                sets = [np.asarray(h, dtype=np.int64).view(np.uint64) for h in part["h"]]
                lengths = np.array([len(s) for s in sets])
                flat = np.concatenate(sets)
                sig = maker.signatures(flat, np.ones(len(flat)), lengths)
                key = np.zeros((len(sets), bands), dtype=np.uint64)
                for r in range(rows):
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands] + np.uint64(1))
                key = _mixed(key + np.arange(bands, dtype=np.uint64))
                bit = (_mixed(sig[:, :bits]) & np.uint64(1)).astype(np.uint8)
                sketch = np.packbits(bit, axis=1).view(np.uint64).view(np.int64)
                yield pd.DataFrame({"no": part["no"].to_numpy(), "keys": list(key.view(np.int64)), "sketch": list(sketch)})

    return run


def agreeing(a: str, b: str, bits: int = SKETCH_BITS) -> Column:
    """Bits that two sketches have in common."""
    differ = [F.bit_count(F.expr(f"{a}.s{i} ^ {b}.s{i}")) for i in range(bits // 64)]
    return F.lit(bits) - sum(differ[1:], differ[0])


def similar(ha: str, hb: str, threshold: float) -> Column:
    both = F.size(F.array_intersect(ha, hb))
    return both >= threshold * (F.size(ha) + F.size(hb) - both) - 1e-9


def near_links(sets: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, agree: int = SKETCH_AGREE, busy: int = BUSY) -> DataFrame:
    """Links (a, b), a < b, between different sets of at least ``threshold`` Jaccard similarity.

    ``sets`` has no (a number) and h, no h twice. Buckets of at most ``busy`` records are compared
    pair by pair. In a larger one every record is first compared with the bucket's hub (its least
    number); only records not similar to the hub are then compared with all the others, in blocks.
    Records similar to the hub are linked through it, so groups stay whole, and no bucket gives all
    its pairs: the links are enough to tell the groups, not all there are.
    """
    signed = stage(sets.mapInPandas(_signed(bands, rows, bits), "no bigint, keys array<bigint>, sketch array<bigint>"), "signed")
    # most keys are one record's only; sketches join those that are not
    keyed = signed.select("no", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("hub")).where("n > 1")
    sketches = signed.select("no", *[F.col("sketch")[i].alias(f"s{i}") for i in range(bits // 64)])
    rows_in = stage(keyed.join(buckets, "key").join(sketches, "no"), "buckets")
    few, many = rows_in.where(F.col("n") <= busy), rows_in.where(F.col("n") > busy)
    x, y = few.alias("x"), few.alias("y")
    candidates = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.no") < F.col("y.no")) & (agreeing("x", "y", bits) >= agree)).select(F.col("x.no").alias("a"), F.col("y.no").alias("b"))
    links = _verified(candidates.distinct(), sets, threshold)
    if not many.isEmpty():
        with_hub = _verified(many.where("no <> hub").select(F.col("hub").alias("a"), F.col("no").alias("b")).distinct(), sets, threshold)
        with_hub = stage(with_hub, "hubs")
        linked = with_hub.select(F.col("a").alias("hub"), F.col("b").alias("no"))
        x, y = in_blocks(many.where("no <> hub").join(linked, ["hub", "no"], "left_anti"), many, "key", "no")
        x, y = x.alias("x"), y.alias("y")
        met = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        others = x.join(y, met & (F.col("x.no") != F.col("y.no")) & (agreeing("x", "y", bits) >= agree)).select(F.least("x.no", "y.no").alias("a"), F.greatest("x.no", "y.no").alias("b"))
        links = links.unionByName(with_hub).unionByName(_verified(others.distinct(), sets, threshold)).distinct()
    return links


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    a = sets.select(F.col("no").alias("a"), F.col("h").alias("ha"))
    b = sets.select(F.col("no").alias("b"), F.col("h").alias("hb"))
    return pairs.join(a, "a").join(b, "b").where(similar("ha", "hb", threshold)).select("a", "b")


def near_groups(sets: DataFrame, threshold: float = THRESHOLD, **options: int) -> DataFrame:
    """(id, class, grp) of every record.

    ``sets`` comes from ``word_sets``. Records with the same words are one class, named by its
    least id; classes reachable from each other over links of at least ``threshold`` are one
    group, named by the least class. Records that are like no other are groups of their own. Ids
    are compared as strings.
    """
    # records meet by 128 bits of hash, not by their words; classes are numbered
    key = [F.xxhash64("h").alias("k0"), F.xxhash64(F.lit(SEED >> 1), "h").alias("k1")]
    sets = stage(sets.select(F.col("id").cast("string").alias("id"), "h", *key), "words")
    classes = sets.groupBy("k0", "k1").agg(F.min("id").alias("class"))
    reps = sets.join(classes.select(F.col("class").alias("id")), "id", "left_semi")
    reps = stage(reps.select(F.monotonically_increasing_id().alias("no"), F.col("id").alias("class"), "k0", "k1", "h"), "classes")
    links = stage(near_links(reps.select("no", "h"), threshold, **options), "near")
    found = reps.select("no", "class").join(connected(links).withColumnRenamed("node", "no"), "no")
    groups = found.groupBy("component").agg(F.min("class").alias("grp"))
    grouped = found.join(groups, "component").select("class", "grp")
    named = reps.select("k0", "k1", "class").join(grouped, "class", "left").withColumn("grp", F.coalesce("grp", "class"))
    return sets.select("id", "k0", "k1").join(named, ["k0", "k1"]).select("id", "class", "grp")


def near_pairs(groups: DataFrame) -> DataFrame:
    return pairs_in_groups(groups.select("id", "grp"))
