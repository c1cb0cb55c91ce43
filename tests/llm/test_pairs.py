import random

import numpy as np
import pytest

from tenderlake.llm import groups, neardup, setjoin

HQ = "id string, question string, answer string, h int, loaded_at timestamp"


def jaccard(a, b):
    return len(a & b) / len(a | b)


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def texts(n, seed, edits=(0, 4, 9, 25)):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    while len(out) < n:
        base = rng.sample(vocabulary, 60)
        for _ in range(rng.choice([1, 1, 3, 5])):
            t = [w if rng.random() > rng.choice(edits) / 60 else rng.choice(vocabulary) for w in base]
            rng.shuffle(t)
            out.append(" ".join(t))
    return out[:n]


@pytest.mark.parametrize("busy", [200, 3])
def test_groups_match_brute_force(spark, busy):
    data = {f"i{k:03d}": t for k, t in enumerate(texts(160, 4))}
    data |= {f"copy{k:03d}": data["i000"] for k in range(80)}  # a third of all rows
    df = spark.createDataFrame([(i, t[: len(t) // 2], t[len(t) // 2 :], 1, None) for i, t in data.items()], HQ)
    df = df.unionByName(df.limit(20))
    sets = {i: set(f"{t[: len(t) // 2]} {t[len(t) // 2 :]}".split()) for i, t in data.items()}
    sets = {i: s for i, s in sets.items() if len(s) >= 40}
    ids = sorted(sets)
    want = closure(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(sets[a], sets[b]) >= 0.7])
    got = neardup.near_groups(neardup.word_sets(df, "id", ["question", "answer"]), busy=busy).cache()
    found = {r["id"]: r["grp"] for r in got.collect()}
    assert set(found) == set(ids)
    same = lambda g: {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if g[a] == g[b]}
    assert same(found) == same(want)
    pairs = {(r["id_a"], r["id_b"]) for r in neardup.near_pairs(got).collect()}
    assert pairs == same(want)


def test_neardup_edges(spark, rows):
    long = " ".join(f"word{i}" for i in range(50))
    odd = [("a", None, long, 1, None), ("b", long.upper(), None, 1, None), ("c", "", "", 1, None), ("d", None, None, 1, None), (None, long, None, 1, None), ("e", " ".join(f"word{i}" for i in range(39)), "", 1, None), ("f", "x " * 200_000, long + " more", 1, None)]
    df = spark.createDataFrame(odd, HQ)
    got = neardup.near_groups(neardup.word_sets(df, "id", ["question", "answer"]))
    assert rows(neardup.near_pairs(got)) == [("a", "b"), ("a", "f"), ("b", "f")]
    assert neardup.near_groups(neardup.word_sets(df.limit(0), "id", ["question", "answer"])).count() == 0


def test_darts_meet_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    maker = neardup.DartMinHash(512)
    hashes = rng.integers(0, 1 << 63, 130).astype(np.uint64)
    a, b = np.arange(0, 100), np.arange(30, 130)
    for w in (np.ones(130), rng.uniform(0.2, 3.0, 130)):
        sig = maker.signatures(np.concatenate([hashes[a], hashes[b]]), np.concatenate([w[a], w[b]]), np.array([100, 100]))
        want = w[30:100].sum() / w.sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.09
    again = maker.signatures(hashes[a][::-1].copy(), np.ones(100), np.array([100]))
    assert (again == maker.signatures(hashes[a], np.ones(100), np.array([100]))).all()


def test_components_of_long_paths(spark, rows):
    links = [(i, i + 1) for i in range(0, 60) if i != 30] + [(100, 100)]
    got = groups.connected(spark.createDataFrame(links, "a int, b int"), spark.createDataFrame([(100,), (5,)], "node int"))
    assert rows(got) == sorted([(i, 0 if i <= 30 else 31) for i in range(61)] + [(100, 100)], key=str)


TAGS = "id string, tags array<string>, sid int"


@pytest.mark.parametrize("small", [128, 4, 2])
def test_similar_sets_match_brute_force(spark, small):
    rng = random.Random(8)
    names = ["all"] + [f"t{i}" for i in range(40)]
    data = {f"r{i:03d}": sorted({*rng.choices(names, weights=[25] + [3] * 6 + [1] * 34, k=rng.randint(1, 6))}) for i in range(250)}
    data |= {f"c{i:03d}": ["all", "t1"] for i in range(120)}
    df = spark.createDataFrame([(i, t, 1) for i, t in data.items()], TAGS)
    ids = sorted(data)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(set(data[a]), set(data[b])) >= 0.6}
    members, links = setjoin.similar_records(setjoin.tag_sets([(df, "id", "tags")]), small=small)
    got = {(r["id_a"], r["id_b"]) for r in setjoin.similar_pairs(members, links).collect()}
    assert got <= want and len(got) >= 0.995 * len(want)
    # classes, their links and the members tell every pair again
    of = {}
    for r in setjoin.link_counts(members, links).collect():
        of.setdefault(r["class"], []).append(r["id"])
        assert r["n_equal"] == sum(data[i] == data[r["id"]] for i in ids) - 1
    again = {tuple(sorted((x, y))) for r in setjoin.class_links(members, links).collect() for x in of[r["class_a"]] for y in of[r["class_b"]]}
    assert again | {(a, b) for c in of.values() for a in c for b in c if a < b} == got


def test_many_holders_of_one_set_keep_all_pairs(spark):
    df = spark.createDataFrame([(f"c{i:04d}", ["a", "b", "c"], 1) for i in range(1050)] + [(f"d{i}", ["a", "b", "c", "d"], 1) for i in range(3)], TAGS)
    pairs = setjoin.similar_pairs(*setjoin.similar_records(setjoin.tag_sets([(df, "id", "tags")])))
    assert pairs.count() == pairs.where("id_a < id_b").distinct().count() == 1053 * 1052 // 2
    pairs = groups.pairs_in_groups(df.selectExpr("id", "'c0000' AS grp"))
    assert pairs.count() == pairs.where("id_a < id_b").distinct().count() == 1053 * 1052 // 2


def test_sets_that_share_nothing_but_a_hot_core(spark):
    sets = [(i, ["a", "b", "c", f"u{i}"]) for i in range(200)] + [(200 + i, ["a", "b", "c", f"v{i}", f"w{i}"]) for i in range(140)] + [(900, ["a", "b", "c"])]
    got = setjoin.similar_classes(spark.createDataFrame(sets, "sid bigint, tags array<string>")).collect()
    want = {(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[k + 1 :] if jaccard(set(s), set(t)) >= 0.6}
    assert len(want) == 199 * 100 + 340 and {(r["a"], r["b"]) for r in got} == want


@pytest.mark.parametrize("small", [2, 16, 128])
def test_trees_alone_find_the_pairs_of_the_tables(spark, small):
    folder = "/root/testdata/sf0.001"
    parts = [(spark.read.parquet(f"{folder}/hq_001_030.parquet"), "id", "tags"), (spark.read.parquet(f"{folder}/proof_points.parquet"), "id", "covers_tags")]
    members = setjoin.classes(setjoin.tag_sets(parts))
    sets = {r["sid"]: set(r["tags"]) for r in members.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.6}
    got = {(r["a"], r["b"]) for r in setjoin.similar_classes(members.select("sid", "tags").distinct(), small=small).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 10


def test_trees_for_a_recall():
    assert setjoin.survival(0) == 1 and setjoin.survival(3) < setjoin.survival(2)
    for depth in (1, 3, 9):
        missed = (1 - setjoin.survival(depth)) ** setjoin.trees_for(0.99, depth)
        assert missed <= 0.01


def test_large_sets_with_a_hot_part(spark):
    rng = random.Random(12)
    core = [f"core{i}" for i in range(10)]
    sets = [(i, sorted({*core, *(f"x{rng.randrange(60)}" for _ in range(12))})) for i in range(150)]
    sets += [(1000 + i, sorted({*rng.sample(s, len(s) - 3), "extra"})) for i, s in sets[:60]]
    got = {(r["a"], r["b"]) for r in setjoin.similar_classes(spark.createDataFrame(sets, "sid bigint, tags array<string>"), small=8).collect()}
    want = {(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[k + 1 :] if jaccard(set(s), set(t)) >= 0.6}
    assert got <= want and len(got) >= 0.98 * len(want) >= 50


def test_tags_are_cleaned(spark, rows):
    odd = [("a", [" Cloud_Based ", "x", None, ""], 1), ("b", ["cloud based", "X", "x"], 1), ("c", [], 1), ("d", None, 1), ("e", [" ", None], 1), (None, ["x"], 1), ("a", [" Cloud_Based ", "x", None, ""], 1)]
    df = spark.createDataFrame(odd, TAGS)
    sets = setjoin.tag_sets([(df, "id", "tags"), (df.limit(0), "id", "tags")])
    assert rows(sets) == [("a", ["cloud-based", "x"]), ("b", ["cloud-based", "x"])]
    assert rows(setjoin.similar_pairs(*setjoin.similar_records(sets))) == [("a", "b")]
    assert setjoin.similar_pairs(*setjoin.similar_records(sets.limit(0))).count() == 0
