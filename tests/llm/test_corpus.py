import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import language, mixing, packing, splitting, tokens

LIMITS = "pack_name string, capacity_tokens int"


def test_token_counts(spark):
    texts = ["Hello world, again.", "", None, "परीक्षण और जाँच", "<|endoftext|>", "a" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(tokens.n_tokens(F.col("text")))
    got = [r[0] for r in df.collect()]
    assert got == [tokens.count_tokens(t) for t in texts] and got[1] == got[2] == 0 and got[0] > 0


def test_packing_is_whole_and_within_capacity(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 3, 40, 97, 100, 101, 250, rng.randint(1, 100)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(-1, None, "x")], "doc bigint, size bigint, container string").repartition(7)
    limits = spark.createDataFrame([("a", 100), ("b", 64), ("none", 0), ("none", None), ("a", 120)], LIMITS)
    out = packing.pack(df, limits, "doc", F.col("size"), windows=8, fan_in=3).toPandas()
    assert set(out["pack_name"]) == {"a", "b"}
    for name, capacity in (("a", 100), ("b", 64)):
        p = out[out["pack_name"] == name]
        assert p.groupby("container")["n_tokens"].sum().max() <= capacity
        assert p.groupby("doc")["n_tokens"].sum().to_dict() == {i: s for i, s in enumerate(sizes) if s}
        whole = p[p["doc"].map(lambda i: sizes[i] <= capacity)]
        assert (whole["piece_no"] == 0).all() and whole["doc"].is_unique
        offline = packing.Packer(capacity, 1 << 30)  # every container open, largest first
        boxes = {offline.put(int(n))[0] for n in sorted(p["n_tokens"], reverse=True)}
        assert p["container"].nunique() <= 1.06 * len(boxes)
    report = {r["pack_name"]: r for r in packing.fill_report(spark.createDataFrame(out), limits).collect()}
    assert report["a"]["n_tokens"] == sum(sizes) and report["a"]["n_containers"] >= report["a"]["least_containers"]
    assert packing.pack(df.limit(0), limits, "doc", F.col("size")).count() == 0
    assert packing.pack(df, limits.limit(0), "doc", F.col("size")).count() == 0


def test_packer_keeps_few_containers_open():
    packer = packing.Packer(10, 3)
    closed = [c for size in [6, 7, 8, 9, 4, 3, 10, 2] for c in packer.put(size)[1]]
    assert len(packer.open) <= 3 and len(closed) == len(set(closed))
    with pytest.raises(ValueError):
        packer.put(11)


def mixed(spark, n=6000, hot="big", weight=None):
    rng = random.Random(4)
    rows = [(i, rng.choice([hot, hot, f" {hot.title()} ", "mid-size", "small", "other", None]), rng.randint(1, 400), 1) for i in range(n)]
    df = spark.createDataFrame(rows, "doc bigint, source string, n_tokens int, times int")
    targets = spark.createDataFrame([(hot, 0.2, 2), ("mid_size", 0.5, 5), ("small", 0.3, 1), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    return df, *mixing.mix(df, targets, "doc", weight)


def test_mix_meets_shares(spark):
    df, mix, report = mixed(spark)
    r = {x["source"]: x for x in report.collect()}
    total = sum(x["tokens_available"] for x in r.values())
    assert abs(sum(x["tokens_used"] for x in r.values()) / total - 1) < 0.002
    # small may be used once; what it lacks goes to the others in proportion
    assert r["small"]["most_copies"] == 1 and r["small"]["tokens_used"] == r["small"]["tokens_available"]
    assert abs(r["mid_size"]["tokens_used"] / r["big"]["tokens_used"] - 2.5) < 0.01
    assert r["absent"]["tokens_used"] == 0 and r["absent"]["n_docs"] == 0
    m = mix.toPandas()
    assert m["doc"].is_unique and (m["copies"] >= 1).all()
    spread = m[m["source"] == "mid_size"]["copies"]
    assert spread.max() - spread.min() <= 1
    again = mixed(spark)[1].toPandas()
    assert m.sort_values("doc").reset_index(drop=True).equals(again.sort_values("doc").reset_index(drop=True))


def test_mix_weights_and_empty(spark):
    weight = F.when(F.col("doc") % 4 == 0, 3.0).when(F.col("doc") % 4 == 1, None).when(F.col("doc") % 4 == 2, 0.5).otherwise(-1.0)
    df, mix, report = mixed(spark, weight=weight)
    r = {x["source"]: x for x in report.collect()}
    assert abs(r["mid_size"]["tokens_used"] / r["big"]["tokens_used"] - 2.5) < 0.02
    assert all(x["most_copies"] <= x["max_repeats"] for x in r.values())
    # repeats of a record are in proportion to its weight, but for the most there may be
    copies = mix.toPandas().set_index("doc")["copies"]
    docs = df.toPandas()
    docs["copies"], docs["w"] = docs["doc"].map(copies).fillna(0), docs["doc"].map(lambda i: (3.0, 1.0, 0.5, 1.0)[i % 4])
    for source, most in (("big", 2), ("mid-size", 5)):
        mean = docs[docs["source"].str.strip().str.lower() == source].groupby("w")["copies"].mean()
        assert mean[1.0] == pytest.approx(2 * mean[0.5], rel=0.12) and mean[3.0] == pytest.approx(min(most, 3 * mean[1.0]), rel=0.12)
    empty = spark.createDataFrame([], "doc bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix(empty, targets, "doc")
    assert mix.count() == 0 and report.first()["tokens_used"] == 0


def test_rate_meets_the_size():
    bins = [(0.5, 100.0), (1.0, 50.0), (4.0, 30.0)]
    for cap, wanted in ((2, 40.0), (2, 200.0), (1, 170.0)):
        c = mixing.rate(bins, cap, wanted)
        assert sum(min(c * w, cap) * t for w, t in bins) == pytest.approx(wanted)
    assert mixing.rate(bins, 1, 500.0) * 0.5 >= 1 and mixing.rate([], 3, 0.0) == 3


def test_allocation():
    got = mixing.allocate([("a", 0.5, 1), ("b", 0.5, 10)], {"a": 100, "b": 300})
    assert got == {"a": 1.0, "b": 1.0}
    assert mixing.allocate([("a", 1.0, 3)], {"a": 10}) == {"a": 1.0}
    assert mixing.allocate([("a", 0.0, 3), ("b", 1.0, 0)], {"a": 10, "b": 5}) == {"a": 0.0, "b": 0.0}


def best_cost(text, limit, overlap):
    """Every way to cut at the allowed positions, tried one by one."""
    stride = limit - overlap
    pos, kinds = splitting.boundaries(text, stride)
    least = int(np.ceil((len(text) - overlap) / stride))
    ideal = (len(text) + (least - 1) * overlap) / least
    best = [np.inf]

    def go(i, cost):
        if i == len(pos) - 1:
            best[0] = min(best[0], cost)
            return
        for j in range(i + 1, len(pos)):
            size = pos[j] - pos[i] + (overlap if i else 0)
            if size > limit:
                break
            if i == 0 and pos[j] <= overlap:
                continue
            last = j == len(pos) - 1
            go(j, cost + splitting.EVEN * ((size - ideal) / limit) ** 2 + splitting.PIECE + (0 if last else splitting.PENALTY[splitting.KINDS[kinds[j]]]))

    go(0, 0.0)
    return best[0], ideal


def test_cuts_are_optimal_and_whole():
    rng = random.Random(6)
    parts = ["One here. ", "two, ", "x", "\n\n", "\n", "word ", "é", "longword" * 4, "\n# Head\n", "और ", "𝄞"]
    for _ in range(120):
        limit, overlap = rng.choice([(30, 0), (30, 5), (50, 20)])
        text = "".join(rng.choices(parts, k=rng.randint(5, 26)))
        pieces = splitting.cut(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < e - s <= limit for s, e, _ in pieces)
        assert all(b[0] == a[1] - overlap >= 0 and b[1] > a[1] for a, b in zip(pieces, pieces[1:]))
        assert text == text[: pieces[0][1]] + "".join(text[s + overlap : e] for s, e, _ in pieces[1:])
        if len(text) > limit and len(splitting.boundaries(text, limit - overlap)[0]) < 22:
            want, ideal = best_cost(text, limit, overlap)
            got = sum(splitting.EVEN * ((e - s - ideal) / limit) ** 2 + splitting.PIECE + splitting.PENALTY.get(k, 0) for s, e, k in pieces)
            assert got == pytest.approx(want)


def test_split_table(spark, rows):
    long = "A sentence of words here. " * 20
    data = [("c1", f"  \n{long}\t", None), ("c1", f"  \n{long}\t", None), ("c2", "x" * 100, None), ("c3", "y" * 101, None), ("c4", None, None), ("c5", " " * 500, None), ("c6", "𝄞" * 100, None), ("c7", "", None)]
    df = spark.createDataFrame(data, "id string, text string, loaded_at timestamp").withColumn("max_chars", F.lit(1))
    limits = spark.createDataFrame([("chunk", "text", 100, None), ("chunk", "text", 0, 5), ("other", "text", 1, 0)], "tbl string, field string, max_chars int, overlap_chars int")
    out = splitting.split([splitting.items("chunk", "text", df, F.lit(""), F.col("id"))], limits)
    assert rows(out.where("piece_no = 1"), "tbl", "run_id", "item_id") == [("chunk", "", "c1"), ("chunk", "", "c3")]
    assert "".join(r["text"] for r in out.where("item_id = 'c1'").orderBy("piece_no").collect()) == long.strip()
    assert splitting.split([splitting.items("chunk", "text", df.limit(0), F.lit(""), F.col("id"))], limits).count() == 0


SAID = {
    "en": "The service team checks all the orders before they are sent to the client. We keep the records for three years.",
    "de": "Die Gruppe prüft alle Bestellungen, bevor sie an den Kunden gehen. Wir bewahren die Unterlagen drei Jahre lang auf.",
    "fr": "L'équipe vérifie toutes les commandes avant leur envoi au client. Nous gardons les dossiers pendant trois ans.",
    "hi": "दल सभी आदेशों की जाँच करता है और फिर उन्हें ग्राहक को भेजता है। हम अभिलेख तीन वर्ष रखते हैं।",
}
CODES = [("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French"), ("hi", "hin", "Hindi")]
DOC = "doc_id bigint, text string, lang string, code string"


def test_languages_labels_and_passages(spark, rows):
    data = [(i * 10 + k, SAID[c], c, None) for i in range(8) for k, c in enumerate(SAID)]
    data += [(1001, SAID["de"], "English", None), (1002, SAID["de"], " DEU ", None), (1003, SAID["fr"], "fr_BE", None), (1004, SAID["en"], None, None), (1005, SAID["en"], "??", None)]
    data += [(1006, SAID["en"] + "\n\n" + SAID["en"] + " \r\n \r\n" + SAID["fr"], "en", None), (1007, SAID["en"] + " The annex “die Bestellungen” is listed.", "en-IN", None)]
    data += [(1008, None, "en", None), (1009, " \n ", None, None), (1010, "123 456", None, None), (1011, (SAID["hi"] + "\n\n") * 2000, "hindi", None)]
    df, codes = spark.createDataFrame(data, DOC), spark.createDataFrame(CODES, "code string, code3 string, name_en string")
    got = language.languages(df, codes).cache()
    assert rows(language.found(got)) == sorted([(1001, 0, "de"), (1004, 0, "en"), (1005, 0, "en"), (1006, 1, "en"), (1006, 2, "en"), (1006, 3, "fr")], key=str)
    conf = got.agg(F.min("confidence"), F.max("confidence"), F.min("share"), F.max("share")).first()
    assert 0 <= conf[0] <= conf[1] <= 1 and 0 < conf[2] <= conf[3] == 1
    assert language.languages(df.limit(0), codes).count() == 0
    assert language.languages(df, codes.limit(0)).count() == 0


@pytest.fixture(scope="module")
def held_out(spark):
    """A model of the odd documents of a table, and passages of the even ones that it and their labels agree on."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    codes = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{folder}/lang_codes.parquet").collect()]
    known = docs.where("text IS NOT NULL").select("doc_id", "text", language.label_code(F.col("lang"), codes).alias("code")).where("code IS NOT NULL").collect()
    train, test = [r for r in known if r["doc_id"] % 2], [r for r in known if not r["doc_id"] % 2]
    model = language.fit([(r["text"], r["code"]) for r in train], sorted(c for c, _, _ in codes))
    return model, language.Scorer(model.weights), test


def test_held_out_accuracy(held_out):
    model, scorer, test = held_out
    best, _ = model.decode(*scorer.score([r["text"] for r in test]))
    right = np.mean([model.languages[b] == r["code"] for b, r in zip(best, test)])
    assert right > 0.85  # some labels are wrong themselves


def test_confidence_follows_accuracy(held_out):
    model, scorer, test = held_out
    rng = random.Random(9)
    blocks = [(b.split(), model.languages.index(r["code"])) for r in test for b in language.passages(r["text"])]
    best, _ = model.decode(*scorer.score([" ".join(b) for b, _ in blocks]))
    sound = [x for x, k in zip(blocks, best) if x[1] == k]
    said, sure = [], []
    for n in (1, 2, 4, 12, 40):
        pieces = [(tokens[at : at + n], lang) for tokens, lang in rng.choices(sound, k=400) for at in [rng.randrange(max(1, len(tokens) - n + 1))]]
        best, odds = model.decode(*scorer.score([" ".join(p) for p, _ in pieces]))
        said.append(np.mean([b == lang for b, (_, lang) in zip(best, pieces)]))
        sure.append(odds.max(1).mean())
    assert all(abs(a - b) < 0.1 for a, b in zip(said, sure))  # single words are often wrong, and known to be
    assert said[0] < 0.95 < said[-1] and sure[0] < 0.95 < sure[-1]
    # half the words of one language, half of another
    halves = [(x, y) for x, y in zip(rng.choices(sound, k=300), rng.choices(sound, k=300)) if x[1] != y[1]]
    _, mixed = model.decode(*scorer.score([" ".join(x[0][:10] + y[0][:10]) for x, y in halves]))
    _, plain = model.decode(*scorer.score([" ".join(x[0][:20]) for x, _ in halves]))
    assert language.ambiguous(mixed).mean() > 0.05 > language.ambiguous(plain).mean() and mixed.max(1).mean() < plain.max(1).mean() - 0.1


def test_codewords_differ():
    code = language.codewords(8)
    far = (code[:, None, :] != code[None, :, :]).sum(-1)[np.triu_indices(8, 1)]
    assert code.shape == (8, language.N_BITS) and far.min() >= 6 and (np.abs(code.sum(0)) <= 0).all()
