import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import answers as A
from tenderlake.llm import crf

SCHEMA = "id string, question string, answer string, status string, clauses int, loaded_at timestamp"
Q = "Which backup copies do you keep for the payroll system?"
SOUND = ["We keep two copies of the payroll data in two places and test them every month.", "The operations team checks the copies each week and reports to the client.", "If a copy fails, the plan allows 3 days to replace it with a new one."]
DE = "Wir prüfen die Sicherungen jeden Monat und melden das Ergebnis dem Auftraggeber. Die Kosten für die Kopien sind für das Jahr festgelegt und werden nicht erhöht."
CASES = {
    "null": (None, "empty"), "blank": ("  \n\t", "empty"), "dots": ("...", "empty"), "markup": ("<p> </p>", "empty"), "todo": ("**TODO**", "empty"), "na": ("n/a", "empty"), "lead": ("Answer: ", "empty"), "invisible": ("​ ", "empty"),
    "sound": (" ".join(SOUND), None), "yes": ("Yes.", None), "short": ("3 days.", None), "nostop": (SOUND[0] + "\n- daily copies\n- weekly copies", None), "annex": (SOUND[0] + " (see Annex C)", None), "table": (SOUND[0] + "\n| Item | Days |\n|---|---|\n| copies | 3 |", None),
    "quote": (SOUND[0] + " The annex “die Sicherung der Daten” is listed. " + SOUND[1], None), "reserve": ("We are unable to release raw copies; instead the following applies. " + " ".join(SOUND), None), "asked": (f"You asked: {Q} " + " ".join(SOUND), None),
    "cut": (SOUND[0] + " The operations team checks the", "truncated"), "comma": (SOUND[0] + " Each week the team,", "truncated"), "dots2": (SOUND[0] + " The service team reports …", "truncated"), "list": (SOUND[0] + " Included are (1) copies, (2) tests, (3)", "truncated"), "bullet": (SOUND[0] + "\n- daily copies\n- for", "truncated"),
    "sorry": ("Unfortunately, we are not able to answer this question.", "refusal"), "topic": ("Requests about payroll copies will not be answered by us.", "refusal"), "polite": ("Thank you for asking. I can't help with this request. Please contact the owner of the bid.", "refusal"),
    "copy": (Q, "copied_question"), "upper": (Q.upper(), "copied_question"), "re": (f"Re: {Q}", "copied_question"), "part": ("do you keep for the payroll system", "copied_question"), "twice": (f"{Q} {Q}", "copied_question"),
    "german": (DE, "other_language"), "hindi": ("हम हर महीने प्रतियों की जाँच करते हैं और ग्राहक को बताते हैं। लागत में यह शामिल है।", "other_language"),
}


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(k, Q, a, "APPROVED", 1, None) for k, (a, _) in CASES.items()]
    for i in range(12):
        rows.append((f"s{i}", f"How is part {i} of the service handled by the team?", " ".join(SOUND[(i + j) % 3] for j in range(2 + i % 2)), " Approved ", 1, None))
        rows.append((f"g{i}", f"Wie werden die Sicherungen im Werk {i} geprüft und wer ist für das Ergebnis zuständig?", DE, "approved", 1, None))
    return spark.createDataFrame(rows, SCHEMA)


def test_cases(pairs):
    got = {r["id"]: r["defect"] for r in A.defective_pairs(pairs.unionByName(pairs)).collect()}
    wrong = {k: (got.get(k), want) for k, (_, want) in CASES.items() if got.get(k) != want}
    assert not wrong
    assert not [k for k in got if k[0] in "sg" and k[1:].isdigit()]


def test_status_nulls_and_empty(spark, pairs):
    odd = spark.createDataFrame([("d", Q, None, "DRAFT", 1, None), ("n", Q, None, None, 1, None), ("q", None, "What is it?", "APPROVED", 1, None), (None, Q, None, "APPROVED", 1, None), ("e", "", SOUND[0], "approved ", 1, None), ("long", Q, " ".join(SOUND) * 3000, "APPROVED", 1, None)], SCHEMA)
    assert {r["id"] for r in A.defective_pairs(odd).collect()} == set()
    assert A.defective_pairs(pairs.limit(0)).count() == 0


def features(sequences):
    """Dense features, and the place of the largest as a word."""
    flat = np.concatenate(sequences).astype(np.float32)
    return crf.Features(flat, flat.argmax(1), np.arange(len(flat)), np.array([len(s) for s in sequences]))


def test_field_finds_the_tags_it_was_made_from():
    rng = np.random.default_rng(1)
    x = [np.eye(3)[rng.integers(0, 3, n)] for n in (3, 4, 5) * 20]
    f = features(x)
    model = crf.train(f, f.dense.argmax(1), 3, 4)
    tags, sure = model.decode(f)
    assert (tags == f.dense.argmax(1)).all() and (sure > 0.5).all()
    # words alone are enough
    blind = crf.Features(np.zeros_like(f.dense), f.buckets, f.item, f.lengths)
    assert (crf.train(blind, f.buckets, 3, 4).decode(blind)[0] == f.buckets).all()


def test_decoding_is_the_best_path_of_each_sequence():
    rng = np.random.default_rng(2)
    model = crf.Chain(rng.normal(size=(4, 3)), rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    x = [rng.normal(size=(n, 4)) for n in (4, 1, 3, 4, 2)]
    f = features(x)
    f.lengths = np.array([4, 1, 0, 3, 4, 2])  # one without items
    tags, sure = model.decode(f)
    e, at = model.scores(f), 0
    for n, odds in zip(f.lengths, sure):
        own = e[at : at + n]
        score = lambda p: model.start[p[0]] + sum(own[t, p[t]] for t in range(len(p))) + sum(model.step[p[t], p[t + 1]] for t in range(len(p) - 1))
        if n:
            paths = list(np.ndindex(*[3] * n))
            scores = np.array([score(p) for p in paths])
            assert tuple(tags[at : at + n]) == paths[scores.argmax()]
            assert odds == pytest.approx(np.exp(scores.max() - scores.max()) / np.exp(scores - scores.max()).sum())
        else:
            assert odds == 1
        at += n
    none = crf.Features(np.zeros((0, 4), dtype=np.float32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.array([0, 0]))
    assert len(model.decode(none)[0]) == 0


def test_shares_cover_the_answer(pairs):
    r = A.defects(pairs, None).where("id = 'reserve'").first()
    assert r["answer"] > 0.6 and abs(sum(r[t] for t in A.TAGS) - 1) < 1e-9


def test_field_learns_the_tables_wording(spark):
    """Refusals and placeholders put in words that no training phrase has as a whole, among the rows of a table."""
    folder = "/root/testdata/sf0.01"
    hq = spark.read.parquet(f"{folder}/hq_001_030.parquet").where(A.approved(F.col("status"))).select("id", "question", "answer")
    odd = {
        "refusal": ["We are not prepared to provide a response on this.", "Nobody here can say anything on that question.", "That request has to be declined, sorry.", "Your question must stay without an answer here.", "I am not allowed to give you information about this."],
        "empty": ["[ANSWER PENDING]", "<TBC>", "Answer: to be completed.", "(unknown)", "text to be added"],
        None: ["Yes, for all depots in the north.", "Every second month, by the audit desk.", "We cannot promise a date for the depots. " + " ".join(SOUND), "Not before May; the operations team then moves the records in two steps and reports each week."],
    }
    rows = [(f"odd{i}", "How are the meter readings of the depots kept in step?", a, d) for i, (d, a) in enumerate((d, a) for d, group in odd.items() for a in group)]
    added = spark.createDataFrame([r[:3] for r in rows], "id string, question string, answer string")
    got = {r["id"]: r["defect"] for r in A.defects(hq.unionByName(added)).where("id LIKE 'odd%'").collect()}
    right = [got[i] == d for i, _, _, d in rows]
    assert sum(right) >= len(right) - 2, [(a, d, got[i]) for i, _, a, d in rows if got[i] != d]


def test_weights_of_sequences():
    rng = np.random.default_rng(3)
    x = [np.eye(3)[rng.integers(0, 3, n)] for n in (3, 4, 5) * 5]
    f, g = features(x), features(x + x[:4])
    y = f.dense.argmax(1)
    wrong = (g.dense.argmax(1) + 1) % 3
    wrong[: len(y)] = y
    a = crf.train(f, y, 3, 4)
    b = crf.train_batches([crf.Batch(g, wrong, np.r_[np.ones(len(x)), np.zeros(4)])], 3, 4, 80)
    assert np.allclose(a.dense, b.dense) and np.allclose(a.step, b.step) and np.allclose(a.start, b.start)


def test_fit_reads_every_row(spark):
    """Each of 5,000 answers has a word of its own; all are counted (F7: about 4,800 were drawn)."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3)) + "que"
    rows = [(str(i), f"How is part {i} of the service handled by the team?", f"{SOUND[0]} The {name(i)} office checks the copies each week and reports to the client.") for i in range(5000)]
    tagger = A.fit(spark.createDataFrame(rows, "id string, question string, answer string"))
    assert {name(i) for i in range(5000)} <= tagger.ends.known
