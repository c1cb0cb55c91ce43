"""Languages of documents and of their passages.

Every language has a codeword of bits. For each bit a binary classifier over character n-grams
(log odds of hashed n-grams, averaged over a text and fitted by logistic regression) says which
side a text is on. The language whose codeword loses least, each bit weighted by how reliable it
was in training, is chosen. Odds follow from the losses, made sharper with the length of a text;
how much is fitted on held-out passages, cut to various lengths and mixed, so that confidence
follows accuracy and a near second makes the choice ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.session import spread

#: Documents of each language that the classifiers are fitted on, at most (in expectation).
SAMPLE_PER_LANGUAGE = 300
N_BITS = 15
DIM = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Tokens whose scores a worker remembers.
CACHE = 200_000
#: A passage differs from its document's main language only if its confidence reaches this.
SURE = 0.6
#: A choice is ambiguous if the second language's odds come so near to the first one's.
AMBIGUOUS = 0.3
#: Every so many-th sampled document is held out to calibrate; words of the pieces made of it.
HELD_OUT, PIECES = 5, (1, 2, 3, 5, 8, 15, 30)
#: Weight of a piece of mixed words in calibration.
MIXED_WEIGHT = 0.1
BLANK_LINES = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def codewords(n: int, bits: int = N_BITS, seed: int = 7) -> np.ndarray:
    """n x bits of +1/-1: of many draws of balanced columns, the one with the largest least distance."""
    rng = np.random.default_rng(seed)
    half = np.where(np.arange(n) < (n + 1) // 2, 1, -1)
    best, best_key = None, (-1, -1.0)
    for _ in range(400):
        code = np.stack([rng.permutation(half) for _ in range(bits)], axis=1)
        far = (code[:, None, :] != code[None, :, :]).sum(-1)[np.triu_indices(n, 1)] if n > 1 else np.array([bits])
        if (key := (int(far.min()), float(far.mean()))) > best_key:
            best, best_key = code, key
    return best


def ngrams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the letters of tokens, words padded with blanks, and the token each is of, in order."""
    found = [LETTERS.findall(t.lower()) for t in tokens]
    words = [w for ws in found for w in ws]
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    token = np.repeat(np.arange(len(tokens)), [len(ws) for ws in found])[word]
    rolling, grams, owner = np.zeros(len(codes), dtype=np.uint64), [], []
    for order in range(1, max(ORDERS) + 1):
        rolling = rolling[: len(codes) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[order - 1 :] + np.uint64(1)
        if order in ORDERS:
            inside = word[: len(rolling)] == word[order - 1 :]
            mixed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            grams.append(((mixed >> np.uint64(40)) % np.uint64(DIM)).astype(np.int64)[inside]), owner.append(token[: len(rolling)][inside])
    owner_at = np.concatenate(owner)
    order = np.argsort(owner_at, kind="stable")
    return np.concatenate(grams)[order], owner_at[order]


def gram_sums(tokens: list[str], weights: np.ndarray) -> np.ndarray:
    """For each token the sum of its n-grams' weights and, last, their number."""
    grams, owner = ngrams(tokens)
    out = np.zeros((len(tokens), weights.shape[1] + 1), dtype=np.float32)
    if len(grams):
        there, first = np.unique(owner, return_index=True)
        out[there, :-1] = np.add.reduceat(weights[grams], first, axis=0)
        out[:, -1] = np.bincount(owner, minlength=len(tokens))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray  # of bits
    sharp: tuple[float, float] = (0.0, 0.0)  # of odds: logarithm of the factor, and power of the number of n-grams

    def losses(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        margin = scores / np.maximum(counts, 1)[:, None] * self.slope + self.offset
        wrong = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :])
        return (wrong * self.trust).sum(-1)

    def decode(self, scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1 without letters) and odds of all languages (0 then) of every text."""
        loss = self.losses(scores, counts)
        odds = _odds(loss, counts, *self.sharp)
        best = loss.argmin(1)
        best[counts == 0], odds[counts == 0] = -1, 0.0
        return best, odds


def _odds(loss: np.ndarray, counts: np.ndarray, factor: float, power: float) -> np.ndarray:
    z = (loss.min(1, keepdims=True) - loss) * (np.exp(factor) * np.maximum(counts, 1)[:, None] ** power)
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def ambiguous(odds: np.ndarray) -> np.ndarray:
    """Is the second of a row's odds near to the first?"""
    top = np.sort(odds, axis=1)
    return top[:, -1] - (top[:, -2] if odds.shape[1] > 1 else 0.0) < AMBIGUOUS


class Scorer:
    """Sums of n-gram weights of texts, by remembered whitespace-separated tokens."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights, {}
        self.table = np.zeros((1024, weights.shape[1] + 1), dtype=np.float32)

    def _learn(self, tokens: list[str]) -> None:
        if len(self.known) + len(tokens) > CACHE:
            self.known = {}
        need = len(self.known) + len(tokens)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.table.shape[1]), dtype=np.float32)])
        at = len(self.known)
        self.table[at:need] = gram_sums(tokens, self.weights)
        self.known.update(zip(tokens, range(at, need)))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [t.split() for t in texts]
        every = set().union(*tokens) if tokens else set()
        new = sorted(every - self.known.keys())
        if new:
            if len(self.known) + len(new) > CACHE:
                new, self.known = sorted(every), {}
            self._learn(new)
        lengths = np.array([len(t) for t in tokens])
        out = np.zeros((len(texts), self.table.shape[1]), dtype=np.float64)
        if lengths.sum():
            index = np.fromiter((i for t in tokens for i in map(self.known.__getitem__, t)), dtype=np.int64, count=int(lengths.sum()))
            some = np.flatnonzero(lengths)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[some]
            out[some] = np.add.reduceat(self.table[index], starts, axis=0)
        return out[:, :-1], out[:, -1]


def passages(text: str) -> list[str]:
    """Blocks between blank lines, without blank ones."""
    return [b for b in BLANK_LINES.split(text.replace("\r\n", "\n").replace("\r", "\n")) if b.strip()]


def fit(sample: list[tuple[str, str]], languages: list[str], rounds: int = 2) -> LanguageModel:
    """Fit the bit classifiers on (text, language) rows whose labels may be partly wrong.

    After the first fit, passages that the model puts elsewhere are left out and it is fitted anew.
    A language without rows keeps its codeword and is chosen only by its bits. Every HELD_OUT-th row
    serves to calibrate the odds only.
    """
    at = {lang: i for i, lang in enumerate(languages)}
    rows = [(text, at[lang]) for text, lang in sample if text and lang in at]
    blocks = [(b, lang) for k, (text, lang) in enumerate(rows) if k % HELD_OUT for b in passages(text)]
    code = codewords(len(languages))
    label = np.array([lang for _, lang in blocks], dtype=np.int64)
    tokens = sorted(set().union(*(b.split() for b, _ in blocks))) if blocks else []
    flat, owner = ngrams(tokens)
    of = dict(zip(tokens, np.split(flat, np.searchsorted(owner, np.arange(1, len(tokens))))))
    grams = [np.concatenate([of[t] for t in b.split()] or [np.empty(0, np.int64)]) for b, _ in blocks]
    use = np.array([len(g) > 0 for g in grams], dtype=bool)
    model = None
    for _ in range(max(1, rounds)):
        per_lang = np.zeros((len(languages), DIM))
        for g, lang, ok in zip(grams, label, use):
            if ok:
                per_lang[lang] += np.bincount(g, minlength=DIM)
        rate = per_lang / np.maximum(per_lang.sum(1, keepdims=True), 1) * 1e5
        weights = np.zeros((DIM, code.shape[1]), dtype=np.float32)
        for bit in range(code.shape[1]):
            up, down = rate[code[:, bit] > 0].mean(0), rate[code[:, bit] < 0].mean(0)
            weights[:, bit] = np.clip(np.log((up + 0.5) / (down + 0.5)), -4, 4)
        x = np.stack([weights[g].mean(0) if len(g) else np.zeros(code.shape[1]) for g in grams]) if grams else np.zeros((0, code.shape[1]))
        slope, offset, trust = _logistic(x[use], code[label[use]]) if use.any() else (np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]))
        model = LanguageModel(languages, code, weights, slope, offset, trust)
        if len(x):
            counts = np.array([len(g) for g in grams])
            best, _ = model.decode(x * counts[:, None], counts)
            use = (best == label) & (counts > 0)
    held = [(b, lang) for k, (text, lang) in enumerate(rows) if k % HELD_OUT == 0 for b in passages(text)]
    model.sharp = _calibrated(model, held)
    return model


def _calibrated(model: LanguageModel, held: list[tuple[str, int]], seed: int = 5) -> tuple[float, float]:
    """Factor and power of the odds that make held-out pieces likeliest.

    Pieces are some words of a passage that the model gives the language of its label, alone or
    with words of another language; of those each language is right in proportion to its n-grams.
    """
    rng = np.random.default_rng(seed)
    scorer = Scorer(model.weights)
    best, _ = model.decode(*scorer.score([b for b, _ in held])) if held else (np.empty(0), None)
    sound = [(b.split(), lang) for (b, lang), k in zip(held, best) if k == lang]
    if len(sound) < 20:
        return 0.0, 0.0

    def some(n: int) -> tuple[str, int]:
        tokens, lang = sound[rng.integers(len(sound))]
        at = rng.integers(max(1, len(tokens) - n + 1))
        return " ".join(tokens[at : at + n]), lang

    parts = [[some(n)] for n in PIECES for _ in range(150)]
    parts += [[some(max(1, round(n * share))), some(max(1, round(n * (1 - share))))] for n in (4, 8, 15, 30, 60) for share in (0.3, 0.5) for _ in range(60)]
    flat = [p for part in parts for p in part]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    scores, counts = scorer.score([t for t, _ in flat])
    whole, size = np.zeros((len(parts), scores.shape[1])), np.zeros(len(parts))
    np.add.at(whole, owner, scores), np.add.at(size, owner, counts)
    right = np.zeros((len(parts), len(model.languages)))
    np.add.at(right, (owner, np.array([lang for _, lang in flat])), counts)
    whole, size, right = whole[size > 0], size[size > 0], right[size > 0]
    right /= right.sum(1, keepdims=True)
    loss = model.losses(whole, size)
    weight = np.where(right.max(1) < 1, MIXED_WEIGHT, 1.0)
    missed = lambda f, p: -((right * np.log(_odds(loss, size, f, p) + 1e-9)).sum(1) * weight).sum()
    return min(_grid(), key=lambda x: missed(*x))


def _grid() -> list[tuple[float, float]]:
    return [(f, p) for f in np.arange(-5, 3.01, 0.25) for p in np.arange(0, 1.01, 0.1)]


#: Bins that means of n-gram weights (at most 4 either way) are counted in.
BINS = 1024


def bins(x: np.ndarray) -> np.ndarray:
    return np.clip(((x + 4) * (BINS / 8)).astype(np.int64), 0, BINS - 1)


def bit_weights(rate: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log odds of n-grams for each bit, from their frequencies (languages x n-grams)."""
    rate = rate / np.maximum(rate.sum(1, keepdims=True), 1) * 1e5
    up, down = (np.stack([rate[code[:, bit] == side].mean(0) for bit in range(code.shape[1])], axis=1) for side in (1, -1))
    return np.clip(np.log((up + 0.5) / (down + 0.5)), -4, 4).astype(np.float32)


def logistic_of_counts(counts: np.ndarray, code: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_logistic`` of texts counted by language, bit and bin of ``bins``; counts may be weights."""
    centre = ((np.arange(BINS) + 0.5) * (8 / BINS) - 4)[:, None]
    up, down = ((counts * (code == side)[:, :, None]).sum(0).T for side in (1, -1))  # bins x bits
    total = np.maximum((up + down).sum(0), 1e-9)
    scale = np.maximum((np.abs(centre) * (up + down)).sum(0) / total, 1e-6)
    z, slope, offset = centre / scale, np.ones(code.shape[1]), np.zeros(code.shape[1])
    for step in range(steps):
        odds = 1 / (1 + np.exp(-np.clip(z * slope + offset, -30, 30)))
        g = (down * odds - up * (1 - odds)) / total
        rate = 1.0 / (1 + step / 100)
        slope -= rate * ((g * z).sum(0) + 1e-4 * slope)
        offset -= rate * g.sum(0)
    slope = np.maximum(slope, 0.1)
    side = z * slope + offset > 0
    right = (up * side + down * ~side).sum(0) / total
    return slope / scale, offset, np.clip(2 * right - 1, 0.05, 1.0)


def misses(model: LanguageModel, scores: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of pieces the improbability of what is right (n-grams of each language in them) under all odds of ``_grid``."""
    size = right.sum(1)
    share, loss = right / size[:, None], model.losses(scores, size)
    weight = np.where(share.max(1) < 1, MIXED_WEIGHT, 1.0)
    return np.stack([-(share * np.log(_odds(loss, size, f, p) + 1e-9)).sum(1) * weight for f, p in _grid()], axis=1)


def best_sharp(missed: np.ndarray) -> tuple[float, float]:
    return _grid()[int(missed.argmin())]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope and offset of each bit by gradient steps, and its weight: how much better than chance it is."""
    scale = np.maximum(np.abs(x).mean(0), 1e-6)
    z, slope, offset = x / scale, np.ones(x.shape[1]), np.zeros(x.shape[1])
    for step in range(steps):
        g = -y / (1 + np.exp(np.clip(y * (z * slope + offset), -30, 30)))
        rate = 1.0 / (1 + step / 100)
        slope -= rate * ((g * z).mean(0) + 1e-4 * slope)
        offset -= rate * g.mean(0)
    slope = np.maximum(slope, 0.1)
    right = (np.sign(z * slope + offset) == y).mean(0)
    return slope / scale, offset, np.clip(2 * right - 1, 0.05, 1.0)


def label_code(label: Column, codes: list[tuple[str, str, str]]) -> Column:
    """The code a label names: two or three letters, with or without a region, or an English name; else null."""
    clean = F.lower(F.regexp_replace(label, r"\A\s+|\s+\z", ""))
    names = {k.lower(): code for code, code3, name in codes for k in (name, code3, code) if k}
    lookup = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(lookup[clean], lookup[F.regexp_extract(clean, r"\A([a-z]{2,3})[-_][a-z0-9]{2,4}\z", 1)])


def sample_labelled(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """About ``per_language`` documents of each label, chosen by hash; at most twice as many are kept."""
    known = docs.where("code IS NOT NULL AND text IS NOT NULL AND length(text) <= 20000")
    counts = {r["code"]: r["n"] for r in known.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(v) for code, n in counts.items() for v in (code, min(1.0, per_language / n))])
    u = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = known.where(u < share[F.col("code")]).select("text", "code").limit(2 * per_language * len(counts)).collect()
    return [(r["text"], r["code"]) for r in rows]


SCHEMA = "doc_id {kind}, seg_no int, lang string, confidence double, share double, ambiguous boolean, n_segments int, mixed boolean, label_code string"
#: Characters whose passages are scored at once.
AT_ONCE = 2_000_000


def _assign(model_of):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: LanguageModel = model_of.value
        scorer = Scorer(model.weights)  # its memory of tokens lasts for the task
        for batch in batches:
            ends = np.cumsum(batch["text"].str.len().to_numpy()) // AT_ONCE
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(ends)) + 1):
                rows = batch.iloc[part]
                own = [passages(text) for text in rows["text"]]
                blocks = [b for bs in own for b in bs]
                if blocks:
                    found = _documents(model, scorer, np.repeat(np.arange(len(own)), [len(bs) for bs in own]), blocks)
                    at = found.pop("row").to_numpy()
                    yield found.assign(doc_id=rows["doc_id"].to_numpy()[at], label_code=rows["code"].to_numpy(dtype=object)[at])

    return run


def _documents(model: LanguageModel, scorer: Scorer, owner: np.ndarray, blocks: list[str]) -> pd.DataFrame:
    """Rows of all documents and of the passages of mixed ones; ``owner`` are the rows that the blocks are of, in order."""
    scores, counts = scorer.score(blocks)
    best, odds = model.decode(scores, counts)
    sure = odds.max(1)
    chars = np.array([len(b) for b in blocks], dtype=np.float64)
    docs, first = np.unique(owner, return_index=True)
    pos = np.searchsorted(docs, owner)
    # text of each document in each language; unsure passages count less
    mass = np.zeros((len(docs), len(model.languages)))
    ok = best >= 0
    np.add.at(mass, (pos[ok], best[ok]), chars[ok] * np.maximum(sure[ok], 1e-3))
    main = mass.argmax(1)
    has = mass.sum(1) > 0
    # a passage of another language must be sure of it
    lang = np.where((best >= 0) & ((best == main[pos]) | (sure >= SURE)), best, main[pos])
    mixed = np.zeros(len(docs), dtype=bool)
    np.logical_or.at(mixed, pos, lang != main[pos])
    # recount with settled passages: most of the text decides
    mass[:] = 0
    np.add.at(mass, (pos, lang), chars)
    main = mass.argmax(1)
    share = mass.max(1) / np.maximum(mass.sum(1), 1)
    # an unmixed document is judged whole, a mixed one by its passages of the main language
    _, whole = model.decode(np.add.reduceat(scores, first, axis=0), np.add.reduceat(counts, first))
    own = odds[np.arange(len(lang)), lang]
    inside = np.where(lang == main[pos], chars, 0.0)
    mean = np.bincount(pos, inside * own) / np.maximum(np.bincount(pos, inside), 1)
    near = np.bincount(pos, inside * ambiguous(odds)) * 2 > np.bincount(pos, inside)
    confidence = np.where(mixed, mean, whole[np.arange(len(main)), main])
    names, n_seg = np.array(model.languages, dtype=object), np.bincount(pos)
    zero = pd.DataFrame({"row": docs, "seg_no": 0, "lang": names[main], "confidence": confidence, "share": share, "ambiguous": np.where(mixed, near, ambiguous(whole)), "n_segments": n_seg, "mixed": mixed})[has]
    keep = mixed[pos]
    segs = pd.DataFrame({"row": owner[keep], "seg_no": (np.arange(len(owner)) - first[pos] + 1)[keep], "lang": names[lang[keep]], "confidence": own[keep], "share": (chars / np.maximum(np.bincount(pos, chars), 1)[pos])[keep], "ambiguous": ambiguous(odds)[keep], "n_segments": n_seg[pos][keep], "mixed": True})
    return pd.concat([zero, segs], ignore_index=True)


def languages(docs: DataFrame, lang_codes: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Language of each document (seg_no 0) and of each passage of a mixed one (seg_no 1, 2, ...).

    ``docs`` has doc_id, text, lang; ``lang_codes`` code, code3, name_en (a handful of rows). The
    classifiers are fitted on about ``per_language`` labelled documents of each language; all
    documents are then classified whole. Returns doc_id, seg_no, lang, confidence (0 to 1, the odds
    of the language), share (of the document's text), ambiguous (another language is nearly as
    likely), n_segments, mixed, label_code (what the label names, or null). Documents without a
    letter give no row; a passage without letters, or unsure of another language, has the main
    language of its document. Repeated doc_ids are classified as often as they occur. Without any
    labelled document nothing can be learned and the result is empty.
    """
    codes = sorted({(r["code"], r["code3"], r["name_en"]) for r in lang_codes.select("code", "code3", "name_en").where("code IS NOT NULL").collect()})
    rows = docs.select("doc_id", "text", label_code(F.col("lang"), codes).alias("code") if codes else F.lit(None).cast("string").alias("code"))
    sample = sample_labelled(rows, per_language) if codes else []
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(kind=kind)
    spark = docs.sparkSession
    if not sample:
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(fit(sample, [c for c, _, _ in codes]))
    columns = [f.split()[0] for f in schema.split(", ")]
    return spread(rows.where(F.trim("text") != "")).select("doc_id", "text", "code").mapInPandas(_assign(model), schema).select(*columns)


def found(classified: DataFrame) -> DataFrame:
    """Main language where the label is missing or wrong, and every passage of mixed documents."""
    wrong = F.col("label_code").isNull() | (F.col("label_code") != F.col("lang"))
    return classified.where(F.when(F.col("seg_no") == 0, wrong).otherwise(F.col("mixed"))).select("doc_id", "seg_no", "lang")
