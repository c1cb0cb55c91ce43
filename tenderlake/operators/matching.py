"""Evidence for requirements and themes by shared content words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import lexicon as lex
from tenderlake.functions import text as T
from tenderlake.session import stage


#: Different word sets of requirements, and proofs, that are compared at once.
ASKED_BLOCK, PROOF_BLOCK = 16384, 4096


def _best_in_block(top: int):
    """For each asked word set the proofs of one block that may be among its ``top`` best."""

    def run(asked: pd.DataFrame, proofs: pd.DataFrame) -> pd.DataFrame:
        proofs = proofs.sort_values("proof_id", na_position="first", kind="stable")
        ids, own = proofs["proof_id"].to_numpy(), proofs["own"].to_numpy()
        sizes = proofs["words"].map(len).to_numpy()
        found = []
        if len(asked) and sizes.sum():
            at, word, mark = np.repeat(np.arange(len(ids)), sizes), np.concatenate(list(proofs["words"])), np.concatenate(list(proofs["marks"])).astype(np.float64)
            order = np.argsort(word, kind="stable")
            at, word, mark = at[order], word[order], mark[order]
            names, first = np.unique(word, return_index=True)
            last = np.append(first[1:], len(word))
            for cid, h in zip(asked["cid"], asked["words"]):
                n = len(h)
                where = np.searchsorted(names, h)
                spans = [np.arange(first[w], last[w]) for w, x in zip(where, h) if w < len(names) and names[w] == x]
                if not spans:
                    continue
                rows = np.concatenate(spans)
                sums = np.bincount(at[rows], mark[rows]).astype(np.int64)
                pick = np.flatnonzero((sums & 0xFFFF) >= lex.MIN_SHARED_TOKENS)
                a, b = (sums[pick] >> 16) & 0xFFFF, sums[pick] >> 32
                fit = 3 * a + 2 * b  # the score is fit / 5n; rounding may join scores of more than 2,000 words
                if len(pick) > top:
                    slack = 0 if n < 2000 else int(5e-4 * n) + 1
                    keep = fit >= -np.partition(-fit, top - 1)[top - 1] - slack
                    pick, a, b = pick[keep], a[keep], b[keep]
                kinds = a << 16 | b
                for kind in np.unique(kinds):
                    found += [(cid, n, ids[k], int(own[k]), int(kind >> 16), int(kind & 0xFFFF)) for k in pick[kinds == kind][:top]]
        return pd.DataFrame(found, columns=["cid", "n", "proof_id", "own", "a", "b"])

    return run


def match_proofs(requirements: DataFrame, proofs: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """(keys, fit, proof_ids, best_score): the best proofs of each requirement.

    The score is 0.6 x the share of the requirement's words in the proof's text plus 0.4 x their
    share in its tags; two shared words are needed. Equal word sets are matched once, in blocks
    of them against blocks of proofs, each of which counts shared words over its own postings and
    returns the few best. Ties go to the lesser proof id. A match is strong only if the
    best proof's own ``strength`` is (unknown ones count as medium).
    """
    words = F.array_sort(T.content_tokens(F.col("text"), lex.PROOF_STOPWORDS))
    named = stage(requirements.select(*keys, words.alias("w")).select(*keys, "w", F.md5(F.array_join("w", " ")).alias("cid")), "asked")
    text = F.concat_ws(" ", "claim", "evidence", "verifiable_source")
    tags = F.replace(F.array_join(F.coalesce("covers_tags", F.array().cast("array<string>")), " "), F.lit("-"), F.lit(" "))
    ranks = F.create_map(*[F.lit(v) for pair in lex.LIBRARY_STRENGTH.items() for v in pair])
    own = F.coalesce(ranks[F.upper(F.trim("strength"))], F.lit(1)).alias("own")
    p = proofs.select(F.col("id").alias("proof_id"), own, T.content_tokens(text, lex.PROOF_STOPWORDS).alias("pt"), T.content_tokens(tags, lex.PROOF_STOPWORDS).alias("tt"))
    mark = lambda w: F.lit(1).cast("bigint") + F.array_contains("pt", w).cast("bigint") * (1 << 16) + F.array_contains("tt", w).cast("bigint") * (1 << 32)
    p = p.withColumn("w", F.array_union("pt", "tt")).select("proof_id", "own", F.transform("w", lambda w: F.xxhash64(w)).alias("words"), F.transform("w", mark).alias("marks"))
    p = stage(p, "proofs")
    asked = stage(named.where("size(w) > 0").groupBy("cid").agg(F.first(F.transform("w", lambda w: F.xxhash64(w))).alias("words")), "wordsets")
    n_r, n_p = max(1, -(-asked.count() // ASKED_BLOCK)), max(1, -(-p.count() // PROOF_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("rb", F.pmod(F.xxhash64("cid"), F.lit(n_r)).cast("int")).withColumn("pb", every(n_p))
    p = p.withColumn("pb", F.pmod(F.xxhash64("proof_id"), F.lit(n_p)).cast("int")).withColumn("rb", every(n_r))
    pairs = asked.groupBy("rb", "pb").cogroup(p.groupBy("rb", "pb")).applyInPandas(_best_in_block(top), "cid string, n int, proof_id string, own int, a bigint, b bigint")
    scored = pairs.withColumn("score", F.round(0.6 * F.col("a") / F.col("n") + 0.4 * F.col("b") / F.col("n"), 4))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "proof_id"))).where((F.col("rank") <= top) & (F.col("score") >= lex.PARTIAL_FLOOR))
    best = ranked.groupBy("cid").agg(F.max("score").alias("best_score"), F.min_by("own", "rank").alias("own"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "proof_id"))), lambda x: x["proof_id"]).alias("proof_ids"))
    fit = F.when(F.col("best_score").isNull(), "GAP").when((F.col("best_score") >= lex.STRONG_FLOOR) & (F.col("own") >= 2), "STRONG").otherwise("PARTIAL")
    return named.select(*keys, "cid").join(best, "cid", "left").select(*keys, fit.alias("fit"), F.coalesce("proof_ids", F.array().cast("array<string>")).alias("proof_ids"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))


def theme_threads(themes: DataFrame, requirements: DataFrame, scope: list[str], floor: float = lex.THREAD_FLOOR) -> DataFrame:
    """(scope, theme_id, n_words, n_threads): requirements of the same scope that share enough of a theme's words."""
    t = themes.select(*scope, F.col("id").alias("theme_id"), T.content_tokens(F.concat_ws(" ", "statement", "buyer_pain_addressed"), lex.THEME_STOPWORDS).alias("w"))
    r = requirements.select(*scope, F.col("id").alias("req_id"), F.explode(T.content_tokens(F.col("text"), lex.THEME_STOPWORDS)).alias("word"))
    hits = t.select(*scope, "theme_id", F.size("w").alias("n_words"), F.explode("w").alias("word")).join(r, [*scope, "word"]).groupBy(*scope, "theme_id", "n_words", "req_id").agg(F.count(F.lit(1)).alias("shared"))
    n = hits.where(F.col("shared") / F.col("n_words") >= floor).groupBy(*scope, "theme_id").agg(F.count(F.lit(1)).alias("n_threads"))
    return t.select(*scope, "theme_id", F.size("w").alias("n_words")).join(n, [*scope, "theme_id"], "left").na.fill(0, ["n_threads"])


def _first_in_block(top: int, floor: float):
    """For each word set of themes the first ``top`` proofs of one block that have enough of its words."""

    def run(themes: pd.DataFrame, proofs: pd.DataFrame) -> pd.DataFrame:
        proofs = proofs.sort_values("proof_id", na_position="first", kind="stable")
        ids, sizes = proofs["proof_id"].to_numpy(), proofs["words"].map(len).to_numpy()
        found = []
        if len(themes) and sizes.sum():
            at, word = np.repeat(np.arange(len(ids)), sizes), np.concatenate(list(proofs["words"]))
            order = np.argsort(word, kind="stable")
            at, word = at[order], word[order]
            for cid, h in zip(themes["cid"], themes["words"]):
                low, high = np.searchsorted(word, h, "left"), np.searchsorted(word, h, "right")
                rows = np.concatenate([at[a:b] for a, b in zip(low, high)])
                pick = np.flatnonzero(np.bincount(rows, minlength=len(ids)) / len(h) >= floor)[:top] if len(rows) else []
                found += [(cid, ids[k]) for k in pick]
        return pd.DataFrame(found, columns=["cid", "proof_id"])

    return run


def supporting_proofs(themes: DataFrame, proofs: DataFrame, keys: list[str], top: int = lex.MAX_SUPPORTING, floor: float = lex.THREAD_FLOOR) -> DataFrame:
    """(keys, proof_ids): the first proofs, by id, that have at least ``floor`` of a theme's words in their text or tags.

    Equal word sets are matched once, in blocks of them against blocks of proofs; each pair of
    blocks returns at most ``top`` proofs of a set.
    """
    words = F.array_sort(T.content_tokens(F.concat_ws(" ", "statement", "buyer_pain_addressed"), lex.THEME_STOPWORDS))
    named = stage(themes.select(*keys, words.alias("w")).select(*keys, "w", F.md5(F.array_join("w", " ")).alias("cid")), "themes")
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x)).alias("words")
    asked = stage(named.where("size(w) > 0").groupBy("cid").agg(F.first(hashed("w")).alias("words")), "wordsets")
    tags = F.array_join(F.coalesce("covers_tags", F.array().cast("array<string>")), " ")
    text = F.concat_ws(" ", "claim", "evidence", "verifiable_source", tags)
    p = stage(proofs.select(F.col("id").alias("proof_id"), hashed(T.content_tokens(text, lex.THEME_STOPWORDS))), "proofs")
    n_t, n_p = max(1, -(-asked.count() // ASKED_BLOCK)), max(1, -(-p.count() // PROOF_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("tb", F.pmod(F.xxhash64("cid"), F.lit(n_t)).cast("int")).withColumn("pb", every(n_p))
    p = p.withColumn("pb", F.pmod(F.xxhash64("proof_id"), F.lit(n_p)).cast("int")).withColumn("tb", every(n_t))
    hits = asked.groupBy("tb", "pb").cogroup(p.groupBy("tb", "pb")).applyInPandas(_first_in_block(top, floor), "cid string, proof_id string")
    best = hits.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list("proof_id")), 1, top).alias("proof_ids"))  # at most top of each block of proofs
    return named.select(*keys, "cid").join(best, "cid", "left").select(*keys, F.coalesce("proof_ids", F.array().cast("array<string>")).alias("proof_ids"))


def theme_checks(themes: DataFrame, requirements: DataFrame, proofs: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, theme_id, n_threads, proof_ids, verdict): is a theme about the buyer, threaded and evidenced?

    The first fault counts: seller (speaks of the seller), empty (no content words), decorative
    (fewer than two requirements share a tenth of its words), unevidenced (no proof does); else kept.
    """
    keys = [*scope, "theme_id"]
    said = themes.select(*scope, F.col("id").alias("theme_id"), F.coalesce("statement", F.lit("")).alias("statement"), "buyer_pain_addressed")
    proved = supporting_proofs(said, proofs, keys)
    both = said.select(*keys, "statement").join(theme_threads(themes, requirements, scope), keys).join(proved, keys)
    verdict = (
        F.when(F.col("statement").rlike("(?i)" + lex.SELLER_SIDE), "seller")
        .when(F.col("n_words") == 0, "empty")
        .when(F.col("n_threads") < lex.MIN_THREADS, "decorative")
        .when(F.size("proof_ids") == 0, "unevidenced")
        .otherwise("kept")
    )
    return both.select(*keys, "n_threads", "proof_ids", verdict.alias("verdict"))


def matched_texts(labelled: DataFrame, found: DataFrame, scope: list[str], key: str, text: str) -> DataFrame:
    """(scope, key, first_match, best_match, similarity): for each labelled text the found ones that say the same.

    At least 0.45 of the words of both and 0.75 of those of the shorter one are shared. First goes
    by key; best by similarity, then key. Labelled texts without a match have nulls.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(T.normalize(F.coalesce(c, F.lit("")))), r"[^a-z0-9 ]+", " "), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(lex.COMPLIANCE_STOPWORDS)))
    a = labelled.select(*scope, F.col(key).alias(key), words(F.col(text)).alias("w"))
    b = found.select(*scope, F.col(key).alias("match"), words(F.col(text)).alias("w"))
    long_a = a.select(*scope, key, F.size("w").alias("n"), F.explode("w").alias("word"))
    long_b = b.select(*scope, "match", F.size("w").alias("m"), F.explode("w").alias("word"))
    shared = long_a.join(long_b, [*scope, "word"]).groupBy(*scope, key, "n", "match", "m").agg(F.count(F.lit(1)).alias("k"))
    similarity = F.col("k") / (F.col("n") + F.col("m") - F.col("k"))
    same = shared.withColumn("similarity", F.round(similarity, 6)).where((similarity >= lex.MATCH_SIMILARITY) & (F.col("k") / F.least("n", "m") >= lex.MATCH_CONTAINMENT))
    best = same.groupBy(*scope, key).agg(F.min("match").alias("first_match"), F.min(F.struct((-F.col("similarity")).alias("s"), "match")).alias("b"))
    return a.select(*scope, key).join(best, [*scope, key], "left").select(*scope, key, "first_match", F.col("b.match").alias("best_match"), (-F.col("b.s")).alias("similarity"))


def compliance(placed: DataFrame, requirements: DataFrame, sections: DataFrame) -> DataFrame:
    """(run_id, requirement_id, section_id, anchor, rag) of every requirement.

    ``placed`` has run_id, requirement_id, section_id (the least section counts if there are
    several); ``sections`` run_id, id, content_md of sections that are written. Without one the
    row is RED; with one it is GREEN if a paragraph has at least 0.30 of the requirement's words,
    else AMBER. The anchor names the first paragraph with the largest share.
    """
    where = placed.groupBy("run_id", "requirement_id").agg(F.min("section_id").alias("section_id"))
    r = requirements.select("run_id", F.col("id").alias("requirement_id"), T.content_tokens(F.col("text"), lex.COMPLIANCE_STOPWORDS).alias("w")).join(where, ["run_id", "requirement_id"], "left")
    paragraphs = sections.select("run_id", F.col("id").alias("section_id"), F.filter(F.split(F.coalesce("content_md", F.lit("")), "\n\n"), lambda p: T.strip(p) != "").alias("ps"))
    tokens = paragraphs.select("run_id", "section_id", F.transform("ps", lambda p: T.content_tokens(p, lex.COMPLIANCE_STOPWORDS)).alias("pw"))
    both = r.join(tokens, ["run_id", "section_id"], "left")
    shares = F.transform("pw", lambda p, i: F.struct(T.overlap_left(F.col("w"), p).alias("share"), (-i).alias("at")))
    both = both.withColumn("best", F.array_max(shares))
    hit = F.coalesce(F.col("best.share"), F.lit(0.0))
    written = F.col("pw").isNotNull()
    anchor = F.when(~written, None).when(hit > 0, F.concat("section_id", F.lit("#p"), (1 - F.col("best.at")).cast("string"))).otherwise(F.col("section_id"))
    rag = F.when(~written, "RED").when(hit >= lex.ADDRESSED_FLOOR, "GREEN").otherwise("AMBER")
    return both.select("run_id", "requirement_id", F.when(written, F.col("section_id")).alias("section_id"), anchor.alias("anchor"), rag.alias("rag"))


def best_section(text: Column, form: Column, kind: Column) -> Column:
    """Title of the narrative section that a requirement belongs to.

    Submission rules have their own. Else the section with the most different keywords counts,
    half a point going to the one that the form suggests, the earlier of equal ones; without any,
    the form's section or the last.
    """
    titles = [t for t, _, _ in lex.NARRATIVE_SPINE]
    affine = F.coalesce(*[F.when(form == f, F.lit(t)) for f, t in lex.FORM_AFFINITY.items()])
    scores = []
    for at, (title, _, words) in enumerate(lex.NARRATIVE_SPINE):
        if words:
            hits = F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:" + "|".join(words) + ")"), F.lit(0)), F.lower)))
            scores.append(F.struct((hits + F.when(F.coalesce(affine == title, F.lit(False)), 0.5).otherwise(0.0)).alias("score"), F.lit(-at).alias("at"), F.lit(title).alias("title")))
    best = F.array_max(F.array(*scores))
    return F.when(kind == "SUBMISSION_RULE", titles[-2]).when(best["score"] > 0, best["title"]).otherwise(F.coalesce(affine, F.lit(titles[-1])))


def narrative_outline(requirements: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, order_index, title, n_requirements, target_words): the sections of a narrative response that have requirements, and the summary."""
    spark = requirements.sparkSession
    spine = spark.createDataFrame([(i, t, w) for i, (t, w, _) in enumerate(lex.NARRATIVE_SPINE)], "at int, title string, least int")
    placed = requirements.select(*scope, best_section(F.coalesce("text", F.lit("")), F.col("deliverable_form"), F.col("req_type")).alias("title")).groupBy(*scope, "title").agg(F.count(F.lit(1)).alias("n_requirements"))
    summary = requirements.select(*scope).distinct().select(*scope, F.lit(lex.NARRATIVE_SPINE[0][0]).alias("title"), F.lit(0).cast("bigint").alias("n_requirements"))
    both = placed.unionByName(summary).join(F.broadcast(spine), "title")  # a dozen rows
    order = F.row_number().over(Window.partitionBy(*scope).orderBy("at")) - 1
    return both.select(*scope, order.alias("order_index"), "title", "n_requirements", F.greatest("least", 110 * F.col("n_requirements")).alias("target_words"))
