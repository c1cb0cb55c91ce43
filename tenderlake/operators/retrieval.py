"""Ranking: BM25 over postings, dense top-k in blocks, rank fusion, decisions and quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import lexicon as lex
from tenderlake.functions import text as T
from tenderlake.session import stage

#: Vectors of one block, on either side.
BLOCK = 512
#: The same where only counts of scores leave a pair of blocks.
PAIR_BLOCK = 2048
#: Documents and queries of one part of a search, and documents scored at once.
HEAVY, ASKED, STEP = 65_536, 8192, 16_384


def every_fiftieth(key: Column) -> Column:
    """The stated query set of searches: rows whose number is divisible by 50."""
    return F.regexp_extract(key.cast("string"), r"(\d+)\D*$", 1).try_cast("bigint") % 50 == 0


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, len, words) of every document: its tokens in one string, and their number."""
    toks = docs.select(key, T.tokenize(F.col(text)).alias("t"))
    return toks.select(key, F.size("t").alias("len"), F.array_join("t", " ").alias("words"))


def term_counts(post: DataFrame) -> DataFrame:
    """(term, df): documents of each term."""
    terms = post.where("len > 0").select(F.explode(F.array_distinct(F.split("words", " "))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _best(asked: DataFrame, post: DataFrame, query_key: str, key: str, depth: int, gain: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query key, key, total): the best documents of each query, ``depth`` of every part of the documents.

    ``asked`` are (query key, term, w); the total of a document is the sum of w times the ``gain`` of
    (tf, len), rounded to 6 digits. Totals of 0 or less do not count, ties go to the lesser key.
    Documents and queries are cut into parts by the hash of their keys. Each pair of parts keeps the
    best so far of each query while it goes through its documents, so pairs of queries and documents
    cost time, but are never written.
    """
    n = max(2 * post.sparkSession.sparkContext.defaultParallelism, -(-post.count() // HEAVY))
    m = max(1, -(-asked.select(query_key).distinct().count() // ASKED))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = post.where("len > 0").select(key, "len", "words", part(key, n).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    right = asked.select(query_key, "term", F.col("w").cast("double").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), part(query_key, m).alias("j"))

    def best(docs: pa.Table, asked: pa.Table) -> pa.Table:
        docs = docs.sort_by(key)  # so that the lesser row has the lesser key
        ids, terms = (asked[c].combine_chunks().dictionary_encode() for c in (query_key, "term"))
        order = np.argsort(ids.indices.to_numpy(), kind="stable")
        codes, weights = terms.indices.to_numpy()[order], asked["w"].to_numpy()[order]
        begin = np.searchsorted(ids.indices.to_numpy()[order], np.arange(len(ids.dictionary) + 1))
        none = np.array([], dtype=np.int64)
        kept, least = [(none, none)] * len(ids.dictionary), np.zeros(len(ids.dictionary), dtype=np.int64)
        for at in range(0, docs.num_rows if len(order) else 0, STEP):
            some = docs.slice(at, STEP)
            size, words = some.num_rows, pc.split_pattern(some["words"].combine_chunks(), " ")
            code = pc.index_in(words.flatten(), value_set=terms.dictionary).fill_null(-1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(size), some["len"].to_numpy())
            held, tf = np.unique(code[code >= 0] * size + row[code >= 0], return_counts=True)
            row, first = held % size, np.searchsorted(held, np.arange(len(terms.dictionary) + 1) * size)
            gains, dense = gain(tf, some["len"].to_numpy()[row]), {}
            for q in range(len(kept)):
                total = np.zeros(size)
                for c, w in zip(codes[begin[q] : begin[q + 1]], weights[begin[q] : begin[q + 1]]):
                    lo, hi = first[c], first[c + 1]
                    if (hi - lo) * 8 > size:  # most documents have few of these terms: whole rows add faster
                        if c not in dense:
                            dense[c] = np.zeros(size)
                            dense[c][row[lo:hi]] = gains[lo:hi]
                        total += w * dense[c]
                    elif hi > lo:
                        total[row[lo:hi]] += w * gains[lo:hi]
                found = np.flatnonzero(total > (least[q] + 0.4) / 1e6)
                micro = np.floor(total[found] * 1e6 + 0.5).astype(np.int64)
                found, micro = found[micro > least[q]], micro[micro > least[q]]
                if not len(found):
                    continue
                micro, found = np.concatenate([kept[q][0], micro]), np.concatenate([kept[q][1], at + found])
                if len(micro) >= depth:
                    least[q] = np.partition(micro, len(micro) - depth)[len(micro) - depth]
                    more = micro > least[q]
                    more[np.flatnonzero(micro == least[q])[: depth - np.count_nonzero(more)]] = True
                    micro, found = micro[more], found[more]
                kept[q] = micro, found
        q = np.repeat(np.arange(len(kept)), np.array([len(micro) for micro, _ in kept], dtype=np.int64))
        micro, found = (np.concatenate([none, *(k[i] for k in kept)]) for i in (0, 1))
        return pa.table({query_key: ids.dictionary.take(pa.array(q)), key: docs[key].take(pa.array(found)), "total": pa.array(micro / 1e6)})

    types = dict(asked.dtypes) | dict(post.dtypes)
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, f"{query_key} {types[query_key]}, {key} {types[key]}, total double")


def bm25(post: DataFrame, counts: DataFrame, n_docs: int, key: str, queries: DataFrame, query_key: str, query_text: str, depth: int = lex.RANK_DEPTH, k1: float = lex.BM25_K1, b: float = lex.BM25_B, epsilon: float = lex.BM25_EPSILON) -> DataFrame:
    """(query key, key, score, rank) of the ``depth`` best documents with a positive score.

    ``post`` are the ``postings`` of ``n_docs`` documents, ``counts`` their ``term_counts``, both
    written before. Inverse document frequency is ln(N - n + 0.5) - ln(n + 0.5); negative values
    become ``epsilon`` times the mean. Query terms count as often as they occur. Ties go to the
    lesser key.
    """
    idf = counts.select("term", (F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    floor = epsilon * (idf.agg(F.avg("idf")).first()[0] or 0.0)
    avg_len = max((post.agg(F.sum("len")).first()[0] or 0) / max(n_docs, 1), 1e-9)
    terms = queries.select(query_key, F.explode(T.tokenize(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighted = terms.join(idf, "term").select(query_key, "term", (F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")) * F.col("qtf")).alias("w"))
    gain = lambda tf, n: tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / avg_len))
    scored = _best(weighted, post, query_key, key, depth, gain).withColumnRenamed("total", "score")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def word_share(post: DataFrame, counts: DataFrame, key: str, queries: DataFrame, query_key: str, query_text: str, depth: int = lex.RANK_DEPTH) -> DataFrame:
    """(query key, key, score, rank): documents by the share of the query's content words they have."""
    words = queries.select(query_key, T.content_tokens(F.col(query_text), lex.QUERY_STOPWORDS).alias("w")).where("size(w) > 0")
    asked = words.select(query_key, F.explode("w").alias("term"), F.lit(1.0).alias("w")).join(counts.select("term"), "term")
    scored = _best(asked, post, query_key, key, depth, lambda tf, n: np.ones(len(tf))).join(words.select(query_key, F.size("w").alias("n_words")), query_key)
    scored = scored.select(query_key, key, F.round(F.col("total") / F.col("n_words"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))).where(F.col("rank") <= depth)


def reranked(ranked: DataFrame, queries: DataFrame, docs: DataFrame, query_key: str, key: str, query_text: str, text: str, top: int = lex.TOP_K) -> DataFrame:
    """(query key, key, score, rank): the ``top`` of a ranking by the share of words that query and document have in common.

    Stands where a cross-encoder would; ties go to the better rank before.
    """
    words = lambda c: T.content_tokens(F.col(c), lex.QUERY_STOPWORDS)
    asked = queries.select(query_key, words(query_text).alias("qw"))
    held = docs.join(ranked.select(key).distinct(), key, "left_semi").select(key, words(text).alias("dw"))
    scored = ranked.select(query_key, key, F.col("rank").alias("before")).join(asked, query_key).join(held, key).withColumn("score", F.round(T.jaccard("qw", "dw"), 6))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), "before")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(query_key, key, "score", "rank")


def _blocks(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Rows gathered in blocks of about BLOCK, by the hash of their key."""
    n = max(1, -(-df.count() // BLOCK))
    keyed = df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name))
    return keyed.groupBy(name).agg(F.collect_list(F.struct("k", "v")).alias(f"{name}_rows"))


def dense_top(vectors: DataFrame, key: str, vector: str, queries: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, key, score, rank): for each query vector the nearest others by inner product.

    Exact. Queries and vectors are cut into blocks; each pair of blocks is one matrix product that
    keeps ``depth`` rows a query, and the best of all blocks are ranked. Ties go to the lesser key.
    """
    queries = stage(queries.select(key, vector), "queries")
    n = max(1, -(-queries.count() // BLOCK))
    q, d = _blocks(queries, key, vector, "qb"), _blocks(vectors, key, vector, "db")
    spread = d.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right in zip(batch["qb_rows"], batch["db_rows"]):
                a, b = np.array([r["v"] for r in left], dtype=np.float64), np.array([r["v"] for r in right], dtype=np.float64)
                ka, kb = np.array([r["k"] for r in left]), np.array([r["k"] for r in right])
                score = np.round(a @ b.T, 6)
                score[ka[:, None] == kb[None, :]] = -np.inf
                most = min(depth, len(kb))
                least = -np.partition(-score, most - 1, axis=1)[:, most - 1]
                row, col = np.nonzero((score >= least[:, None]) & np.isfinite(score))  # with ties at the end
                order = np.lexsort((kb[col], -score[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < depth], col[place < depth]
                yield pd.DataFrame({"query_id": ka[row], key: kb[col], "score": score[row, col]})

    pairs = spread.join(q, "qb").select("qb_rows", "db_rows").mapInPandas(best, f"query_id bigint, {key} bigint, score double")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= depth)


def pair_scores(vectors: DataFrame, key: str, vector: str, queries: DataFrame | None = None) -> DataFrame:
    """(score, n): how many pairs of different keys have each inner product, rounded to 6 digits.

    All pairs, each once; with ``queries`` every one of these with every other vector. Each pair of
    blocks is one matrix product that returns counts of its scores, no pairs.
    """
    def block(df: DataFrame, n: int) -> DataFrame:
        return df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b"))

    n = max(1, -(-vectors.count() // PAIR_BLOCK))
    half, m = queries is None, n if queries is None else max(1, -(-queries.count() // PAIR_BLOCK))
    left, right = block(vectors if half else queries, m), block(vectors, n)
    left = left.select("k", "v", F.col("b").alias("i"), F.explode(F.sequence(F.col("b") if half else F.lit(0), F.lit(n - 1))).alias("j"))
    right = right.select("k", "v", F.explode(F.sequence(F.lit(0), F.col("b") if half else F.lit(m - 1))).alias("i"), F.col("b").alias("j"))

    def count(blocks: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"micro": np.array([], dtype=np.int64), "n": np.array([], dtype=np.int64)})
        va, vb = np.stack(a["v"].to_list()).astype(np.float64), np.stack(b["v"].to_list()).astype(np.float64)
        ka, kb = a["k"].to_numpy()[:, None], b["k"].to_numpy()[None, :]
        asked = ka < kb if half and blocks[0] == blocks[1] else ka != kb
        micro, n = np.unique(np.rint((va @ vb.T)[asked] * 1e6).astype(np.int64), return_counts=True)
        return pd.DataFrame({"micro": micro, "n": n})

    counts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(count, "micro bigint, n bigint")
    return counts.groupBy("micro").agg(F.sum("n").alias("n")).select((F.col("micro") / F.lit(1e6)).alias("score"), "n")


def fuse(rankings: list[DataFrame], query_key: str, key: str, k: int = lex.RRF_K, depth: int = lex.RERANK_DEPTH) -> DataFrame:
    """(query key, key, fused, rank, rrf_score): reciprocal rank fusion.

    ``fused`` sums 1 / (k + rank) over the rankings; ``rrf_score`` is 1 / (k + fused rank). Ties go
    to the item that stands better in the earliest ranking, then to the lesser key.
    """
    every = None
    for i, r in enumerate(rankings):
        part = r.select(query_key, key, "rank", F.lit(i).alias("src"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(query_key, key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("fused"), F.min(F.struct("src", "rank")).alias("first"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("fused"), "first", key)))
    return ranked.where(F.col("rank") <= depth).select(query_key, key, "fused", "rank", F.round(1 / (k + F.col("rank")), 9).alias("rrf_score"))


def confidence(scored: DataFrame, query_key: str) -> DataFrame:
    """Margin of the best over the second score of each query, 0 to 1; 0 with fewer than two."""
    top = scored.groupBy(query_key).agg(F.max("score").alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"))
    margin = (F.col("s1") - F.col("s2")) / F.abs("s1")
    return top.select(query_key, F.col("s1").alias("best_score"), F.when(F.col("s2").isNotNull() & (F.col("s1") > 0), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin)), 4)).otherwise(0.0).alias("confidence"))


def decision(score: Column, reuse_min: Column, adapt_min: Column) -> Column:
    return F.when(score >= reuse_min, "REUSE").when(score >= adapt_min, "ADAPT").otherwise("SYNTHESIZE")


def query_quality(ranked: DataFrame, relevant: DataFrame, query_key: str, key: str, k: int = 5) -> DataFrame:
    """(query key, recall_1, recall_k, reciprocal_rank, ndcg): binary relevance.

    ``relevant`` has (query key, key), one row for each wanted item. A query without hits scores 0.
    """
    wanted = relevant.groupBy(query_key).agg(F.countDistinct(key).alias("n_wanted"))
    hits = ranked.join(relevant.select(query_key, key).distinct(), [query_key, key])
    per = hits.groupBy(query_key).agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_wanted", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    both = wanted.join(per, query_key, "left")
    return both.select(query_key, F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("recall_1"), F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias("recall_k"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"))


def context_budget(ranked: DataFrame, query_key: str, text: str, budget: int = lex.CONTEXT_CHARS, snippet: int = lex.SNIPPET_CHARS) -> DataFrame:
    """Adds ``used``: characters of each hit that fit what better ones left of the budget."""
    before = Window.partitionBy(query_key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    want = F.least(F.lit(snippet), F.length(text))
    left = budget - F.coalesce(F.sum(want).over(before), F.lit(0))
    return ranked.withColumn("used", F.greatest(F.lit(0), F.least(want, left)).cast("bigint"))


def percentiles(values: DataFrame, column: str, times: str | None = None) -> DataFrame:
    """Background distribution and the two decision bounds derived from it, in one row.

    A value counts as often as the column ``times`` says.
    """
    p = lambda q: F.round(F.percentile(column, q, F.col(times) if times else 1), 4)
    n = F.coalesce(F.sum(times), F.lit(0)) if times else F.count(column)
    return values.agg(n.alias("n_pairs"), F.round(F.min(column), 4).alias("low"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.97).alias("adapt_min"), p(0.995).alias("reuse_min"), F.round(F.max(column), 4).alias("high"))
