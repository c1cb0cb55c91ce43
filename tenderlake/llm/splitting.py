"""Cutting oversized texts at natural boundaries.

Dynamic programming over boundary positions: of all ways to cut a text at its candidate positions
into pieces within the limit, each starting a fixed overlap before the previous one ends, the one
with the least sum of cut penalties and squared deviations from even sizes is taken. All natural
boundaries are candidates. Words are where the natural ones lie more than half a stride (limit less
overlap) apart, single characters where the words do too, every 64th of a stride; with better
boundaries near, their penalty hardly ever pays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a heading that stays with the text below it, at most; longer lines with a mark are text.
HEADING = 200
#: Cost of a cut at each kind of boundary; a piece more costs PIECE, unevenness EVEN x deviation².
PENALTY = {"heading": 0.0, "paragraph": 0.1, "line": 0.4, "sentence": 0.6, "clause": 2.0, "word": 4.0, "hard": 12.0}
PIECE, EVEN = 1.0, 2.0
KINDS = list(PENALTY)
BLANKS = " \t\r\n"
BOUNDARY = re.compile(r"(?P<paragraph>\r?\n[ \t]*(?:\r?\n[ \t]*)+)|(?P<line>\r?\n|\r)|(?P<sentence>[.!?。！？।॥…][\"'”’»)\]]*[ \t]+)|(?P<clause>[,;:—–][ \t]+)|(?P<word>[ \t  - 　]+)")


def _fill(positions: list[int], kinds: list[int], more: Iterator[tuple[int, int]], gap: int) -> tuple[list[int], list[int]]:
    """Add positions of ``more`` inside gaps wider than ``gap``."""
    extra = list(more)
    at, out_p, out_k = 0, [positions[0]], [kinds[0]]
    for p, k in zip(positions[1:], kinds[1:]):
        wide = p - out_p[-1] > gap
        while at < len(extra) and extra[at][0] <= out_p[-1]:
            at += 1
        while at < len(extra) and extra[at][0] < p:
            if wide:
                out_p.append(extra[at][0]), out_k.append(extra[at][1])
            at += 1
        out_p.append(p), out_k.append(k)
    return out_p, out_k


def boundaries(text: str, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end, with their kinds; no two neighbours lie more than ``stride`` apart.

    Words serve only where better boundaries are more than half a stride apart, and single
    characters (never before a combining mark, if that can be helped) only where words are.
    """
    natural: list[tuple[int, int]] = []
    words: list[tuple[int, int]] = []
    n = len(text)
    for m in BOUNDARY.finditer(text):
        kind, end = m.lastgroup, m.end()
        if not 0 < end < n:
            continue
        if kind == "word":
            words.append((end, KINDS.index("word")))
            continue
        if kind in ("paragraph", "line") and text[end] == "#":
            kind = "heading"
        elif kind in ("paragraph", "line"):
            start = text.rfind("\n", 0, m.start()) + 1
            if text[start] == "#" and m.start() - start < HEADING:  # a heading stays with its text
                kind = "clause"
        natural.append((end, KINDS.index(kind)))
    hard = KINDS.index("hard")
    pos, kinds = [0, *(p for p, _ in natural), n], [hard, *(k for _, k in natural), hard]
    gap = max(1, stride // 2)
    pos, kinds = _fill(pos, kinds, iter(words), gap)
    step = max(1, stride // 64)
    spans = [(a, b) for a, b in zip(pos, pos[1:]) if b - a > gap]
    if spans:
        marks = ((p + 1 if p + 1 < b and unicodedata.combining(text[p]) else p, hard) for a, b in spans for p in range(a + step, b, step))
        pos, kinds = _fill(pos, kinds, iter(sorted(set(marks))), gap)
    return np.array(pos, dtype=np.int64), np.array(kinds, dtype=np.int64)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of boundary at the end) of each piece; the last kind is ``end``.

    Every piece is at most ``limit`` code points; each but the first starts ``overlap`` before the
    end of the one before it (at most limit - 1, so that every piece brings something new).
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    overlap = max(0, min(overlap, limit - 1))
    stride = limit - overlap
    pos, kinds = boundaries(text, stride)
    least = int(np.ceil((n - overlap) / stride))
    ideal = (n + (least - 1) * overlap) / least
    penalty = np.array([PENALTY[k] for k in KINDS])[kinds]
    penalty[-1] = 0.0
    m = len(pos)
    cost, back = np.full(m, np.inf), np.zeros(m, dtype=np.int64)
    cost[0] = 0.0
    first = np.searchsorted(pos, pos - stride, side="left")
    for j in range(1, m):
        best, at = np.inf, 0
        if overlap < pos[j] <= limit:  # the first piece; the next can start its overlap before this end
            best = EVEN * ((pos[j] - ideal) / limit) ** 2
        i0 = max(1, first[j])
        if i0 < j:
            size = (pos[j] - pos[i0:j]) + overlap
            total = cost[i0:j] + EVEN * ((size - ideal) / limit) ** 2
            k = int(total.argmin())
            if total[k] < best:
                best, at = total[k], i0 + k
        cost[j], back[j] = best + penalty[j] + PIECE, at
    ends, j = [], m - 1
    while j > 0:
        ends.append(j)
        j = back[j]
    ends.reverse()
    out, start = [], 0
    for j in ends:
        out.append((start, int(pos[j]), "end" if j == m - 1 else KINDS[kinds[j]]))
        start = int(pos[j]) - overlap
    return out


def _cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["tbl", "run_id", "item_id", "piece_no", "start", "end", "boundary", "text"]
    for batch in batches:
        rows, size = [], 0
        for tbl, run, item, text, limit, overlap in zip(batch["tbl"], batch["run_id"], batch["item_id"], batch["text"], batch["max_chars"], batch["overlap_chars"]):
            for no, (start, end, kind) in enumerate(cut(text, int(limit), int(overlap)), 1):
                rows.append((tbl, run, item, no, start, end, kind, text[start:end]))
                size += end - start
            if size > 4_000_000:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def items(tbl: str, field: str, df: DataFrame, run_id: Column, item_id: Column) -> DataFrame:
    """Texts of one table in the form that ``split`` takes."""
    return df.select(F.lit(tbl).alias("tbl"), F.lit(field).alias("field"), run_id.alias("run_id"), item_id.alias("item_id"), F.col(field).alias("text"), "loaded_at")


def split(parts: list[DataFrame], limits: DataFrame) -> DataFrame:
    """Pieces of every text above the limit of its table and field.

    ``parts`` come from ``items``; ``limits`` has tbl, field, max_chars, overlap_chars (a handful
    of rows; limits below 1 are ignored, a null overlap is 0). Sizes are Unicode code points after
    blanks, tabs, CR and LF at both ends are taken off. Returns tbl, run_id, item_id, piece_no
    (from 1), start, end, boundary, text; dropping the overlap, the pieces make up the text again.
    Texts within the limit, null and empty ones give no pieces. A key delivered more than once is
    cut once, at its latest delivery (of equal times the greatest text).
    """
    rule = F.broadcast(limits.where("max_chars >= 1").groupBy("tbl", "field").agg(F.min("max_chars").alias("max_chars"), F.coalesce(F.min("overlap_chars"), F.lit(0)).alias("overlap_chars")))
    every = reduce(DataFrame.unionByName, [p.select("tbl", "field", "run_id", "item_id", stripped(F.col("text")).alias("text"), "loaded_at") for p in parts])
    large = every.join(rule, ["tbl", "field"]).where(F.length("text") > F.col("max_chars"))
    once = large.groupBy("tbl", "field", "run_id", "item_id", "max_chars", "overlap_chars").agg(F.max(F.struct("loaded_at", "text")).alias("last"))
    once = once.select("tbl", "run_id", "item_id", F.col("last.text").alias("text"), "max_chars", "overlap_chars")
    return once.mapInPandas(_cut_batches, "tbl string, run_id string, item_id string, piece_no int, start bigint, end bigint, boundary string, text string")


def cut_report(pieces: DataFrame) -> DataFrame:
    """Cuts of each kind for each table."""
    return pieces.groupBy("tbl", "boundary").agg(F.count(F.lit(1)).alias("n_pieces"), F.max(F.length("text")).alias("longest"), F.countDistinct("run_id", "item_id").alias("n_items"))
