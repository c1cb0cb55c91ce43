"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake.functions import lexicon as lex

_DOT = "\x00"


def strip(text: Column) -> Column:
    """Without any white space at both ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def normalize(text: Column) -> Column:
    """Without markdown emphasis, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[*_`]+", ""), r"\s+", " "))


def tokenize(text: Column) -> Column:
    """Lower-case alphanumeric runs, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column, stopwords: list[str], longer_than: int = 2) -> Column:
    """Distinct tokens that are no stopwords and longer than ``longer_than``."""
    return F.array_distinct(F.filter(tokenize(text), lambda w: (F.length(w) > longer_than) & ~w.isin(stopwords)))


def split_sentences(text: Column) -> Column:
    """Sentences; dots of abbreviations and decimal numbers do not end one."""
    safe = reduce(lambda t, a: F.replace(t, F.lit(a), F.lit(a.replace(".", _DOT))), lex.ABBREVIATIONS, normalize(F.coalesce(text, F.lit(""))))
    safe = F.regexp_replace(safe, r"(\d)\.(\d)", "$1" + _DOT + "$2")
    parts = F.split(safe, r"(?<=[.!?])\s+(?=[A-Z(\[])")
    return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit(_DOT), F.lit(".")))), lambda p: p != "")


def overlap_left(a: Column, b: Column) -> Column:
    """Share of ``a`` that is in ``b``; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def dedupe_key(text: Column) -> Column:
    """Sorted distinct words without the commonest ones, at most 220 characters."""
    t = F.regexp_replace(F.lower(normalize(text)), lex.DEDUPE_WORDS, " ")
    words = F.filter(F.split(F.regexp_replace(t, r"[^a-z0-9 ]+", " "), r"\s+"), lambda w: w != "")
    return F.left(F.array_join(F.array_sort(F.array_distinct(words)), " "), F.lit(220))


def parse_number(text: Column) -> Column:
    return F.regexp_replace(text, r"[,*]", "").try_cast("double")


def cell_number(cell: Column) -> Column:
    """Number of a table cell (currency signs and emphasis off, a per cent sign allowed), else null."""
    bare = strip(F.regexp_replace(cell, r"[*₹€]", ""))
    return parse_number(F.nullif(F.regexp_extract(bare, rf"\A({lex.NUMBER})\s*%?\z", 1), F.lit("")))


def matches(computed: Column, stated: Column, relative: float = lex.RELATIVE_TOLERANCE) -> Column:
    gap = F.abs(computed - stated)
    return (gap <= lex.ABSOLUTE_TOLERANCE) | (gap / F.greatest(F.abs(computed), F.abs(stated), F.lit(1.0)) <= relative)


def word_count(text: Column) -> Column:
    """White-space separated words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def syllables(word: Column) -> Column:
    w = F.regexp_replace(F.lower(word), r"\A'+|'+\z", "")
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = w.endswith("e") & (n > 1) & ~w.endswith("le") & ~w.endswith("ee")
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), n - F.when(silent, 1).otherwise(0)))


def readability(markdown: Column) -> Column:
    """Flesch reading ease, two decimals; 0 without words."""
    body = F.regexp_replace(markdown, r"(?md)^#+\s.*$", "")
    n_sentences = F.size(split_sentences(body))
    words = F.regexp_extract_all(markdown, F.lit("[A-Za-z']+"), F.lit(0))
    n_words = F.size(words)
    n_syllables = F.aggregate(words, F.lit(0), lambda a, w: a + syllables(w))
    score = 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)
    return F.when((n_sentences > 0) & (n_words > 0), F.round(F.round(score, 6), 2)).otherwise(0.0)


def checkable(sentence: Column) -> Column:
    """Does the sentence assert something a source could contradict?"""
    return (word_count(sentence) >= 4) & (sentence.rlike(lex.CHECKABLE) | sentence.rlike(lex.ACRONYM))


def natural_key(title: Column) -> Column:
    """Sort key: numbers of the title as numbers, titles without any last."""
    numbers = F.transform(F.regexp_extract_all(title, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint"))
    return F.struct((F.size(numbers) == 0).alias("plain"), numbers.alias("numbers"), F.when(F.size(numbers) == 0, title).otherwise("").alias("title"))


def fill_template(template: Column, values: Column) -> Column:
    """``{{NAME}}`` replaced by the map's value; unknown names become ``[[NAME]]``."""
    filled = F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))
    return F.regexp_replace(filled, r"\{\{\s*(\w+)\s*\}\}", "[[$1]]")


def unfilled(template: Column, values: Column) -> Column:
    names = F.regexp_extract_all(template, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~F.array_contains(F.map_keys(values), n))))


def json_slice(text: Column) -> Column:
    """The JSON inside a reply as a variant: fences off, else the outermost braces or brackets; null if there is none."""
    bare = F.regexp_replace(strip(text), r"(?s)\A```(?:json)?\s*|\s*```\z", "")
    outer = [F.nullif(F.regexp_extract(bare, p, 0), F.lit("")) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]")]
    return F.coalesce(F.try_parse_json(bare), *[F.try_parse_json(o) for o in outer])


def fit_cells(cells: Column, width: Column | int) -> Column:
    """Cells cut or filled with empty ones to ``width``."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), w)), F.lit(1), w)


def within(ids: Column, allowed: Column) -> Column:
    """The ids that are allowed, in their order."""
    return F.filter(ids, lambda i: F.array_contains(allowed, i))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, each ended by a NUL."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p, F.lit("")), F.lit(_DOT)) for p in parts]), 256)


def token_budget(words: Column) -> Column:
    """Tokens to allow for a text of so many words."""
    return F.greatest(F.lit(400), F.least(F.lit(2200), F.floor(words * 2.8))).cast("int")


def clean_reply(reply: Column, heading: Column) -> Column:
    """A drafted section without code fences and what stands before its first heading of level 2; ``heading`` is put first if there is none."""
    bare = strip(F.regexp_replace(strip(reply), r"(?s)\A```(?:markdown|md)?\s*|\s*```\z", ""))
    at = F.regexp_extract(bare, r"(?s)(?:\A|\n)(## .*)\z", 1)
    return F.when(at != "", at).otherwise(F.concat(F.lit("## "), heading, F.lit("\n\n"), bare))


def capped_sources(ids: Column, kind: Column) -> Column:
    """The sources that a sentence of some kind may name: one if it is reused or adapted, four if put together, else none."""
    most = F.when(kind.isin("REUSED", "ADAPTED"), 1).when(kind == "SYNTHESIZED", 4).otherwise(0)
    return F.slice(ids, F.lit(1), most)
