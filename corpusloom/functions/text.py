"""Tokenizers and n-grams as Column expressions: all of them run in the JVM.  ``word_classes`` lets Arrow kernels find the same words."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words near Unicode's default word boundaries: letters, marks, digits and underscores, held together
#: by an apostrophe, full stop or colon between letters and by a separator between digits.
WORD = r"(?:[\p{L}\p{M}\p{N}_]+)(?:(?:['’.:·][\p{L}\p{M}_]|[.,;'][\p{N}])[\p{L}\p{M}\p{N}_]*)*"

_CLASSES: list[np.ndarray] = []

#: Universal tags of words that carry little meaning by themselves.
FUNCTION_TAGS = tuple("ADP AUX CCONJ DET INTJ PART PUNCT SCONJ SYM X".split())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body (or a lambda in it) refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_tokens(text: Column) -> Column:
    """Words; punctuation and space are dropped."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_classes(spark: SparkSession) -> np.ndarray:
    """What ``WORD`` makes of each code point: 1 a letter, mark or _, 2 a number, 4 and 8 what connects a word to one of 1 and of 2.

    The JVM's own regular expressions tell, so words are the same whether they or ``operators/_arrays.py: words`` find them.
    """
    if not _CLASSES:
        table = np.zeros(0x110000, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for bit, kept in ((1, r"\p{L}\p{M}_"), (2, r"\p{N}"), (4, "'’.:·"), (8, ".,;'")):
            left = spark._jvm.java.util.regex.Pattern.compile(f"[^{kept}]").matcher(every).replaceAll("")
            table[np.frombuffer(left.encode("utf-32-le"), np.uint32)] |= bit
        _CLASSES.append(table)
    return _CLASSES[0]


def char_tokens(text: Column) -> Column:
    """Grapheme clusters."""
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def space_tokens(text: Column, sep: str = " ", drop_trailing: bool = False) -> Column:
    """Split at one fixed character.  Empty tokens stay; ``drop_trailing`` drops one empty token at the end."""
    if len(sep) != 1:
        raise ValueError("the separator must be one character")
    parts = F.split(text, re.escape(sep), -1)
    if not drop_trailing:
        return parts
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def remove_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    """Keeps repeats, unlike a set difference."""
    if not stopwords:
        return tokens
    return F.filter(tokens, lambda t: ~F.coalesce(t.isin(*stopwords), F.lit(False)))


def keep_pos(lemmas: Column, tags: Column, keep: list[str] = (), remove: list[str] = FUNCTION_TAGS) -> Column:
    """Lemmas whose part of speech is among ``keep`` and not among ``remove``; an empty list switches a test off."""
    pairs = F.zip_with(lemmas, tags, lambda lemma, tag: F.struct(lemma.alias("lemma"), tag.alias("tag")))
    if keep:
        pairs = F.filter(pairs, lambda p: p["tag"].isin(*keep))
    if remove:
        pairs = F.filter(pairs, lambda p: ~p["tag"].isin(*remove))
    return F.transform(pairs, lambda p: p["lemma"])


def lemma_tokens(annotated: Column, keep: list[str] = (), remove: list[str] = FUNCTION_TAGS) -> Column:
    """Filter the output of a tagger of one's own: an array of (lemma, upos), such as an Arrow UDF returns."""
    return keep_pos(F.transform(annotated, lambda x: x["lemma"]), F.transform(annotated, lambda x: x["upos"]), keep, remove)


def ngrams(tokens: Column, n_min: int = 1, n_max: int = 1, stopwords: list[str] = (), sep: str = "_") -> Column:
    """All n-grams in order of their start, shorter ones first.  Stopwords go first, so n-grams span their gap."""
    if not 1 <= n_min <= n_max:
        raise ValueError("need 1 <= n_min <= n_max")
    tokens = remove_stopwords(tokens, list(stopwords))
    if n_max == 1:
        return tokens

    def made(own: Column) -> Column:
        size = F.size(own)

        def from_start(i: Column) -> Column:
            grams = [F.when(i + n <= size, F.array_join(F.slice(own, i + 1, F.lit(n)), sep)) for n in range(n_min, n_max + 1)]
            return F.filter(F.array(*grams), lambda g: g.isNotNull())

        found = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), from_start))
        return F.when(size > 0, found).otherwise(F.array().cast("array<string>"))

    return let(tokens, made)


def ngram_order(term: Column, sep: str = "_") -> Column:
    """Of how many parts a term is made."""
    return F.size(F.split(term, re.escape(sep), -1))


def windows(tokens: Column, width: int) -> Column:
    """All windows of ``width`` tokens, one apart; a shorter document is one window."""

    def made(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own) - width + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.slice(own, i, F.lit(width)))

    return let(tokens, made)
