"""Token search: weighted search documents, an inverted index, and the usual query grammar.

Words are folded (lower case, no accents). ``stem`` is a light Spanish one that takes plural and gender endings off; plain
``matches`` goes without it, so forms of a word are different words there. ``search_index`` keeps an index of stems.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.functions.text import FOLD_FROM, FOLD_TO, fold

_FOLD = str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, FOLD_FROM[len(FOLD_TO) :])
_BREAK, _NOTHING = 0, 1
#: Endings of folded words and what stands for them, in order; "_" keeps the last rule off and is taken out at the end.
_ENDINGS = (("eses$", "es_"), ("ces$", "z_"), ("^(.{3,})[aeo]s?$", r"\1"))


def tokens(c: Column) -> Column:
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), r"[^0-9a-z]+"), lambda t: t != "")


def search_document(weighted: Mapping[str, Column]) -> Column:
    """Array of (lexeme, weight) over columns by weight letter, sorted and distinct."""
    parts = [F.transform(tokens(c), lambda t, w=w: F.struct(t.alias("lexeme"), F.lit(w).alias("weight"))) for w, c in weighted.items()]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def inverted_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """lexeme, key: written partitioned by lexeme it answers searches without a scan of texts."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("lexeme"), key)


def parse(query: str) -> list[list[tuple[bool, tuple[str, ...]]]]:
    """Alternatives (``or``) of terms: (negated, words); a quoted term has several words, in order."""
    out: list[list[tuple[bool, tuple[str, ...]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not minus and word.lower() == "or":
            out.append([])
            continue
        words = tuple(t for t in re.split(r"[^0-9a-z]+", (phrase or word).translate(_FOLD).lower()) if t)
        if words:
            out[-1].append((bool(minus), words))
    return [x for x in out if x]


def stem(word: Column) -> Column:
    """A folded word without its ending where three letters or more are left: -eses to -es, -ces to -z, and -as, -es, -os, -a,
    -e, -o off."""
    for ending, short in _ENDINGS:
        word = F.regexp_replace(word, ending, short.replace("\\", "$"))
    return F.replace(word, F.lit("_"), F.lit(""))


def stemmed(word: str) -> str:
    """``stem`` of a query's word."""
    for ending, short in _ENDINGS:
        word = re.sub(ending, short, word)
    return word.replace("_", "")


def stems_of(words: pa.Array) -> pa.Array:
    """``stem`` of an Arrow array of words."""
    for ending, short in _ENDINGS:
        words = pc.replace_substring_regex(words, ending, short)
    return pc.replace_substring(words, "_", "")


@cache
def _letters() -> np.ndarray:
    """By code point the letter or digit that ``fold`` makes of it, ``_BREAK`` for what parts words, ``_NOTHING`` for marks."""
    table = np.zeros(0x110000, "u1")
    for c, d in ({c: chr(c) for c in (*range(128), 0x212A)} | _FOLD).items():  # of other signs, Kelvin's alone has a plain lower case
        folded = "" if d is None else (d if isinstance(d, str) else chr(d)).lower()
        table[c] = _NOTHING if folded == "" else ord(folded) if re.fullmatch("[0-9a-z]", folded) else _BREAK
    return table


def words_of(texts: Sequence[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after another, as ``tokens`` has them, and the number of the text that each is of."""
    line = "\n".join([*texts, ""])
    letters = _letters()[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")]
    text = np.repeat(np.arange(len(texts), dtype="i4"), np.fromiter(map(len, texts), "i8", len(texts)) + 1)
    there = letters != _NOTHING
    if not there.all():
        letters, text = letters[there], text[there]
    within = letters != _BREAK
    first = np.flatnonzero(within & ~np.concatenate([[False], within[:-1]]))
    letters_before = np.concatenate([np.cumsum(within, dtype="i4")[first] - 1, [within.sum()]]).astype("i4")
    words = pa.Array.from_buffers(pa.utf8(), len(first), [None, pa.py_buffer(letters_before), pa.py_buffer(letters[within])])
    return words, text[first]


def matches(text: Column, query: str, stems: bool = False) -> Column:
    """Whether a text answers a query: all terms of one alternative; ``-`` forbids; quotes ask for a phrase. ``stems``: forms of
    a word are one."""
    words = F.transform(tokens(text), stem) if stems else tokens(text)
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def term(negated: bool, own: tuple[str, ...]) -> Column:
        folded = [F.lit(stemmed(w) if stems else w) for w in own]
        hit = F.array_contains(words, folded[0]) if len(own) == 1 else line.contains(F.concat(F.lit(" "), F.concat_ws(" ", *folded), F.lit(" ")))
        return ~hit if negated else hit

    out = F.lit(False)
    for alternative in parse(query):
        both = F.lit(True)
        for negated, own in alternative:
            both = both & term(negated, own)
        out = out | both
    return out
