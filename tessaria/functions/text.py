"""Normalisers and extractors over strings, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that compatibility decomposition turns into one letter and marks, what they become, and the marks, which go.
_DECOMPOSED = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in (*range(0xA1, 0x250), *range(0x1E00, 0x1F00))}
_LETTERS = [(c, d) for c, d in _DECOMPOSED.items() if len(d) == 1 and d != c]
_MARKS = "".join(map(chr, range(0x300, 0x370)))
FOLD_FROM, FOLD_TO = "".join(c for c, _ in _LETTERS) + _MARKS, "".join(d for _, d in _LETTERS)
#: Street abbreviations and their expansions, in order. (Fixed values; (?U) reads letters as Unicode has them.)
STREETS = {
    r"(?U)\bc/(?!\w)": "calle",
    r"(?U)\bcl\.?(?!\w)": "calle",
    r"(?U)\bavda\.?(?!\w)": "avenida",
    r"(?U)\bav\.?(?!\w)": "avenida",
    r"(?U)\bpza\.?(?!\w)": "plaza",
    r"(?U)\bpº(?!\w)": "paseo",
}
#: Floor words and what they count as, the first that is found. (Fixed values.)
FLOOR_WORDS = (
    ("entresuelo", "entresuelo"),
    ("entreplanta", "entresuelo"),
    ("semisotano", "semisotano"),
    ("sotano", "sotano"),
    ("atico", "atico"),
    ("principal", "principal"),
    ("planta baja", "bajo"),
    ("bajo", "bajo"),
)
#: Patterns of scoring's floor numbers, the first that is found. (Fixed values.)
FLOOR_NUMBERS = ((r"\bbaj[oa]s?\b|\bentresuelo\b", 0.0), (r"\bentreplanta\b", 0.5), (r"\bsemi[-\s]?sotano\b", -0.5), (r"\bsotano\b", -1.0), (r"\batico\b", 50.0))
#: Words and marks of the feed's ground floors, and the word that rules them out. (Fixed values.)
GROUND_WORDS, GROUND_MARKS, UNDER_ROOF = "bajo|baja|entresuelo|entreplanta|planta baja|semisotano|semisótano", ("0", "pb", "bj"), "cubierta"
#: Spanish numbers, with an optional prefix and separators. (Fixed value.)
PHONE = r"(?<!\d)(?:\+34[\s.-]?)?[6789]\d{2}[\s.-]?\d{3}[\s.-]?\d{3}(?!\d)"
#: The label before a code, the short suffix after it, the least length, and values that stand for no code. (Fixed values.)
CODE_LABEL, CODE_SUFFIX, LEAST_CODE = r"^(referencia|ref\.?)(?=$|[\s:\-])[\s:\-]*", r"^(.+)[-_/]([0-9a-z]{1,3})$", 4
PLACEHOLDERS = ("0", "-", "n/a", "na", "ref", "sin referencia", "sinreferencia", "sin-referencia", "pendiente", "tbd", "todo")
#: Phrases of a portal's challenge page, and how many different ones make a block. (Fixed values.)
CHALLENGE = (
    "muchas peticiones",
    "en poco tiempo",
    "desliza hacia la derecha",
    "por que esta verificacion",
    "comportamiento del navegador",
    "velocidad sobrehumana",
    "bloquea el funcionamiento de javascript",
    "un robot se encuentra en la misma red",
)
CHALLENGE_HITS = 2
#: Markers of failures, network before structure. (Fixed values.)
NETWORK_MARKERS = (
    "timeout", "timed out", "connection", "could not connect", "refused", "unreachable", "reset by peer", "econnreset",
    "name resolution", "getaddrinfo", "dns", "ssl", "certificate", "network is unreachable",
)
STRUCTURE_MARKERS = (
    "parse", "json", "html", "selector", "marker", "nonetype", "keyerror", "attributeerror", "indexerror",
    "no such element", "structure", "decode", "unexpected", "missing",
)


def fold(c: Column) -> Column:
    """Lower case without accents; ª and º become a and o."""
    return F.lower(F.translate(c, FOLD_FROM, FOLD_TO))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_address(c: Column) -> Column:
    out = strip(F.lower(c))
    for pattern, word in STREETS.items():
        out = F.regexp_replace(out, pattern, word)
    return F.trim(F.regexp_replace(F.regexp_replace(fold(out), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def normalize_floor(c: Column) -> Column:
    """Dedup's floor: the first known word in order, else the first number without leading zeros, else null."""
    low = fold(c)
    digits = F.regexp_replace(F.regexp_extract(low, r"(\d+)", 1), r"^0+(?=\d)", "")
    out = F.nullif(digits, F.lit(""))
    for word, name in reversed(FLOOR_WORDS):
        out = F.when(low.contains(word), name).otherwise(out)
    return out


def floor_number(c: Column) -> Column:
    """Scoring's floor, as a number."""
    low = fold(c)
    out = F.nullif(F.regexp_extract(low, r"(\d+)", 1), F.lit("")).cast("double")
    for pattern, value in reversed(FLOOR_NUMBERS):
        out = F.when(low.rlike(pattern), value).otherwise(out)
    return out


def is_ground_floor(c: Column) -> Column:
    """The feed's test: ground words anywhere, or 0, PB, BJ alone, but nothing under the roof. Unknown is no ground floor."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return ~low.contains(UNDER_ROOF) & (low.rlike(GROUND_WORDS) | F.trim(low).isin(*GROUND_MARKS))


def extract_phones(c: Column) -> Column:
    """Distinct nine-digit numbers, sorted."""
    digits = F.transform(F.regexp_extract_all(c, F.lit(f"({PHONE})"), F.lit(1)), lambda m: F.regexp_replace(m, r"\D", ""))
    national = F.transform(digits, lambda x: F.when((F.length(x) == 11) & x.startswith("34"), F.substring(x, 3, 9)).otherwise(x))
    return F.array_sort(F.array_distinct(F.filter(national, lambda x: F.length(x) == 9)))


def normalize_reference_code(c: Column) -> Column:
    """Lower-case code without a label before it; null for placeholders, under four characters, or without a digit."""
    low = strip(F.regexp_replace(strip(F.lower(c)), CODE_LABEL, ""))
    return F.when(low.isin(*PLACEHOLDERS) | (F.length(low) < LEAST_CODE) | ~low.rlike(r"\d"), None).otherwise(low)


def code_base(c: Column) -> Column:
    """A code without its short suffix, or null if it has none or too little would be left."""
    base = F.regexp_extract(c, CODE_SUFFIX, 1)
    return F.when(F.length(base) >= LEAST_CODE, base)


def codes_equivalent(a: Column, b: Column) -> Column:
    """Equal, or exactly one has a suffix and is the other without it."""
    x, y = code_base(a), code_base(b)
    one = F.coalesce(x.isNotNull() & y.isNull() & (x == b), F.lit(False)) | F.coalesce(y.isNotNull() & x.isNull() & (y == a), F.lit(False))
    return F.coalesce(a == b, F.lit(False)) | one


def normalize_cadastral(c: Column) -> Column:
    flat = F.upper(F.regexp_replace(c, r"\s+", ""))
    return F.when(flat.rlike(r"^[0-9A-Z]{20}$") & flat.rlike(r"\d") & flat.rlike(r"[A-Z]"), flat)


def spanish_number(c: Column) -> Column:
    """``379.000,50`` to 379000."""
    return F.nullif(F.regexp_replace(F.split(c, ",")[0], r"[^0-9]", ""), F.lit("")).cast("long")


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags; folded, spaces collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(fold(bare), r"\s+", " "))


def phrase_hits(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: text.contains(p)))


def failure_class(c: Column) -> Column:
    """Class of a failure's type and message: network before structure_change before other."""
    low = F.lower(c)
    some = lambda markers: reduce(lambda a, b: a | b, (low.contains(m) for m in markers))
    return F.when(some(NETWORK_MARKERS), "network").when(some(STRUCTURE_MARKERS), "structure_change").otherwise("other")


def match_key(url: Column) -> Column:
    """Host without www. plus path without a trailing slash."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)), r"^www\.", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), r"/$", ""))


def content_hash(pairs: str) -> Column:
    """SHA-256 of the JSON of an array of (id, text): ``[{"id":1,"d":"trimmed text"},...]`` in order of id, a missing id
    counting as 0 and a missing text as empty; equal ids stay in their order."""
    placed = F.transform(pairs, lambda p, i: F.struct(F.coalesce(p["id"], F.lit(0)).alias("order"), i.alias("i"), p["id"].alias("id"), strip(F.coalesce(p["text"], F.lit(""))).alias("d")))
    material = F.transform(F.array_sort(placed), lambda p: F.struct(p["id"].alias("id"), p["d"].alias("d")))
    return F.sha2(F.to_json(material, {"ignoreNullFields": "false"}), 256)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit a character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & where.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def indel_similarity(a: str, b: str) -> float:
    """1 − (insertions + deletions) / (sum of lengths)."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def _token_sort_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    ratio = lambda x, y: indel_similarity(" ".join(sorted(x.split())), " ".join(sorted(y.split())))
    for a, b in pairs:
        # a batch asks for equal pairs once
        known = {p: None if p[0] is None or p[1] is None else ratio(*p) for p in set(zip(a, b, strict=True))}
        yield pd.Series([known[p] for p in zip(a, b, strict=True)], dtype="float64")


def token_sort_ratio(a, b) -> Column:
    """Similarity of two texts with their tokens sorted; null if either is. For pairs that survive blocking."""
    return F.pandas_udf(_token_sort_ratio, "double")(a, b)
