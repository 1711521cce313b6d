"""Addresses by template: ``https://host/{a}/{b}-{c}`` read into its fields, or built from them."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD = re.compile(r"\{(\w+)\}")


def _pattern(template: str) -> tuple[str, list[str]]:
    """A pattern that Java and RE2 read alike (no named groups, no look-around), and its groups' names. A field is one or more
    characters of a path segment; of several splits the earlier field takes the most."""
    parts, names, last = ["^"], [], 0
    for m in FIELD.finditer(template):
        parts += [re.escape(template[last : m.start()]), "([^/?#]+)"]
        names.append(m[1])
        last = m.end()
    return "".join([*parts, re.escape(template[last:]), "/?(?:[?#].*)?$"]).replace("\\-", "-").replace("\\/", "/"), names


def parse(template: str, url: Column) -> dict[str, Column]:
    """The fields of an address; null if it does not fit."""
    pattern, names = _pattern(template)
    return {name: F.nullif(F.regexp_extract(url, pattern, i + 1), F.lit("")) for i, name in enumerate(names)}


def rejection(template: str, url: Column) -> Column:
    """Why an address does not fit (missing, scheme, host, path), or null if it does."""
    scheme, _, rest = template.partition("://")
    host = rest.partition("/")[0]
    return (
        F.when(url.isNull() | (url == ""), "missing").when(F.split_part(url, F.lit("://"), F.lit(1)) != scheme, "scheme")
        .when(F.regexp_extract(url, r"^[^:/]+://([^/?#]*)", 1) != host, "host").when(~url.rlike(_pattern(template)[0]), "path")
    )


def build(template: str, fields: Mapping[str, Column]) -> Column:
    """An address of url-encoded fields; null if one is missing."""
    parts, last = [], 0
    for m in FIELD.finditer(template):
        parts += [F.lit(template[last : m.start()]), F.replace(F.url_encode(fields[m[1]]), F.lit("+"), F.lit("%20"))]
        last = m.end()
    return F.concat(*parts, F.lit(template[last:]))
