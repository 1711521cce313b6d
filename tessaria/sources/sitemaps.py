"""Sitemap frontier: from roots through indexes and nested indexes to page locations.

A round joins the frontier with the stored documents, reads their entries by a table function, and keeps child sitemaps
that no round before has seen (an anti-join), until nothing new is left. So cycles end, and a document that several
indexes list is read once. Documents that are not stored are followed no further. Entities are decoded; namespaces do
not matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.operators.workspace import Workspace

_ENTRY = re.compile(r"<(?:\w+:)?(sitemap|url)\b[^>]*>(.*?)</(?:\w+:)?\1\s*>", re.S)
_FIELD = {name: re.compile(rf"<(?:\w+:)?{name}\b[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?{name}\s*>", re.S) for name in ("loc", "lastmod")}


@F.udtf(returnType="kind string, loc string, lastmod string")
class SitemapEntries:
    """Entries of one document: kind (sitemap or url), loc, lastmod; those without a location are left out."""

    def eval(self, xml: str) -> Iterator[tuple[str, str, str | None]]:
        for kind, body in _ENTRY.findall(xml or ""):
            loc, lastmod = (f.search(body) for f in _FIELD.values())
            if loc and loc[1]:
                yield kind, html.unescape(loc[1]), lastmod[1] if lastmod else None


def entries(documents: DataFrame) -> DataFrame:
    """url of the document, kind, loc, lastmod of all entries of all documents."""
    return documents.lateralJoin(SitemapEntries(F.col("xml").outer())).select("url", "kind", "loc", "lastmod")


def frontier(documents: DataFrame, roots: DataFrame, most_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """Visited sitemaps (url, depth, stored) and the locations they list (loc, depth of the nearest document that does, listed_in:
    how many do, lastmod: the newest). ``documents``: url, xml; ``roots``: url."""
    space = Workspace(documents.sparkSession, "sitemaps")
    listed = space.write(entries(documents.dropDuplicates(["url"])), "entries")
    children = listed.filter("kind = 'sitemap'").select("url", "loc").distinct()
    fresh = visited = space.write(roots.select("url").filter("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "round0")
    for depth in range(1, most_rounds + 1):
        found = fresh.join(children, "url").select(F.col("loc").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
        fresh = space.write(found.withColumn("depth", F.lit(depth)), f"round{depth}")
        if fresh.isEmpty():
            break
        visited = visited.unionByName(fresh)
    else:
        raise RuntimeError(f"sitemaps are nested deeper than {most_rounds}")
    known = visited.join(documents.select("url", F.lit(True).alias("stored")).distinct(), "url", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    pages = listed.filter("kind = 'url'").join(visited, "url").groupBy("loc").agg(F.min("depth").alias("depth"), F.count_distinct("url").alias("listed_in"), F.max("lastmod").alias("lastmod"))
    return known, pages
