"""Sources: embedded JSON and selectors in HTML, sitemaps, paged JSON, CSV gazetteers, captured pages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE_SCHEMA = "name string, province string, lat double, lon double, population long"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def embedded_json(html: Column, marker: str, schema: str) -> Column:
    """The JSON object assigned to ``marker`` in a script, parsed; null without one."""
    body = F.regexp_extract(html, rf"(?s){marker}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1)
    return F.from_json(F.nullif(body, F.lit("")), schema)


def script_json(html: Column, element_id: str, schema: str) -> Column:
    """The JSON text of a script element with an id."""
    body = F.regexp_extract(html, rf"""(?s)<script[^>]*id=["']{element_id}["'][^>]*>(.*?)</script>""", 1)
    return F.from_json(F.nullif(F.trim(body), F.lit("")), schema)


class _Texts(HTMLParser):
    """Texts of the first element for each of several selectors (tag, #id, .class or tag.class), without dropped tags."""

    def __init__(self, selectors: Sequence[str], drop: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.drop = [(s.partition("#") if "#" in s else s.partition(".")) for s in selectors], set(drop)
        self.found: list[list[str] | None] = [None] * len(selectors)
        self.open: list[tuple[str, list[int], bool]] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = (attrs.get("class") or "").split()
        own = []
        for i, (name, kind, value) in enumerate(self.wanted):
            if self.found[i] is None and (not name or name == tag) and (not kind or (value == attrs.get("id") if kind == "#" else value in classes)):
                self.found[i] = []
                own.append(i)
        if tag not in VOID:
            self.open.append((tag, own, tag in self.drop))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(dropped for _, _, dropped in self.open):
            for _, own, _ in self.open:
                for i in own:
                    self.found[i].append(data)


def select_texts(df: DataFrame, key: str, html: str, fields: Mapping[str, Sequence[str]], drop: Sequence[str] = ("script", "style", "noscript")) -> DataFrame:
    """key and one column per field: the text of the first of its selectors that is there and not blank."""
    selectors = [s for chain in fields.values() for s in chain]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch["_html"]:
                parser = _Texts(selectors, drop)
                parser.feed(page or "")
                texts = {s: " ".join("".join(t).split()) for s, t in zip(selectors, parser.found, strict=True) if t is not None}
                rows.append([next((texts[s] for s in chain if texts.get(s)), None) for chain in fields.values()])
            yield pd.concat([batch[[key]].reset_index(drop=True), pd.DataFrame(rows, columns=list(fields), dtype=object)], axis=1)

    schema = f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} string" for c in fields)
    return df.select(key, F.col(html).alias("_html")).mapInPandas(run, schema)


def sitemap_locations(xml: Column) -> Column:
    """All locations of a sitemap or sitemap index."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def sitemap_files(spark: SparkSession, path: str, row_tag: str = "url") -> DataFrame:
    """Sitemap files through Spark's XML reader."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def json_pages(spark: SparkSession, path: str, rows: str, schema: str, lines: bool = False) -> DataFrame:
    """Rows of paged JSON documents, one a file (or one a ``lines`` row); ``schema`` is that of the whole document."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.explode(rows).alias("row")).select("row.*")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLACE_SCHEMA).option("header", True).csv(path)


def reconcile_worklist(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, state (added, stale, known) of discovered against listed entries."""
    f, k = found.select(key).distinct().withColumn("_f", F.lit(True)), known.select(key).distinct().withColumn("_k", F.lit(True))
    both = f.join(k, key, "full")
    return both.select(key, F.when(F.col("_k").isNull(), "added").when(F.col("_f").isNull(), "stale").otherwise("known").alias("state"))


def breaker(df: DataFrame, source: str, order: str, failed: str, size: int = 20, limit: float = 0.5) -> DataFrame:
    """Adds ``open``: the failure share of the last ``size`` requests of a source exceeds the limit."""
    from pyspark.sql import Window

    w = Window.partitionBy(source).orderBy(order).rowsBetween(-(size - 1), 0)
    return df.withColumn("open", (F.count("*").over(w) >= size) & (F.avg(F.col(failed).cast("double")).over(w) > limit))


def map_vocabulary(value: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """A source's words for a kind to the common ones."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.create_map(*entries)[F.lower(F.trim(value))], F.lit(default))


def canonical(df: DataFrame, source: str, columns: Mapping[str, Column]) -> DataFrame:
    """A connector: a source's rows as canonical listings (external_id, source and the mapped columns)."""
    return df.select(F.lit(source).alias("source"), *(c.alias(name) for name, c in columns.items()))
