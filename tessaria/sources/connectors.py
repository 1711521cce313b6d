"""Connectors: stored pages of several sites as one Python data source, and their canonical listings.

A connector says which host is its own, how a page's payload becomes a flat raw record (``parse``, the only Python per
page), and which column expressions make a canonical listing of raw records (``columns``). ``ListingPages`` reads a
folder of stored pages (Parquet: page_id, url, html) with one input partition per group of rows of a file, so a cluster
reads and parses them in parallel and a lost task repeats its own group alone. Filters on page_id and source are pushed:
groups beyond the bounds are never opened, pages of other sites never parsed.

Discovery lists the pages' own addresses and the links that they hold; a connector without discovery is fed by captures
alone. Kinds are looked up in a vocabulary table by source and word.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

RAW = "page_id long, source string, external_id string, url string, raw string"
#: The canonical schema that every source is brought to.
CANONICAL = ("source", "external_id", "url", "status", "operation", "listing_kind", "property_type", "current_price", "description", "rooms", "features", "photo_urls", "raw_extra")


@dataclass(frozen=True)
class Connector:
    """A site: raw records by ``parse(url, html)`` (None: not a listing), canonical columns of the parsed ``schema``."""

    name: str
    host_suffix: str
    parse: Callable[[str, str], dict | None]
    schema: str
    columns: Callable[[Column, Column], Mapping[str, Column]]
    supports_discovery: bool = True
    id_pattern: str = r"/([A-Za-z0-9]+)/?$"
    kinds: Mapping[str, str] = field(default_factory=dict)

    def owns(self, url: str) -> bool:
        host = (urlsplit(url).hostname or "").lower()
        return host == self.host_suffix or host.endswith("." + self.host_suffix)

    def external_id(self, url: str) -> str | None:
        parts = urlsplit(url)
        found = re.search(self.id_pattern, parts.path)
        return f"{(parts.hostname or '').lower()}:{found[1]}" if found else None


class _Page(HTMLParser):
    """Language, title, first heading, links of the navigation and text of the paragraphs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lang, self.links, self.title, self.heading, self.body, self._in = None, [], [], [], [], []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "html":
            self.lang = values.get("lang")
        elif tag == "a" and values.get("href"):
            self.links.append(values["href"])
        elif tag in ("title", "h1", "article", "script", "style", "nav"):
            self._in.append(tag)

    def handle_endtag(self, tag):
        if tag in self._in:
            while self._in.pop() != tag:
                pass

    def handle_data(self, data):
        if "script" in self._in or "style" in self._in:
            return
        for tag, out in (("title", self.title), ("h1", self.heading), ("article", self.body)):
            if tag in self._in:
                out.append(data)


def page(html: str) -> _Page:
    parser = _Page()
    parser.feed(html or "")
    parser.close()
    return parser


def squeezed(parts: list[str]) -> str | None:
    return " ".join("".join(parts).split()) or None


class _Part(InputPartition):
    def __init__(self, uri: str, group: int):
        self.uri, self.group = uri, group


class _Reader(DataSourceReader):
    def __init__(self, uri: str, connectors: Mapping[str, Connector]):
        self.uri, self.connectors = uri, dict(connectors)
        self.low: int | None = None
        self.high: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of page_id and names of sources are taken note of; all filters are still left to Spark."""
        for f in filters:
            column = ".".join(f.attribute) if getattr(f, "attribute", None) else None
            if column == "page_id" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(f.value, self.low if self.low is not None else f.value)
            if column == "page_id" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(f.value, self.high if self.high is not None else f.value)
            if column == "source" and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.connectors = {n: c for n, c in self.connectors.items() if n in names}
            yield f

    def partitions(self) -> list[InputPartition]:
        """Row groups whose bounds of page_id the filters allow; footers alone are read here."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        info = store.get_file_info(path)
        files = [path] if info.is_file else sorted(f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(".parquet"))
        out = []
        for name in files:
            with store.open_input_file(name) as handle:
                meta = pq.ParquetFile(handle).metadata
            at = meta.schema.names.index("page_id")
            for g in range(meta.num_row_groups):
                bounds = meta.row_group(g).column(at).statistics
                known = bounds is not None and bounds.has_min_max
                if known and ((self.low is not None and bounds.max < self.low) or (self.high is not None and bounds.min > self.high)):
                    continue
                out.append(_Part(name, g))
        return out if self.connectors else []

    def read(self, partition: _Part) -> Iterator[tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.uri)
        with store.open_input_file(partition.uri) as handle:
            for batch in pq.ParquetFile(handle).iter_batches(256, [partition.group], ["page_id", "url", "html"]):
                for row in batch.to_pylist():
                    url = row["url"] or ""
                    for name, connector in self.connectors.items():
                        number = connector.external_id(url) if connector.owns(url) else None
                        raw = connector.parse(url, row["html"] or "") if number else None
                        if raw is not None:
                            yield row["page_id"], name, number, url, json.dumps(raw, ensure_ascii=False)


class ListingPages(DataSource):
    """``spark.read.format("listing_pages").load(uri)``; option ``sources``: names of connectors, comma-joined (default: all)."""

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        names = [n for n in self.options.get("sources", "").split(",") if n]
        chosen = {n: c for n, c in CONNECTORS.items() if not names or n in names}
        uri = self.options["path"]
        return _Reader(uri if "://" in uri or uri.startswith("/") else f"/{uri}", chosen)


def _gallery_page(url: str, html: str) -> dict | None:
    """A page of markup: title, heading, language of the document and the links of its navigation."""
    found = page(html)
    if not found.title:
        return None
    return {"title": squeezed(found.title), "heading": squeezed(found.heading), "lang": found.lang, "links": [urljoin(url, x) for x in found.links]}


def _tracker_page(url: str, html: str) -> dict | None:
    """A page whose script carries the record's number; its kind is a part of the path."""
    number = re.search(r"track\((\d+)\)", html)
    if not number:
        return None
    parts = urlsplit(url)
    return {"number": int(number[1]), "section": parts.path.strip("/").split("/")[0], "query": parts.query or None, "text": squeezed(page(html).body)}


def _gallery_columns(r: Column, url: Column) -> Mapping[str, Column]:
    return {
        "operation": F.lit("sale"),
        "listing_kind": F.when(url.startswith("https"), "agency").otherwise("particular"),
        "_word": r["lang"],
        "current_price": F.lit(None).cast("double"),
        "description": F.coalesce(r["heading"], r["title"]),
        "rooms": F.size(r["links"]),
        "features": F.array_distinct(F.transform(r["links"], lambda x: F.lower(F.element_at(F.split(x, "/"), -1)))),
        "photo_urls": F.slice(r["links"], 1, 3),
    }


def _tracker_columns(r: Column, url: Column) -> Mapping[str, Column]:
    return {
        "operation": F.when(F.coalesce(r["query"], F.lit("")).contains("page="), "rent").otherwise("sale"),
        "listing_kind": F.lit(None).cast("string"),
        "_word": r["section"],
        "current_price": (r["number"] * 100).cast("double"),
        "description": r["text"],
        "rooms": F.when(r["number"] % 6 > 0, r["number"] % 6).cast("int"),
        "features": F.array().cast("array<string>"),
        "photo_urls": F.array().cast("array<string>"),
    }


CONNECTORS: dict[str, Connector] = {
    c.name: c
    for c in (
        Connector("gallery", "example.org", _gallery_page, "title string, heading string, lang string, links array<string>", _gallery_columns, kinds={"es": "piso", "en": "casa", "fr": "terreno"}),
        Connector("tracker", "example.net", _tracker_page, "number long, section string, query string, text string", _tracker_columns, kinds={"en": "piso", "de": "local", "es": "casa"}),
        Connector("captured", "example.com", _tracker_page, "number long, section string, query string, text string", _tracker_columns, supports_discovery=False, kinds={"fr": "garaje"}),
    )
}


def pages(spark: SparkSession, uri: str, sources: list[str] | None = None) -> DataFrame:
    """Raw records of the stored pages of the named sources (default: all)."""
    spark.dataSource.register(ListingPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("listing_pages")
    return (reader.option("sources", ",".join(sources)) if sources else reader).load(uri)


def vocabulary(spark: SparkSession) -> DataFrame:
    """source, word, property_type of all connectors: as many rows as their lists have."""
    return spark.createDataFrame([(c.name, w, k) for c in CONNECTORS.values() for w, k in c.kinds.items()], "source string, word string, property_type string")


def normalize(raw: DataFrame, words: DataFrame, names: list[str] | None = None) -> DataFrame:
    """CANONICAL listings of raw records in one pass: each row by its source's expressions; words that the vocabulary (small,
    broadcast) lacks give no kind. What has no column of its own stays in raw_extra."""
    url, made = F.col("url"), {}
    for c in (CONNECTORS[n] for n in names or CONNECTORS):
        for column, value in c.columns(F.from_json("raw", c.schema), url).items():
            made.setdefault(column, []).append(F.when(F.col("source") == c.name, value))
    rows = raw.select("source", "external_id", "url", F.col("raw").alias("raw_extra"), F.lit("active").alias("status"), *(F.coalesce(*v).alias(k) for k, v in made.items()))
    kinds = words.withColumnRenamed("word", "_word")
    return rows.withColumn("_word", F.lower(F.trim("_word"))).join(F.broadcast(kinds), ["source", "_word"], "left").select(*CANONICAL)


def discovered(raw: DataFrame) -> DataFrame:
    """source, external_id, url: one row per listing of the sources that can be swept, by the least address."""
    names = [c.name for c in CONNECTORS.values() if c.supports_discovery]
    return raw.filter(F.col("source").isin(names)).groupBy("source", "external_id").agg(F.min("url").alias("url"))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Adds source, external_id and raw to rows with url and html: the connector whose host and address pattern fit (else nulls),
    and its raw record (null: no listing)."""
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list[str | None]] = [[], [], []]
            for url, html in zip(batch.column(names.index("url")).to_pylist(), batch.column(names.index("html")).to_pylist(), strict=True):
                found = next(((c, n) for c in CONNECTORS.values() if c.owns(url or "") and (n := c.external_id(url))), None)
                raw = found[0].parse(url, html or "") if found else None
                for column, value in zip(made, (found[0].name, found[1], json.dumps(raw, ensure_ascii=False) if raw is not None else None) if found else (None,) * 3, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in made)], [*names, "source", "external_id", "raw"])

    return pages.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), "source string, external_id string, raw string"]))


def portal_of(url: Column) -> Column:
    """Name of the connector whose host an address is on; null for others."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#:]*)", 1))
    out = F.lit(None).cast("string")
    for c in CONNECTORS.values():
        out = F.when((host == c.host_suffix) | host.endswith("." + c.host_suffix), c.name).otherwise(out)
    return out


def linked_ids(url: Column, html: Column) -> Column:
    """external_ids of the listings that a result page links to, on its own host, in order and once each."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#:]*)", 1))
    links = F.regexp_extract_all(html, F.lit(r'<a href="/(?:[^"?#]*/)?([A-Za-z0-9]+)/?"'), F.lit(1))
    return F.array_distinct(F.transform(links, lambda x: F.concat(host, F.lit(":"), x)))
