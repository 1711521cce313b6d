"""URL filters by a bit-parallel wildcard automaton: all glob rules advance together over each canonical URL.

Every rule is a glob (``*``: any run of characters) over ``.host NUL path``; the dot before the host makes ``*.name``
fit a host and all its subdomains. The rules' characters are packed into 64-bit words; a star is a loop on its state.
One step per character moves all rules of all URLs of a batch (Shift-And).

Of fitting scope rules (host, path) the longest wins; without one, a URL is blocked if any blocking glob fits, else
allowed. Null or a text without ``://``: empty host and path. Repeated rows are judged alike; an empty table gives no
rows; other columns are kept out of the way by selecting the key and the URL alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm.blocks import blocks

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Globs over host and path that block when no rule decides.
GLOBS = ("*.*casino*\0*", "*.*adult*\0*", "*.*xxx*\0*", "*.*porn*\0*", "*.*pills*\0*", "*.*spam*\0*", "*.*viagra*\0*", "*\0*/wp-login*", "*\0*.exe")


class Globs:
    """Bit masks of many globs; ``fits`` simulates them over byte strings."""

    def __init__(self, globs: list[str]):
        where, loops, starts, ends = 0, [], [], []
        step: list[list[int]] = [[] for _ in range(256)]
        for glob in globs:
            starts.append(where)
            where += 1  # the state before the first character; a star loops on the state that it follows
            for c in glob.encode():
                if c == ord("*"):
                    loops.append(where - 1)
                else:
                    step[c].append(where)
                    where += 1
            ends.append(where - 1)
        self.n = (where + 63) // 64
        self.step = np.stack([self.mask(x) for x in step])
        self.loop, self.start, self.ends = self.mask(loops), self.mask(starts), ends

    def mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.n, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def fits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Booleans, row by glob."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        state = np.tile(self.start, (len(size), 1))
        base, sizes = offsets[:-1][order], size[order]
        alive = len(size)
        for i in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[alive - 1] <= i:
                alive -= 1
            now = state[:alive]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:alive] = moved & self.step[data[base[:alive] + i]] | now & self.loop
        out = np.zeros((len(size), len(self.ends)), bool)
        for k, b in enumerate(self.ends):
            out[order, k] = (state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) > 0
        return out


def filter_urls(pages: DataFrame, rules: tuple = RULES, globs: tuple = GLOBS, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (or null), verdict, n_globs (blocking globs that fit)."""
    scoped = [f"*.{host}\0{path}*" for _, host, path in rules]
    names = [f"{host}{path}" for _, host, path in rules]
    rank = np.argsort([-len(x.encode()) for x in names], kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Globs([*scoped, *globs])
        for batch in batches:
            for block in blocks(batch.column(3)):
                fit = machine.fits(block.data, block.offsets)
                rule, decided = np.full(len(fit), -1), np.zeros(len(fit), bool)
                for k in rank:
                    rule[fit[:, k] & ~decided] = k
                    decided |= fit[:, k]
                bad = fit[:, len(scoped) :].sum(axis=1)
                verdict = np.where(decided, np.array([r[0] for r in rules] + [""])[rule], np.where(bad > 0, "block", "allow"))
                own = [batch.column(i).slice(block.lo, block.hi - block.lo) for i in range(3)]
                told = pa.array([names[k] if k >= 0 else None for k in rule.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*own, told, pa.array(verdict.tolist(), pa.string()), pa.array(bad.astype(np.int64))], ["key", "host", "path", "rule", "verdict", "n_globs"])

    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    parts = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    canonical = parts.withColumn("canonical", F.concat(F.lit("."), "host", F.lit("\0"), "path"))
    kind = pages.schema[key].dataType.simpleString()
    out = canonical.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string, n_globs long")
    return out.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}')" for v, h, p in RULES)
_GLOB_TEST = " + ".join([f"(host LIKE '%{w}%')::BIGINT" for w in ("casino", "adult", "xxx", "porn", "pills", "spam", "viagra")] + ["(path LIKE '%/wp-login%')::BIGINT", "(path LIKE '%.exe')::BIGINT"])
SQL = f"""
WITH rules(verdict, rule_host, rule_path, rule) AS (VALUES {_RULE_ROWS}),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path) GROUP BY page_id),
judged AS (SELECT page_id, host, path, rule, verdict, {_GLOB_TEST} AS n_globs FROM parts LEFT JOIN best USING (page_id))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN n_globs > 0 THEN 'block' ELSE 'allow' END) AS verdict, n_globs FROM judged
"""
