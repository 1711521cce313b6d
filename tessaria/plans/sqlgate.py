"""A read-only SQL gateway: guards, tokens, allow-list, cost estimate and caps around spark.sql."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statements and words that change something.
WRITES = "insert update delete drop alter create truncate merge grant revoke copy call set refresh cache uncache load analyze use msck repair add".split()
MAX_ROWS, MAX_COLUMNS, MAX_CHARS, MAX_BYTES, MAX_SECONDS = 200, 30, 20_000, 10 << 30, 15
#: Functions that reach beyond the data.
REACHING = "java_method reflect try_reflect".split()
#: Expressions that run but mislead, with advice.
LINTS = ((r"extract\s*\(\s*days?\b", "use date_diff for whole days"), (r"coalesce\s*\(\s*max\s*\([^)]*\)\s*,\s*'", "compare dates with dates, not with text"))


class Refused(ValueError):
    """The text is not a single read-only statement over allowed tables."""


def stripped(sql: str) -> str:
    """SQL without literals, quoted names and comments."""
    return re.sub(r"(?s)'(?:[^'\\]|''|\\.)*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql)


def check(sql: str) -> None:
    """Refuses all but one SELECT, WITH or EXPLAIN statement without writing words."""
    bare = stripped(sql)
    if ";" in sql:
        raise Refused("one statement, without a semicolon")
    if not re.match(r"(?i)\s*(select|with|explain)\b", bare):
        raise Refused("SELECT, WITH or EXPLAIN only")
    if found := re.search(rf"(?i)\b({'|'.join(WRITES)})\b", bare):
        raise Refused(f"{found[1].lower()} is not allowed")
    if found := re.search(rf"(?i)\b({'|'.join(REACHING)})\b", sql):
        raise Refused(f"{found[1].lower()} is not allowed")
    if re.search(r"(?i)\binto\b", bare):
        raise Refused("SELECT INTO is not allowed")


def lint(sql: str) -> list[str]:
    return [advice for pattern, advice in LINTS if re.search(pattern, sql, re.I)]


def rewrite(sql: str, filters: dict[str, tuple[str, object]], dates: dict[str, str], without: str | None = None) -> tuple[str, dict[str, object]]:
    """Replaces ``__gf_name__`` by TRUE (unset, or ``without`` for the filter's own option list), an equality or an
    array membership, and ``{{name}}`` by a timestamp; values become named arguments."""
    args: dict[str, object] = {}

    def one(m: re.Match) -> str:
        name = m[1]
        column, value = filters.get(name, ("", None))
        if value is None or value == [] or name == without:
            return "TRUE"
        args[f"gf_{name}"] = value
        return f"array_contains(:gf_{name}, {column})" if isinstance(value, list) else f"{column} = :gf_{name}"

    def day(m: re.Match) -> str:
        if m[1] not in dates:
            raise Refused(f"no date {m[1]}")
        args[m[1]] = dates[m[1]]
        return f"CAST(:{m[1]} AS TIMESTAMP)"

    return re.sub(r"\{\{(\w+)\}\}", day, re.sub(r"__gf_(\w+?)__", one, sql)), args


def _relations(plan) -> tuple[set[tuple[str, ...]], set[str]]:
    """Names of all relations of a parsed plan, subqueries included, and the names that its WITH clauses give."""
    used, own, todo = set(), set(), [plan]
    each = lambda xs: (xs.apply(i) for i in range(xs.size()))
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            used.add(tuple(each(node.multipartIdentifier())))
        elif kind == "UnresolvedTableValuedFunction":
            raise Refused("table functions are not allowed")
        elif kind == "UnresolvedWith":
            own |= {x.alias().lower() for x in each(node.innerChildren())}
        for more in (node.children(), node.innerChildren(), node.subqueries()):
            todo += [x for x in each(more) if hasattr(x, "children")]
    return used, own


#: Presets of the time-range picker: days back from today.
PRESETS = {"today": 0, "7d": 7, "30d": 30, "90d": 90, "365d": 365}


def date_range(preset: str, today: str) -> dict[str, str]:
    """date_from and date_to of a preset, and of the period of equal length before it."""
    end = date.fromisoformat(today)
    days = PRESETS[preset]
    start = end - timedelta(days=days)
    return {"date_from": str(start), "date_to": str(end), "before_from": str(start - timedelta(days=days + 1)), "before_to": str(start - timedelta(days=1))}


@dataclass
class Gateway:
    spark: SparkSession
    tables: set[str]
    max_rows: int = MAX_ROWS
    max_bytes: int = MAX_BYTES

    def _plan(self, sql: str, args: dict | None) -> DataFrame:
        check(sql)
        session = self.spark._jsparkSession.sessionState()
        allowed = {t.lower() for t in self.tables}
        used, own = _relations(session.sqlParser().parsePlan(sql))
        bad = set()
        for name in used:
            full = ".".join(name).lower()
            # a name of its own query may not stand for a table that is not allowed; longer names are no such names
            is_own = len(name) == 1 and full in own and not self.spark.catalog.tableExists(name[0])
            if full not in allowed and not is_own or not all(re.fullmatch(r"\w+", x) for x in name):
                bad.add(full)
        if bad:
            raise Refused(f"tables not allowed: {', '.join(sorted(bad))}")
        return self.spark.sql(sql, args={k: self._literal(v) for k, v in (args or {}).items()})

    @staticmethod
    def _literal(value):
        return F.array(*map(F.lit, value)) if isinstance(value, list) else value

    def cost(self, sql: str, args: dict | None = None) -> int:
        """Bytes that the optimised plan is thought to read and make."""
        return int(self._plan(sql, args)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

    def explain(self, sql: str, args: dict | None = None) -> str:
        """The plan; nothing runs."""
        return self._plan(sql, args)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def execute(self, sql: str, args: dict | None = None) -> DataFrame:
        """At most ``max_rows`` rows of MAX_COLUMNS columns, texts cut at MAX_CHARS, if the estimate allows it."""
        df = self._plan(sql, args)
        if self.cost(sql, args) > self.max_bytes:
            raise Refused("the query reads too much")
        if len(df.columns) > MAX_COLUMNS:
            raise Refused(f"more than {MAX_COLUMNS} columns")
        text = lambda f: F.substring(F.col(f"`{f.name}`"), 1, MAX_CHARS).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`")
        if len(set(df.columns)) == len(df.columns):
            df = df.select(*map(text, df.schema.fields))
        return df.limit(self.max_rows)

    def rows(self, sql: str, args: dict | None = None, seconds: int = MAX_SECONDS) -> list:
        """The rows of ``execute``; a query that runs longer than ``seconds`` is cancelled and refused."""
        tag, context = f"gate-{uuid.uuid4().hex}", self.spark.sparkContext
        late = threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            return self.execute(sql, args).collect()
        except Exception as error:
            if late.is_set():
                raise Refused(f"the query takes more than {seconds} seconds") from error
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def scan_warnings(self, sql: str, args: dict | None = None) -> list[str]:
        """Tables that are read whole: a scan to which no filter is pushed."""
        text = self._plan(sql, args)._jdf.queryExecution().executedPlan().toString()
        return sorted({m[0] for m in re.findall(r"(?:FileScan|BatchScan) (\S+?)\[[^\n]*?PushedFilters: \[\]", text)})

    def list_tables(self) -> list[str]:
        return sorted(self.tables)

    def describe(self, name: str) -> list[tuple[str, str]]:
        if name.lower() not in {t.lower() for t in self.tables}:
            raise Refused(f"tables not allowed: {name}")
        return self.spark.table(name).dtypes
