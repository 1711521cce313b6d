"""Where query modules register their queries, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: All timestamps of the driver tables are without zone; the session's zone is UTC.
AS_OF = "2024-01-31 00:00:00"
#: A unique order of the lines of an order table.
LINE_ORDER = ("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Properties: parts with coordinates made from their key, rooms and a ground-floor flag."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        "p_type",
        "p_size",
        F.col("p_retailprice").alias("price"),
        (36 + (F.col("p_partkey") * 7919 % 70000) / 10000.0).alias("lat"),
        (-9 + (F.col("p_partkey") * 104729 % 120000) / 10000.0).alias("lon"),
        (F.col("p_size") % 6).alias("rooms"),
        (F.col("p_size") % 2 == 0).alias("ground"),
    )


PARTS_SQL = """(SELECT p_partkey AS id, p_type, p_size, p_retailprice AS price, 36 + (p_partkey * 7919 % 70000) / 10000::DOUBLE AS lat,
  -9 + (p_partkey * 104729 % 120000) / 10000::DOUBLE AS lon, p_size % 6 AS rooms, p_size % 2 = 0 AS ground FROM part)"""


def km_sql(a: str, b: str) -> str:
    return f"""6371 * acos(least(1.0, greatest(-1.0, cos(radians({a}.lat)) * cos(radians({b}.lat)) * cos(radians({b}.lon) - radians({a}.lon))
      + sin(radians({a}.lat)) * sin(radians({b}.lat)))))"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with a zoned timestamp (UTC) beside the plain one."""
    return table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
