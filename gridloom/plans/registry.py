"""The registry of queries: a name, a function of views, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Views over the driver's tables, one text for both engines; {name} is a table.
VIEWS = {
    "px": """SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(l_orderkey % 48 AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x,
       CAST(2465 + 50 * (l_orderkey % 48) AS DOUBLE) / 100 AS lat, CAST(-12475 + 90 * (l_partkey % 64) AS DOUBLE) / 100 AS lon,
       CAST(min(1 + CAST(l_quantity AS INT) % 12) AS INT) AS cls, CAST(min(l_discount) AS DOUBLE) AS v
FROM {lineitem} GROUP BY year(l_shipdate), l_orderkey % 48, l_partkey % 64""",
    "classes": """SELECT CAST(p_size AS INT) AS code, concat('class_', CAST(p_size AS INT)) AS name, CAST(p_size AS INT) IN (3, 7, 11) AS noncrop
FROM {part} WHERE p_size BETWEEN 1 AND 12 GROUP BY p_size""",
    "cube": """SELECT date_trunc('hour', ts) AS t, CAST(user_id % 16 AS INT) AS x, CAST(floor(user_id / 16) AS INT) AS y,
       CAST(-12475 + 360 * (user_id % 16) AS DOUBLE) / 100 AS lon, CAST(2465 + 240 * floor(user_id / 16) AS DOUBLE) / 100 AS lat,
       max(15 + value / 20) AS tc, CAST(max(30 + CAST(event_id % 60 AS INT)) AS DOUBLE) AS rh,
       max(CASE WHEN event_type = 'error' THEN 2.5E0 ELSE 0E0 END) AS mm
FROM {events} GROUP BY date_trunc('hour', ts), user_id % 16, floor(user_id / 16)""",
    "zones": """SELECT n_nationkey AS id, n_name AS name, r_name AS region,
       CAST(-125 + 12 * (n_nationkey % 5) AS DOUBLE) AS w, CAST(24 + 5 * floor(n_nationkey / 5) AS DOUBLE) AS s,
       CAST(-113 + 12 * (n_nationkey % 5) AS DOUBLE) AS e, CAST(29 + 5 * floor(n_nationkey / 5) AS DOUBLE) AS n
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "fields": """SELECT s_suppkey AS id, CAST(-12400 + 97 * (s_suppkey % 56) AS DOUBLE) / 100 AS cx, CAST(2500 + 41 * (s_suppkey % 53) AS DOUBLE) / 100 AS cy,
       CAST(6013 + 100 * (s_suppkey % 140) AS DOUBLE) / 10000 AS r FROM {supplier}""",
    "buildings": """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS class,
       CAST(-12471 + 13 * (c_custkey % 431) AS DOUBLE) / 100 AS cx, CAST(2469 + 17 * (c_custkey % 139) AS DOUBLE) / 100 AS cy,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_acctbal AS DOUBLE) / 100 END AS height, CASE WHEN c_custkey % 3 = 1 THEN CAST(1 + c_custkey % 9 AS INT) END AS num_floors,
       c_custkey % 17 = 0 AS underground FROM {customer}""",
    "hazard": """SELECT p_partkey AS fid, CASE p_partkey % 5 WHEN 0 THEN 'VE' WHEN 1 THEN 'AE' WHEN 2 THEN 'X' WHEN 3 THEN 'D' ELSE 'X' END AS zone,
       CASE p_partkey % 5 WHEN 2 THEN '0.2 PCT ANNUAL CHANCE' END AS subty,
       CAST(-12480 + 29 * (p_partkey % 197) AS DOUBLE) / 100 AS w, CAST(2460 + 23 * (p_partkey % 103) AS DOUBLE) / 100 AS s,
       CAST(-12430 + 29 * (p_partkey % 197) AS DOUBLE) / 100 AS e, CAST(2510 + 23 * (p_partkey % 103) AS DOUBLE) / 100 AS n FROM {part}""",
}
TABLES = {"px": ["lineitem"], "classes": ["part"], "cube": ["events"], "zones": ["nation", "region"], "fields": ["supplier"], "buildings": ["customer"], "hazard": ["part"]}


class Views:
    """The views and tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.spark.sql(VIEWS[name], **{t: getattr(self, t) for t in TABLES[name]})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def cell_sql(level: int, lat: str = "lat", lon: str = "lon") -> str:
    rows, cols = 1 << level, 2 << level
    row = f"least({rows - 1}, greatest(0, CAST(floor((1 + sin(radians({lat}))) / 2 * {rows}) AS BIGINT)))"
    col = f"least({cols - 1}, greatest(0, CAST(floor(({lon} + 180) / 360 * {cols}) AS BIGINT)))"
    return f"(CAST({level} AS BIGINT) * 288230376151711744 + {row} * 536870912 + {col})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Registers a function of Views under a name; sql may use the named views."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            text = sql.strip()
            ctes = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES[v]})})" for v in views.split()]
            recursive = text.upper().startswith("WITH RECURSIVE")
            if ctes:
                head = "WITH RECURSIVE " if recursive else "WITH "
                rest = text[len("WITH RECURSIVE ") :] if recursive else text[5:] if text.upper().startswith("WITH ") else None
                text = head + ", ".join(ctes) + (", " + rest if rest is not None else " " + text)
            ORACLES[name] = text
        return f

    return register
