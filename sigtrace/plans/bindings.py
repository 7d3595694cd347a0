"""Evidence tables derived from the driver's tables, in SQL both engines understand.

Every view reads whole tables and grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_REF = ("concat(CASE {k} % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'R' WHEN 2 THEN 'L' WHEN 3 THEN 'Q' "
        "WHEN 4 THEN 'IC' WHEN 5 THEN 'D' ELSE '{last}' END, CAST({n} AS STRING))")


def _ref(k: str, n: str, last: str = "FI") -> str:
    return _REF.format(k=k, n=n, last=last)


PAGE_W, PAGE_H = 64, 48

VIEWS = {
    "v_box": """
        SELECT p_partkey AS ord, p_brand AS page_id,
               CASE p_partkey % 5 WHEN 0 THEN 'cap' WHEN 1 THEN 'circle' WHEN 2 THEN 'ic'
                                  WHEN 3 THEN 'line' ELSE 'diode' END AS kind,
               (p_partkey * 7919) % 4800 AS x0, (p_partkey * 10473) % 6300 AS y0,
               5 + (p_partkey * 31) % 200 AS w, CAST(5 + p_size * 3 AS BIGINT) AS h,
               (5 + (p_partkey * 31) % 200) * (5 + p_size * 3) * (50 + p_partkey % 50) / 1e2 AS area,
               p_retailprice AS score
        FROM part""",
    "v_symbol": "SELECT page_id, ord, kind AS sym, x0 AS x, y0 AS y FROM v_box",
    "v_label": f"""
        SELECT o_orderkey AS ord, concat('Brand#', CAST(o_orderkey % 25 + 1 AS STRING)) AS page_id,
               {_ref('o_orderkey', 'o_orderkey % 400')} AS refdes,
               (o_orderkey * 6151 + o_custkey * 101) % 4800 AS x,
               (o_orderkey * 9973 + o_custkey * 37) % 6300 AS y, o_totalprice AS weight
        FROM orders""",
    "v_hit": f"""
        SELECT l_orderkey * 1000000 + l_partkey * 100 + l_suppkey * 10 + l_linenumber AS ord,
               CASE l_linestatus WHEN 'F' THEN 'v4' ELSE 'v6' END AS engine,
               CASE l_returnflag WHEN 'A' THEN 'top' WHEN 'N' THEN 'bot' ELSE 'sch' END AS view_name,
               {_ref('l_partkey', 'l_partkey % 300')} AS text, l_discount * 10 AS conf,
               CASE l_linenumber % 3 WHEN 0 THEN 200 WHEN 1 THEN 300 ELSE 600 END AS src_dpi,
               (l_partkey * 37 + l_suppkey) % 1600 AS x, (l_partkey * 53 + l_linenumber) % 2100 AS y,
               CAST(l_suppkey AS BIGINT) AS device
        FROM lineitem""",
    "v_anchor": f"""
        SELECT s_suppkey AS ord, {_ref('s_suppkey', 's_suppkey % 300')} AS refdes,
               CASE s_suppkey % 2 WHEN 0 THEN 'top' ELSE 'bot' END AS view_name,
               (s_suppkey * 97) % 4800 AS x, (s_suppkey * 89) % 6300 AS y, CAST(s_suppkey AS BIGINT) AS device
        FROM supplier""",
    "v_chain": f"""
        SELECT conv_id AS chain_id, turn AS idx, role AS type,
               {_ref('(conv_id + turn)', '(conv_id * 8 + turn) % 400', 'F1')} AS refdes,
               CAST(conv_id AS BIGINT) AS device
        FROM conversations""",
    "v_pixel": f"""
        SELECT l_suppkey AS page_id, l_orderkey % {PAGE_W} AS x, l_partkey % {PAGE_H} AS y,
               max((l_orderkey * 13 + l_partkey) % 256) AS b, max((l_partkey * 7 + l_suppkey) % 256) AS g,
               max((l_orderkey * 5 + l_suppkey * 3) % 256) AS r
        FROM lineitem
        GROUP BY l_suppkey, l_orderkey % {PAGE_W}, l_partkey % {PAGE_H}""",
    "v_spot": f"""
        SELECT CAST((ord - ord % 20) / 20 AS BIGINT) AS page_id, ord, kind AS sym,
               x0 % {PAGE_W} AS x, y0 % {PAGE_H} AS y, w, h FROM v_box""",
    "v_region": """
        SELECT c_custkey AS ord, CAST(c_nationkey AS BIGINT) AS page_id, (c_custkey % 37) * 22 AS x0,
               (CAST(floor(c_acctbal) AS BIGINT) + 10000) % 9 * 14 AS y0,
               20 + (c_custkey % 3) AS w, CAST(12 AS BIGINT) AS h,
               CAST((20 + (c_custkey % 3)) * 9 AS BIGINT) AS area
        FROM customer""",
    "v_segment": """
        SELECT o_orderkey AS ord, concat('Brand#', CAST(o_orderkey % 25 + 1 AS STRING)) AS page_id,
               CASE (o_orderkey * 7 + o_custkey) % 2 WHEN 0 THEN 'h' ELSE 'v' END AS axis,
               CAST(floor(o_totalprice) AS BIGINT) % 300 * 5 AS pos,
               (o_orderkey * 6151 + o_custkey * 13) % 1200 AS lo,
               (o_orderkey * 6151 + o_custkey * 13) % 1200 + 10 + (o_custkey % 7) * 15 AS hi
        FROM orders""",
    "v_legend": """
        SELECT r_name AS label, (r_regionkey * 53) % 256 AS b, (r_regionkey * 97 + 40) % 256 AS g,
               (r_regionkey * 151 + 80) % 256 AS r FROM region""",
    "v_truth": """
        SELECT user_id AS fact, ts, event_id AS seq,
               CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'ok' WHEN 'signup' THEN 'conflict'
                               WHEN 'error' THEN 'fail' ELSE 'human' END AS kind
        FROM events""",
    "v_round": """
        SELECT CAST(ts AS DATE) AS round, event_type AS method, count(*) AS main_cc,
               round(sum(value), 2) AS main_kept, count(DISTINCT user_id) AS wide
        FROM events GROUP BY CAST(ts AS DATE), event_type""",
}


def _uses(sql: str, names) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [n for n in names if n in words]


def _needed(names) -> list[str]:
    """Views in the order they build on each other."""
    order: list[str] = []
    for name in names:
        for dep in _needed(_uses(VIEWS[name], [v for v in VIEWS if v != name])):
            if dep not in order:
                order.append(dep)
        if name not in order:
            order.append(name)
    return order


def oracle(body: str, recursive: bool = False) -> str:
    """A query over the views as one statement."""
    own = body.strip()
    parts = [f"{v} AS ({VIEWS[v].strip()})" for v in _needed(_uses(own, VIEWS))]
    word = "WITH RECURSIVE " if recursive else "WITH "
    if own.startswith("WITH "):
        return word + ", ".join([*parts, own[5:]])
    return (word + ", ".join(parts) + " " if parts else "") + own


class Evidence:
    """The driver's tables and the views over them as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run SQL over views and tables without leaving names behind."""
        args = {n: self.table(n) for n in _uses(text, TABLES)}
        args |= {n: getattr(self, n) for n in _uses(text, VIEWS)}
        marked = re.sub(r"\b(" + "|".join(args) + r")\b", r"{\1}", text)
        return self.spark.sql(marked, **args)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)


__all__ = ["Evidence", "TABLES", "VIEWS", "oracle"]
