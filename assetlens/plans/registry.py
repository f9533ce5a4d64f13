"""Registration of queries and the stand-in tables that they read."""

from __future__ import annotations

from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's tables, and the register's concepts on top of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def folder(self, name: str) -> str:
        """A new folder below ``spark.checkpoint.dir``; a local session without it (tests) gets a temporary one."""
        return shared_folder(self.spark, name)

    @cached_property
    def sites(self) -> DataFrame:
        return self.region.selectExpr("r_regionkey AS id", "r_name AS code")

    @cached_property
    def bays(self) -> DataFrame:
        return self.nation.selectExpr("n_nationkey AS id", "n_regionkey AS site_id", "n_name AS code")

    @cached_property
    def devices(self) -> DataFrame:
        return self.customer.selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS bay_id", "c_name AS code", "c_mktsegment AS kind", "c_nationkey AS bay_key")

    @cached_property
    def sheets(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey AS id", "o_custkey AS device_id", "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ISSUED' ELSE 'RECEIVED' END AS status",
            "o_orderdate AS created_at", "o_orderkey % 100 AS created_by", "o_orderkey % 97 AS assigned_to", "o_orderkey % 89 AS supervisor", "o_orderpriority AS title",
        )

    @cached_property
    def parameters(self) -> DataFrame:
        """Parameters of a sheet with a place that orders repeated codes."""
        place = "struct(l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS place"
        return self.lineitem.selectExpr("l_orderkey AS sheet_id", "CAST(l_linenumber AS STRING) AS code", "CAST(l_quantity AS STRING) AS value", place)

    @cached_property
    def users(self) -> DataFrame:
        return self.supplier.selectExpr("s_suppkey AS id", "s_name AS name", "s_nationkey % 5 AS site_id")

    @cached_property
    def blocks(self) -> DataFrame:
        """Lines of the documents as text blocks of a page: 20 units a line, 7 a character."""
        lines = self.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
        return lines.selectExpr(
            "doc_id AS document_id", "CAST(line DIV 40 + 1 AS INT) AS page_number", "line AS block_id", "raw AS text",
            "CAST(20 * (line % 3) AS DOUBLE) AS x1", "CAST(20 * (line % 40) AS DOUBLE) AS y1",
            "CAST(20 * (line % 3) + 7 * least(length(raw), 120) AS DOUBLE) AS x2", "CAST(20 * (line % 40) + 12 + line % 7 AS DOUBLE) AS y2",
        ).filter("text <> ''")


#: The same tables in SQL: names and the bodies of their WITH clauses.
VIEWS = {
    "sites": "SELECT r_regionkey AS id, r_name AS code FROM region",
    "bays": "SELECT n_nationkey AS id, n_regionkey AS site_id, n_name AS code FROM nation",
    "devices": "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS bay_id, c_name AS code, c_mktsegment AS kind, c_nationkey AS bay_key FROM customer",
    "sheets": "SELECT o_orderkey AS id, o_custkey AS device_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ISSUED' ELSE 'RECEIVED' END AS status, o_orderdate AS created_at, o_orderkey % 100 AS created_by, o_orderkey % 97 AS assigned_to, o_orderkey % 89 AS supervisor, o_orderpriority AS title FROM orders",
    "parameters": "SELECT l_orderkey AS sheet_id, l_linenumber::VARCHAR AS code, l_quantity::VARCHAR AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS place FROM lineitem",
    "users": "SELECT s_suppkey AS id, s_name AS name, s_nationkey % 5 AS site_id FROM supplier",
    "blocks": "SELECT doc_id AS document_id, (line // 40 + 1)::INTEGER AS page_number, line::INTEGER AS block_id, raw AS text, (20 * (line % 3))::DOUBLE AS x1, (20 * (line % 40))::DOUBLE AS y1, (20 * (line % 3) + 7 * least(length(raw), 120))::DOUBLE AS x2, (20 * (line % 40) + 12 + line % 7)::DOUBLE AS y2 FROM (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE raw <> ''",
}


def with_views(sql: str) -> str:
    """``sql`` (a SELECT, or further WITH parts and a SELECT after ``;``) preceded by the views that it names."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    parts, _, select = sql.rpartition(";")
    parts = parts.strip()
    word = "WITH RECURSIVE" if parts.startswith("RECURSIVE ") else "WITH"
    both = ", ".join(x for x in (head, parts.removeprefix("RECURSIVE ")) if x)
    return (f"{word} {both} " if both else "") + select.strip()


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL if there is one."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add
