"""The library's data model over the driver's tables, in the DataFrame API and as SQL for the comparison.

A page is an order, its issue the customer, its year the order's; a face is a line item with a whole-number box, a coder
(h or p by line number) and labels from its flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    x1, y1 = (c("l_partkey") % 40) * 2, (c("l_suppkey") % 40) * 2
    return read(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("image_id"),
        (c("l_suppkey") % 3).cast("int").alias("ad"),
        (c("l_partkey") * 100000 + c("l_suppkey") * 10 + c("l_linenumber")).alias("id"),
        F.when(c("l_linenumber") % 2 == 1, "h").otherwise("p").alias("coder"),
        x1.cast("int").alias("x1"),
        y1.cast("int").alias("y1"),
        (x1 + 10 + c("l_quantity")).cast("int").alias("x2"),
        (y1 + 10 + 2 * F.round(c("l_discount") * 100)).cast("int").alias("y2"),
        F.when(c("l_returnflag") == "R", "yes").when(c("l_returnflag") == "A", "no").otherwise("not_assessable").alias("smile"),
        F.when(c("l_linestatus") == "O", "feminine").otherwise("masculine").alias("gender"),
        (1 + F.round(c("l_tax") * 100) % 4).cast("int").alias("intensity"),
        (c("l_quantity") % 4).cast("int").alias("legibility"),
        ((c("l_partkey") % 101).cast("double") / 100).alias("confidence"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("issue"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("medium"))


FACES = """faces AS (SELECT l_orderkey AS image_id, CAST(l_suppkey % 3 AS INTEGER) AS ad, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS id,
  CASE WHEN l_linenumber % 2 = 1 THEN 'h' ELSE 'p' END AS coder, CAST((l_partkey % 40) * 2 AS INTEGER) AS x1, CAST((l_suppkey % 40) * 2 AS INTEGER) AS y1,
  CAST((l_partkey % 40) * 2 + 10 + l_quantity AS INTEGER) AS x2, CAST((l_suppkey % 40) * 2 + 10 + 2 * round(l_discount * 100) AS INTEGER) AS y2,
  CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'no' ELSE 'not_assessable' END AS smile, CASE l_linestatus WHEN 'O' THEN 'feminine' ELSE 'masculine' END AS gender,
  CAST(1 + round(l_tax * 100) % 4 AS INTEGER) AS intensity, CAST(l_quantity % 4 AS INTEGER) AS legibility, CAST(l_partkey % 101 AS DOUBLE) / 100 AS confidence FROM lineitem)"""
PAGES = """pages_ AS (SELECT o_orderkey AS image_id, o_custkey AS issue, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS medium FROM orders)"""
#: intersection, areas, IoU and containment of boxes a and b with integer corners
PAIRS = """pairs_ AS (SELECT *, CASE WHEN ar_a + ar_b - inter > 0 THEN inter / (ar_a + ar_b - inter) ELSE 0.0::DOUBLE END AS iou, CASE WHEN least(ar_a, ar_b) > 0 THEN inter / least(ar_a, ar_b) ELSE 0.0::DOUBLE END AS containment FROM (
  SELECT h.image_id, h.id AS a, p.id AS b,
    CAST(greatest(0, least(h.x2, p.x2) - greatest(h.x1, p.x1)) AS DOUBLE) * greatest(0, least(h.y2, p.y2) - greatest(h.y1, p.y1)) AS inter,
    CAST(h.x2 - h.x1 AS DOUBLE) * (h.y2 - h.y1) AS ar_a, CAST(p.x2 - p.x1 AS DOUBLE) * (p.y2 - p.y1) AS ar_b
  FROM faces h JOIN faces p USING (image_id) WHERE h.coder = 'h' AND p.coder = 'p'))"""


def with_(*parts: str) -> str:
    """WITH of all parts but the last, which is the query."""
    *ctes, body = parts
    return "WITH " + ",\n".join(ctes) + "\n" + body
