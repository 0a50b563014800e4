"""Graphs from the driver's star-schema tables, as rows of operations.

1 interactions: user -> key of an event. 2 purchases: customer -> part of an order line. 3 supplies: supplier -> part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lattice as L
from ..functions import position
from ..operators.current import EDGE
from ..sources.tables import table

LOW_BITS = (1 << position.BITS) - 1


def _at(millis, low):
    return position.encode(millis) + low.bitwiseAND(F.lit(LOW_BITS))


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type").isin("click", "purchase"), 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "error", 3)
    rows = e.select(F.lit(1).alias("graph_id"), F.col("user_id").alias("source_id"), F.get_json_object("props", "$.k").cast("long").alias("destination_id"), F.col("event_id").alias("seq"),
                    F.lit(0).cast("long").alias("idx"), L.rank_of(F.unix_seconds("ts"), kind).alias("rank"), _at(F.unix_millis("ts"), F.col("event_id")).alias("pos"))
    return rows.dropna(subset=list(EDGE))


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    o, i = table(spark, sf, "orders"), table(spark, sf, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    kind = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 3)
    rank = L.rank_of(F.unix_seconds("l_shipdate"), kind)
    j = i.join(o, i["l_orderkey"] == o["o_orderkey"])
    # lines that share order and number are told apart by their rank; with equal ranks they are the same operation
    rows = j.select(F.lit(2).alias("graph_id"), F.col("o_custkey").alias("source_id"), F.col("l_partkey").alias("destination_id"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"), rank.alias("idx"), rank.alias("rank"), _at(F.unix_millis("l_shipdate"), F.col("l_orderkey")).alias("pos"))
    return rows.dropna(subset=list(EDGE))


def supplies(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct edges of graph 3, all Normal."""
    i = table(spark, sf, "lineitem")
    return i.select(F.lit(3).alias("graph_id"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("destination_id")).dropna().distinct()


OPS_SQL = {
    1: """SELECT CAST(1 AS INT) AS graph_id, user_id AS source_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS destination_id, event_id AS seq, CAST(0 AS BIGINT) AS idx,
  epoch_us(ts) // 1000000 * 8 + CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 ELSE 0 END AS r,
  epoch_us(ts) // 1000 * 1048576 + (event_id & 1048575) AS pos FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL""",
    2: """SELECT CAST(2 AS INT) AS graph_id, o_custkey AS source_id, l_partkey AS destination_id, l_orderkey * 16 + l_linenumber AS seq, r AS idx, r, epoch_us(l_shipdate) // 1000 * 1048576 + (l_orderkey & 1048575) AS pos
  FROM (SELECT *, epoch_us(l_shipdate) // 1000000 * 8 + CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 3 WHEN 'R' THEN 4 ELSE 0 END AS r FROM lineitem) JOIN orders ON l_orderkey = o_orderkey""",
}


def edges_sql(graph: int, name: str = "e") -> str:
    """CTEs that end with ``name``: the folded forward edges of a graph, with r, the packed time and state."""
    return f"""ops{graph} AS ({OPS_SQL[graph]}),
w{graph} AS (SELECT *, max(r) OVER (PARTITION BY graph_id, source_id, destination_id ORDER BY seq, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ops{graph}),
g{graph} AS (SELECT graph_id, source_id, destination_id, max(r) AS r, max({{'s': seq, 'i': idx, 'p': pos}}) FILTER (p IS NULL OR (r >= p AND r % 8 = 1 AND p % 8 IN (2, 4))) AS m FROM w{graph} GROUP BY ALL),
{name} AS (SELECT graph_id, source_id, destination_id, m.p AS position, r // 8 AS updated_at, CAST(0 AS INT) AS count, CAST(CASE r % 8 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS INT) AS state, r FROM g{graph})"""
