"""Queries of the training-data problems over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lattice as L
from ..operators.current import EDGE, NODE, current_rows
from ..sources.tables import table
from . import encode, mix, overlap, residue, topn

#: Sets of problem 1: least size, and least part of shared identifiers among all of the two.
LARGE, SHARED = 40, 0.25
#: Edges kept per source by problem 3.
BEST = 5


def _normal_edges(spark: SparkSession, sf: str, fields=()) -> DataFrame:
    rows = current_rows(table(spark, sf, "graph_edges"), EDGE, fields)
    return rows.filter(L.rank_state("rank") == L.NORMAL).drop("rank")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = overlap.overlap_sizes(_normal_edges(spark, sf), least=LARGE, share=SHARED)
    return pairs.select("graph_id", F.col("set_a").alias("source_a"), F.col("set_b").alias("source_b"))


def p1_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    pairs = overlap.overlap_sizes(_normal_edges(spark, sf), least=LARGE)
    return pairs.withColumnsRenamed({"set_a": "source_a", "set_b": "source_b"})


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n(_normal_edges(spark, sf, ["position"]), list(NODE), ["-position", "-destination_id"], BEST).select(*EDGE)


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf, "documents"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return mix.mix_shares(mix.mix_sources(table(spark, sf, "documents"), targets), targets)


def p8_attained(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return mix.mix_attained(mix.mix_sources(table(spark, sf, "documents"), targets), targets)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_documents(table(spark, sf, "documents"))


def p9_passages(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_passages(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_overlaps, p3_found, p7_ids, p8_mix, p8_shares, p8_attained, p9_found, p9_passages)}

_NORMAL = """WITH cur AS (SELECT graph_id, source_id, destination_id, max({'r': updated_at * 8 + CASE state WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 2 THEN 3 WHEN 1 THEN 4 ELSE 0 END, 'k': position IS NOT NULL, 'p': coalesce(position, 0)}) AS m
  FROM graph_edges WHERE graph_id IS NOT NULL AND source_id IS NOT NULL AND destination_id IS NOT NULL GROUP BY ALL),
e AS (SELECT graph_id, source_id, destination_id, CASE WHEN m.k THEN m.p END AS position FROM cur WHERE m.r % 8 = 1)"""

_PAIRS = _NORMAL + f""", big AS (SELECT graph_id, source_id, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= {LARGE}),
m AS (SELECT e.graph_id, e.source_id, destination_id, n FROM e JOIN big ON big.graph_id = e.graph_id AND big.source_id = e.source_id),
p AS (SELECT a.graph_id, a.source_id AS source_a, b.source_id AS source_b, a.n AS size_a, b.n AS size_b, count(*) AS shared
  FROM m a JOIN m b ON a.graph_id = b.graph_id AND a.destination_id = b.destination_id AND a.source_id < b.source_id GROUP BY ALL)
"""

SQL = {
    "p1_found": _PAIRS + f"SELECT graph_id, source_a, source_b FROM p WHERE shared >= {SHARED} * (size_a + size_b - shared)",
    "p1_overlaps": _PAIRS + "SELECT * FROM p",
    "p8_attained": """WITH d AS (SELECT DISTINCT source FROM documents WHERE length(text) > 0), t AS (SELECT mix_id, t.source, CASE WHEN d.source IS NULL THEN 0 ELSE target_share END AS s FROM mix_targets t LEFT JOIN d ON d.source = t.source)
SELECT mix_id, source, round(s / sum(s) OVER (PARTITION BY mix_id), 6) AS attainable, true AS near, true AS within_cap FROM t""",
    "p3_found": _NORMAL + f"SELECT graph_id, source_id, destination_id FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, source_id ORDER BY position DESC NULLS LAST, destination_id DESC) AS k FROM e) WHERE k <= {BEST}",
}
