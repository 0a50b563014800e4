"""Stored node counts held against the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lattice as L
from .current import EDGE, NODE, current_rows
from .skew import heavy_keys, salted_aggregate


def edge_counts(edges: DataFrame) -> DataFrame:
    """Number of current edges per (graph_id, source_id, state): graph_id, source_id, state, edges.

    Current edges lie spread by their whole key, so the first, per-salt stage never sees a hot source in one task.
    """
    now = current_rows(edges, EDGE).select(*EDGE, L.rank_state("rank").alias("state"))
    heavy = heavy_keys(edges.dropna(subset=list(EDGE)), NODE)
    return salted_aggregate(now, NODE, {"edges": ("count", None)}, by=["state"], spread=["destination_id"], heavy=heavy)


def drifted_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose current count is null or not the number of current edges in the node's own current state.

    graph_id, source_id, state, count, edges. A node without such edges has 0; a null node state matches edges with a
    null state. Nodes with a null key take no part.
    """
    n = current_rows(nodes, NODE, ["count"]).select(*NODE, L.rank_state("rank").alias("state"), "count")
    c = edge_counts(edges).select(*NODE, F.col("state").alias("edge_state"), "edges")
    key = [n[k] == c[k] for k in NODE]
    j = n.join(c, [*key, n["state"].eqNullSafe(c["edge_state"])], "left").select(*[n[k] for k in NODE], "state", "count", F.coalesce("edges", F.lit(0)).alias("edges"))
    return j.filter(F.col("count").isNull() | (F.col("count") != F.col("edges")))
