"""Merging copies of a table: the newest row of every key wins, and what each copy lacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .current import EDGE, NODE, current_rows, decoded


def merge_copies(*copies: DataFrame, keys=EDGE, fields=("position", "count")) -> DataFrame:
    """One row per key over all copies: the greatest updated_at, then the greatest state. Empty copies add nothing."""
    cols = [*keys, "updated_at", "state", *fields]
    return decoded(current_rows(reduce(DataFrame.unionByName, [c.select(*cols) for c in copies]), keys, fields))


def stale_rows(copy: DataFrame, merged: DataFrame, keys=EDGE) -> DataFrame:
    """Merged rows that ``copy`` lacks or has older: what a repair writes to it."""
    own = decoded(current_rows(copy, keys)).select(*keys, "updated_at", "state")
    same = [merged[k] == own[k] for k in keys] + [merged[c].eqNullSafe(own[c]) for c in ("updated_at", "state")]
    return merged.join(own, same, "left_anti")


def merge_nodes(*copies: DataFrame) -> DataFrame:
    return merge_copies(*copies, keys=NODE, fields=("count",))


def stale_nodes(copy: DataFrame, merged: DataFrame) -> DataFrame:
    """Merged nodes that ``copy`` lacks or has older."""
    return stale_rows(copy, merged, NODE)


def nodes_as_ops(rows: DataFrame) -> DataFrame:
    """Node rows (graph_id, source_id, state, updated_at and, unless forward, direction) as mass operations that bring the
    node to its state again: the schema of operations, seq left to the caller."""
    forward = F.col("direction") == 0 if "direction" in rows.columns else F.lit(True)
    op = F.when(F.col("state") == 0, 1).when(F.col("state") == 1, 2).when(F.col("state") == 2, 3).when(F.col("state") == 3, 4)
    return rows.select("graph_id", "source_id", forward.alias("is_forward"), F.lit(None).cast("array<long>").alias("destination_ids"), op.alias("op"), F.lit(None).cast("long").alias("position"), F.col("updated_at").alias("execute_at"))


def as_ops(rows: DataFrame) -> DataFrame:
    """Edge rows as operations that write them again: the schema of operations, seq left to the caller."""
    op = F.when(F.col("state") == 0, 1).when(F.col("state") == 1, 2).when(F.col("state") == 2, 3).when(F.col("state") == 3, 4)
    return rows.select("graph_id", "source_id", F.lit(True).alias("is_forward"), F.array("destination_id").alias("destination_ids"), op.alias("op"), "position", F.col("updated_at").alias("execute_at"))
