"""References to records that do not exist, from signed counts of references and existence.

Method: every change is a signed delta of a key. An edge adds one reference to each node it names; a node row makes its
node exist, and a current state Removed takes that existence back. Keys with positive references and no existence are
orphaned; so are keys that came to exist after a reference to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lattice as L
from ..functions.session import written
from .current import EDGE, NODE, current_rows
from .skew import HEAVY, SALTS, salted_join

#: References from which on a key may be one of the heavy ones.
HEAVY_REFS = 10_000
ENDS = ("source_id", "destination_id")
COUNTS = ("graph_id", "node", "refs", "rows", "existing", "first_ref", "arrived")


def references(edges: DataFrame) -> DataFrame:
    """Two rows per current edge: graph_id, node, other, is_source (whether node is the source), rank, arrived."""
    e = current_rows(edges, EDGE, arrival=True)
    ends = F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(a == "source_id").alias("is_source")) for a, b in (ENDS, ENDS[::-1])])
    return e.select("graph_id", F.inline(ends), "rank", "arrived")


def reference_deltas(refs: DataFrame) -> DataFrame:
    """+1 per reference, as deltas for :func:`signed_counts`."""
    z = F.lit(0).cast("long")
    return refs.select("graph_id", "node", F.lit(1).cast("long").alias("refs"), z.alias("rows"), z.alias("existing"), F.col("arrived").alias("first_ref"), F.lit(None).cast("timestamp").alias("arrived"))


def existence_deltas(nodes: DataFrame) -> DataFrame:
    """+1 for the row of a node, and -1 again in ``existing`` if its current state is Removed."""
    n = current_rows(nodes, NODE, arrival=True)
    alive = F.lit(1) - F.coalesce(L.rank_state("rank") == L.REMOVED, F.lit(False)).cast("long")
    return n.select("graph_id", F.col("source_id").alias("node"), F.lit(0).cast("long").alias("refs"), F.lit(1).cast("long").alias("rows"), alive.cast("long").alias("existing"), F.lit(None).cast("timestamp").alias("first_ref"), "arrived")


def signed_counts(*deltas: DataFrame) -> DataFrame:
    """Sums of deltas per (graph_id, node); earlier sums are deltas too, so counts are kept up by adding new deltas."""
    u = deltas[0]
    for d in deltas[1:]:
        u = u.unionByName(d)
    return u.groupBy("graph_id", "node").agg(F.sum("refs").alias("refs"), F.sum("rows").alias("rows"), F.sum("existing").alias("existing"), F.min("first_ref").alias("first_ref"), F.min("arrived").alias("arrived"))


def orphaned() -> Column:
    """Condition on signed counts: positive references to what doesn't exist, is removed, or arrived after a reference."""
    late = F.coalesce(F.col("arrived") > F.col("first_ref"), F.lit(False))
    return (F.col("refs") > 0) & ((F.col("existing") <= 0) | late)


def orphaned_keys(counts: DataFrame) -> DataFrame:
    return counts.filter(orphaned())


def orphan_references(edges: DataFrame, nodes: DataFrame, salts: int = SALTS, most: int = HEAVY, heavy_refs: int = HEAVY_REFS) -> DataFrame:
    """graph_id, source_id, destination_id, field, kind, updated_at: references of current edges that don't hold.

    kind is missing (no such node), else deleted (node Removed and the edge not), else late (the node arrives after the
    edge). Unknown arrivals are never late. Rows with null keys take no part, no nodes at all leave every reference
    missing. The join is only with orphaned keys; the ``most`` most referenced keys of more than
    ``heavy_refs`` references, a bounded list, are salted if orphaned and left out of the join if not.
    """
    refs = references(edges)
    counts = signed_counts(reference_deltas(refs), existence_deltas(nodes))
    # read three times; most keys are neither orphaned nor heavy and aren't kept
    keys = written(counts.withColumn("orphan", orphaned()).filter(F.col("orphan") | (F.col("refs") > heavy_refs)))
    hot = keys.filter(F.col("refs") > heavy_refs).orderBy(F.desc("refs"), "graph_id", "node").limit(most)
    # references to a heavy node that is in order need not be moved to find that out
    refs = refs.join(F.broadcast(hot.filter("not orphan").select("graph_id", "node")), ["graph_id", "node"], "left_anti")
    node = keys.filter("orphan").select("graph_id", "node", "rows", "existing", F.col("arrived").alias("node_arrived"))
    hot = hot.filter("orphan")
    removed = F.coalesce(L.rank_state("rank") == L.REMOVED, F.lit(False))
    kind = F.when(F.col("rows") <= 0, "missing").when((F.col("existing") <= 0) & ~removed, "deleted").when(F.col("node_arrived") > F.col("arrived"), "late")
    j = salted_join(refs, node, ["graph_id", "node"], [F.col("other")], hot, salts).withColumn("kind", kind).filter(F.col("kind").isNotNull())
    end = lambda here, there: F.when(F.col("is_source"), F.col(here)).otherwise(F.col(there))
    return j.select("graph_id", end("node", "other").alias("source_id"), end("other", "node").alias("destination_id"), F.when(F.col("is_source"), ENDS[0]).otherwise(F.lit(ENDS[1])).alias("field"), "kind", L.rank_time("rank").alias("updated_at"))


def orphans_by_month(found: DataFrame, table: str = "graph_edges") -> DataFrame:
    """table, period (yyyy-MM of the edge's updated_at, UTC), field, kind, references: the number of orphans."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("updated_at") / 86400).cast("int"))
    month = F.date_format(day, "yyyy-MM")
    return found.groupBy(F.lit(table).alias("table"), month.alias("period"), "field", "kind").agg(F.count(F.lit(1)).alias("references"))
