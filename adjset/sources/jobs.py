"""Operations as JSON jobs: one edge (Single), a whole node (Multi), copies of tables (Copy, MetadataCopy), and the older tags
that carry the state in their name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lattice as L

#: Fields of all kinds of job; what a job lacks is null.
FIELDS = "source_id long, graph_id int, destination_id long, position long, state int, updated_at long, direction string, priority int, cursor long, write_successes array<array<string>>, cursor1 long, cursor2 long, count int, shards array<struct<hostname: string, table_prefix: string>>"
COPIES = ("copy", "metadatacopy")


def parse_jobs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``{"Tag": {...}}`` to operations plus ``tag``, ``error`` and what else a job carries: ``cursor`` of a Multi,
    ``write_successes`` of a Single, and ``copy`` (cursor, count, shards) of a Copy or MetadataCopy, which has no operation.

    A tag is the last part of a dotted name: Single and Multi carry their state; Add, Archive, Remove, Negate and
    Unarchive, Archive.. RemoveAll forms carry it in the name. A line that isn't such a job has an error and no operation.
    """
    named = F.from_json(F.col(column), "map<string,string>")
    tag = F.element_at(F.split(F.get(F.map_keys(named), 0), r"\."), -1)
    j = lines.select(F.col(column).alias("line"), tag.alias("tag"), F.from_json(F.get(F.map_values(named), 0), FIELDS).alias("j")).select("line", "tag", "j.*")
    name = F.lower(F.col("tag"))
    by_name = F.when(name.startswith("add") | name.startswith("unarchive"), L.ADD).when(name.startswith("removeall") | name.startswith("remove"), L.REMOVE).when(name.startswith("archive"), L.ARCHIVE).when(name.startswith("negate"), L.NEGATE)
    by_state = F.when(F.col("state") == L.NORMAL, L.ADD).when(F.col("state") == L.REMOVED, L.REMOVE).when(F.col("state") == L.ARCHIVED, L.ARCHIVE).when(F.col("state") == L.NEGATIVE, L.NEGATE)
    op = F.coalesce(by_state, by_name)
    forward = F.lower(F.coalesce("direction", F.lit("forward"))).isin("forward", "0")
    copies = name.isin(*COPIES) & F.col("shards").isNotNull()
    bad = ~F.coalesce(copies, F.lit(False)) & (op.isNull() | F.col("source_id").isNull() | F.col("graph_id").isNull())
    # a copy of edges goes on from two ids, a copy of nodes from one
    copy = F.struct(F.coalesce("cursor1", "cursor").alias("cursor1"), "cursor2", "count", "shards")
    return j.select("line", "tag", "graph_id", "source_id", forward.alias("is_forward"), F.when(F.col("destination_id").isNotNull(), F.array("destination_id")).alias("destination_ids"), op.alias("op"),
                    "position", F.col("updated_at").alias("execute_at"), F.coalesce("priority", F.lit(3)).alias("priority"), F.when(bad, F.lit("not a job")).alias("error"), F.when(~F.coalesce(name.isin(*COPIES), F.lit(False)), F.col("cursor")).alias("cursor"), "write_successes", F.when(copies, copy).alias("copy"))


def to_jobs(ops: DataFrame) -> DataFrame:
    """Operations back to lines: one Single per named edge, a Multi for a wildcard, which begins at the start. A direction
    is written as its id, 0 forward and 1 backward."""
    state = L.state_of(L.op_ordinal("op"))
    single = ops.select("source_id", "graph_id", "position", "execute_at", state.alias("state"), F.coalesce("is_forward", F.lit(True)).alias("fwd"), "priority", F.explode_outer("destination_ids").alias("d"), F.col("destination_ids").isNull().alias("mass")).filter(F.col("mass") | F.col("d").isNotNull())
    s, d = F.when(F.col("fwd"), F.col("source_id")).otherwise(F.col("d")), F.when(F.col("fwd"), F.col("d")).otherwise(F.col("source_id"))
    one = F.to_json(F.struct(F.struct(s.alias("source_id"), "graph_id", d.alias("destination_id"), "position", "state", F.col("execute_at").alias("updated_at")).alias("Single")))
    many = F.to_json(F.struct(F.struct("source_id", F.col("execute_at").alias("updated_at"), "graph_id", F.when(F.col("fwd"), 0).otherwise(1).alias("direction"), "priority", "state", F.lit(-1).alias("cursor")).alias("Multi")))
    return single.select(F.when(F.col("mass"), many).otherwise(one).alias("value"))
