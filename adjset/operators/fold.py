"""Operations folded into edges and nodes, mass operations and node states included.

Operations apply one after another in order of ``seq``. Node states come from mass operations alone, so they are worked
out first; an explicit operation takes the greatest of its own state and the states of both its nodes as of its seq.
Edges that no mass operation touches have a closed form (see :mod:`changefeed`). The others are folded over a sorted
partition, all edges of a batch at once, without gathering the operations of an edge. Nodes that many operations or edges
name are salted where these meet the states and mass operations of nodes.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lattice as L
from ..functions.session import written
from . import changefeed
from .current import EDGE
from .skew import hot_keys, salted_join

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OP = [*EDGE, "seq", "idx", "rank", "pos"]
#: Below every seq; stands for no position, too.
_BEFORE = -(2**63)


def fold_explicit(rows: DataFrame, heavy_ops: int = changefeed.HEAVY_OPS, segment: int = changefeed.SEGMENT) -> DataFrame:
    """Rows (edge key, seq, idx, rank, pos) to edges: graph_id .. state, count 0. Closed form: one shuffle, a window."""
    start = rows.select(*EDGE).limit(0).selectExpr(*EDGE, "0L rank0", "0L pos0", "true known")
    return as_edges(changefeed.images_of(rows.select(*_OP), start, heavy_ops, segment))


def as_edges(images: DataFrame) -> DataFrame:
    return images.select(*EDGE, F.col("pos1").alias("position"), L.rank_time("rank1").alias("updated_at"), F.lit(0).alias("count"), L.rank_state("rank1").alias("state"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge forward and, with its ends swapped, backward; direction 0 and 1. No shuffle."""
    ends = F.array(F.struct(F.lit(0).alias("direction"), F.col("source_id").alias("s"), F.col("destination_id").alias("d")), F.struct(F.lit(1).alias("direction"), F.col("destination_id").alias("s"), F.col("source_id").alias("d")))
    rest = [c for c in edges.columns if c not in EDGE]
    return edges.select("graph_id", *rest, F.inline(ends)).select("graph_id", "direction", F.col("s").alias("source_id"), F.col("d").alias("destination_id"), *rest)


def mass_ops(ops: DataFrame) -> DataFrame:
    """Wildcards: graph_id, direction, node, seq, rank. Of rows delivered again under one seq the one queued first counts,
    and of those the least by the other columns."""
    w = ops.filter(F.col("destination_ids").isNull() & F.col("seq").isNotNull() & F.col("source_id").isNotNull() & L.op_ordinal("op").isNotNull())
    w = w.groupBy("seq").agg(F.min(F.struct("queued_at", "graph_id", "source_id", "is_forward", "op", "execute_at")).alias("o")).select("seq", "o.*")
    t = F.coalesce("execute_at", F.unix_seconds("queued_at"))
    return w.select("graph_id", F.when(F.coalesce("is_forward", F.lit(True)), 0).otherwise(1).alias("direction"), F.col("source_id").alias("node"), "seq", L.rank_of(t, L.op_ordinal("op")).alias("rank"))


def node_timeline(mass: DataFrame) -> DataFrame:
    """State of a node after each mass operation: graph_id, direction, node, seq, rank, node_rank (newest wins)."""
    w = W.partitionBy("graph_id", "direction", "node").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return mass.withColumn("node_rank", F.max("rank").over(w))


def _timelines(timeline: DataFrame) -> DataFrame:
    """Per node the changes of its state, oldest first; an operation that leaves the state as it is isn't kept."""
    w = W.partitionBy("graph_id", "direction", "node").orderBy("seq")
    t = timeline.withColumn("o", L.rank_ordinal("node_rank")).withColumn("was", F.lag("o").over(w)).filter(F.col("was").isNull() | (F.col("was") != F.col("o")))
    return t.groupBy("graph_id", "direction", "node").agg(F.array_sort(F.collect_list(F.struct("seq", "o"))).alias("states"))


def _with_state(rows: DataFrame, counted: DataFrame, lines: DataFrame, direction: int, end: str, other: str, name: str) -> DataFrame:
    """Adds the ordinal of the node at ``end`` as of the row's seq, its own operation included; 0 before any."""
    n = lines.filter(F.col("direction") == direction).select("graph_id", F.col("node").alias(end), "states")
    key = ["graph_id", end]
    j = salted_join(rows, n, key, [F.col(other)], hot_keys(counted, key), how="left")
    past = F.filter("states", lambda x: x["seq"] <= F.col("seq"))
    return j.withColumn(name, F.coalesce(F.when(F.size(past) > 0, F.element_at(past, -1)["o"]), F.lit(0))).drop("states")


def _directions(mass: DataFrame) -> list[int]:
    """Directions that have mass operations: none, one or both."""
    return sorted(r[0] for r in mass.select("direction").distinct().collect())


_ENDS = {0: ("source_id", "destination_id"), 1: ("destination_id", "source_id")}


def dominated(rows: DataFrame, timeline: DataFrame, directions=(0, 1)) -> DataFrame:
    """Explicit operations with the state that applies: the greatest of their own, the source's and the destination's."""
    lines = _timelines(timeline)
    r = rows
    for i in directions:
        r = _with_state(r, rows, lines, i, *_ENDS[i], f"state{i}_")
    names = [f"state{i}_" for i in directions]
    t = F.shiftright("rank", 3)
    return r.withColumn("rank", t * 8 + F.greatest(L.rank_ordinal("rank"), *names) + 1).drop(*names) if names else r


def expanded(mass: DataFrame, keys: DataFrame, timeline: DataFrame, directions=(0, 1)) -> DataFrame:
    """Mass operations as one operation per edge of the node that was named before: EDGE, seq, idx, rank, pos. keys: EDGE,
    first_seq, and ``past``, whether the edge is met by mass operations that aren't ``new``, too."""
    out = []
    for i in directions:
        end, other = _ENDS[i]
        m = mass.filter(F.col("direction") == i).select("graph_id", F.col("node").alias(end), "seq", "rank", "new")
        met = salted_join(keys, m, ["graph_id", end], [F.col(other)], hot_keys(keys, ["graph_id", end]))
        out.append(met.filter((F.col("first_seq") < F.col("seq")) & (F.col("new") | F.col("past"))).select(*EDGE, "seq", F.lit(0).cast("long").alias("idx"), "rank", F.shiftleft(F.shiftright("rank", 3) * 1000, 20).alias("pos")))
    return dominated(written(reduce(DataFrame.unionByName, out)), timeline, directions)


#: Edges of a batch that still have operations, below which numpy's steps cost more than a loop.
_FEW = 16
_FOLDED = "graph_id int, source_id long, destination_id long, rank1 long, pos1 long"


def _fold_sorted(batches):
    """Rows sorted by edge, seq and idx -> one row per edge; ``mass`` rows leave Removed edges alone. Step k applies the
    k-th operation of all edges of the batch at once; the last edge's state is carried into the next batch."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:  # its state so far stands in front, like a first row
            cols = [np.append(np.array([x], c.dtype), c) for x, c in zip(held, cols)]
        g, s, d, rank, pos, mass = cols
        starts = np.append(0, np.flatnonzero((g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (d[1:] != d[:-1])) + 1)
        lens = np.diff(np.append(starts, len(g)))
        cur, at = rank[starts], pos[starts]
        k, left = 1, np.flatnonzero(lens > 1)
        while len(left) >= _FEW:
            i = starts[left] + k
            old, new = cur[left], rank[i]
            ok = (new >= old) & ~(mass[i] & (old % 8 == 4))
            moved = ok & (new % 8 == 1) & ((old % 8 == 2) | (old % 8 == 4))
            cur[left], at[left] = np.where(ok, new, old), np.where(moved, pos[i], at[left])
            k += 1
            left = left[lens[left] > k]
        for e in left.tolist():
            part = slice(starts[e] + k, starts[e] + lens[e])
            old, p = int(cur[e]), int(at[e])
            for new, q, m in zip(rank[part].tolist(), pos[part].tolist(), mass[part].tolist()):
                if new >= old and not (m and old % 8 == 4):
                    p = q if new % 8 == 1 and old % 8 in (2, 4) else p
                    old = new
            cur[e], at[e] = old, p
        done = [c[starts] for c in (g, s, d)] + [cur, at]
        held = [c[-1] for c in done] + [False]
        if len(starts) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in done], names=[*EDGE, "rank1", "pos1"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([x])) for x in held[:5]], names=[*EDGE, "rank1", "pos1"])


def _folded(rows: DataFrame) -> DataFrame:
    """Rows (edge key, seq, idx, rank, pos, mass) folded; no position is a number below all others on the way."""
    ordered = rows.withColumn("pos", F.coalesce("pos", F.lit(_BEFORE))).repartition(*EDGE).sortWithinPartitions(*EDGE, "seq", "idx", "rank")
    folded = ordered.select(F.col("graph_id").cast("int").alias("graph_id"), *EDGE[1:], "rank", "pos", "mass").mapInArrow(_fold_sorted, _FOLDED)
    return folded.withColumn("pos1", F.when(F.col("pos1") != _BEFORE, F.col("pos1")))


def fold_ops(ops: DataFrame) -> DataFrame:
    """All operations, explicit and mass, to edges: graph_id, source_id, destination_id, position, updated_at, count, state.

    Null seq, ids or unknown operations take no part; an empty list names nothing; no operations give no edges.
    """
    # all are read several times below; written once, they are neither computed again nor lost with an executor
    mass = written(mass_ops(ops))
    timeline = node_timeline(mass)
    named = written(changefeed.explicit_ops(ops).select(*EDGE, "seq", F.col("idx").cast("long").alias("idx"), "rank", "pos"))
    ways = _directions(mass)
    if not ways:
        return fold_explicit(named)
    rows = written(dominated(named, timeline, ways).select(*_OP))
    keys = rows.groupBy(*EDGE).agg(F.min("seq").alias("first_seq")).withColumn("past", F.lit(True))
    more = written(expanded(mass.withColumn("new", F.lit(True)), keys, timeline, ways).select(*_OP))
    touched = more.select(*EDGE).distinct()
    plain = fold_explicit(rows.join(touched, list(EDGE), "left_anti"))
    mixed = rows.join(touched, list(EDGE), "left_semi").withColumn("mass", F.lit(False)).unionByName(more.withColumn("mass", F.lit(True)))
    return plain.unionByName(as_edges(_folded(mixed)))


def fold_onto(base: DataFrame, past: DataFrame, new: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations applied to stored edges: the images (EDGE, rank1, pos1) of every edge that they name or touch.

    base: one row per edge (EDGE, rank0, pos0). past and new: the mass operations (see :func:`mass_ops`) applied before and
    those of ``ops`` that weren't. A new one meets all stored edges and those that the batch named before it. An explicit
    operation takes the states of its nodes as of its seq, those of the past included. An edge that is new though its
    operation is older than a mass operation of the past is met by that, too.
    """
    mass = past.unionByName(new)
    timeline = node_timeline(mass)
    start = base.select(*EDGE, "rank0", "pos0", F.lit(True).alias("known"))
    rows = written(changefeed.explicit_ops(ops).select(*_OP))
    ways = _directions(mass)
    if not ways:
        return changefeed.images_of(rows, start).select(*EDGE, "rank1", "pos1")
    rows = written(dominated(rows, timeline, ways).select(*_OP))
    named = rows.groupBy(*EDGE).agg(F.min("seq").alias("first_seq"))
    fresh = named.join(base, list(EDGE), "left_anti").withColumn("past", F.lit(True))
    stored = base.select(*EDGE, F.lit(_BEFORE).alias("first_seq"), F.lit(False).alias("past"))
    both = past.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))
    more = written(expanded(both, stored.unionByName(fresh), timeline, ways).select(*_OP))
    touched = more.select(*EDGE).distinct()
    plain = changefeed.images_of(rows.join(touched, list(EDGE), "left_anti"), start).select(*EDGE, "rank1", "pos1")
    first = base.select(*EDGE, F.lit(_BEFORE).alias("seq"), F.lit(-1).alias("idx"), F.col("rank0").alias("rank"), F.col("pos0").alias("pos"))
    mixed = first.unionByName(rows).join(touched, list(EDGE), "left_semi").withColumn("mass", F.lit(False)).unionByName(more.withColumn("mass", F.lit(True)))
    return plain.unionByName(_folded(mixed))


def node_table(edges: DataFrame, timeline: DataFrame | None = None) -> DataFrame:
    """Nodes of both directions: graph_id, direction, source_id, state, count, updated_at.

    Nodes with edges or mass operations. A node never written is Normal at time 0; count is the number of its edges whose
    state equals its own.
    """
    from .skew import salted_aggregate

    two = both_directions(edges)
    key = ["graph_id", "direction", "source_id"]
    counts = salted_aggregate(two, key, {"n": ("count", None)}, by=["state"], spread=["destination_id"])
    if timeline is None:
        nodes = counts.select(*key).distinct().withColumn("node_rank", F.lit(1).cast("long"))
    else:
        written = timeline.groupBy("graph_id", "direction", F.col("node").alias("source_id")).agg(F.max("node_rank").alias("node_rank"))
        nodes = counts.select(*key).distinct().join(written, key, "full").withColumn("node_rank", F.coalesce("node_rank", F.lit(1).cast("long")))
    n = nodes.select(*key, L.rank_state("node_rank").alias("state"), L.rank_time("node_rank").alias("updated_at"))
    return n.join(counts, [*key, "state"], "left").select(*key, "state", F.coalesce("n", F.lit(0)).cast("long").alias("count"), "updated_at")
