"""A change feed of edge operations applied to a table, as a signed multiset.

Method: every change that applies contributes a minus-one before-image (none if the edge is new) and a plus-one
after-image; multiplicities are summed with the base, of which every row counts one, and rows with a positive sum remain.
Images follow from the edge state machine over the operations in order, by windows: an operation applies if its rank is no
less than the greatest rank before it; the position is that of the last operation that applied to a Removed or Negative
edge and made it Normal (or that created the edge).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lattice as L
from .current import EDGE, current_rows
from .skew import HEAVY

#: Keys with more operations are scanned in segments of SEGMENT consecutive seq values.
HEAVY_OPS = 50_000
SEGMENT = 50_000


def explicit_ops(ops: DataFrame) -> DataFrame:
    """Operations that list destinations, one row per edge and place in the list.

    graph_id, source_id, destination_id, seq, idx, rank, pos. Rows delivered again under one seq count once: the one
    queued first, and of those the least by the other columns. A backward operation names the destination in source_id.
    A null execute_at stands for the whole seconds of queued_at, a null position for its whole milliseconds * 2**20.
    Wildcards, empty lists, null ids, an unknown op and a null seq take no part; a null is_forward is forward.
    """
    cols = ["queued_at", "graph_id", "source_id", "is_forward", "op", "position", "execute_at", "destination_ids"]
    o = ops.select("seq", *cols).filter(F.col("seq").isNotNull() & (F.size("destination_ids") > 0))
    o = o.groupBy("seq").agg(F.min(F.struct(*cols)).alias("o")).select("seq", "o.*")
    o = o.select("seq", "graph_id", "source_id", F.coalesce("is_forward", F.lit(True)).alias("fwd"), F.posexplode("destination_ids").alias("idx", "other"),
                 L.rank_of(F.coalesce("execute_at", F.unix_seconds("queued_at")), L.op_ordinal("op")).alias("rank"),
                 F.coalesce("position", F.unix_millis("queued_at") * F.lit(1 << 20)).alias("pos"), L.op_ordinal("op").alias("known"))
    o = o.select("graph_id", F.when(F.col("fwd"), F.col("source_id")).otherwise(F.col("other")).alias("source_id"),
                 F.when(F.col("fwd"), F.col("other")).otherwise(F.col("source_id")).alias("destination_id"), "seq", "idx", "rank", "pos", "known")
    return o.dropna(subset=[*EDGE, "known"]).drop("known")


def _running(rows: DataFrame, name: str, value, by) -> DataFrame:
    """``name``: the greatest ``value`` of earlier operations within ``by``."""
    w = W.partitionBy(*by).orderBy("seq", "idx").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.max(value).over(w))


def _carried(rows: DataFrame, name: str, value, key) -> DataFrame:
    """Per segment the greatest ``value`` of all earlier segments of its edge; one row per segment."""
    w = W.partitionBy(*EDGE).orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    return rows.groupBy(*key).agg(F.max(value).alias(name)).select(*key, F.max(name).over(w).alias(name))


def _decided(rows: DataFrame) -> DataFrame:
    """Adds to ``before`` (the greatest rank so far, the base's included) whether a row applies and moves the position."""
    prev = F.greatest("before", "rank0")
    revived = (L.rank_ordinal("rank") == 0) & L.rank_ordinal(prev).isin(L.ORDER.index(L.NEGATIVE), L.ORDER.index(L.REMOVED))
    applies = prev.isNull() | (F.col("rank") >= prev)
    r = rows.withColumns({"prev": prev, "applies": applies}).withColumn("moved", F.col("applies") & (F.col("prev").isNull() | revived))
    return r.withColumn("move", F.when(F.col("moved"), F.struct("seq", "idx", "pos")))


_STEP = [*EDGE, "seq", "idx", "rank", "pos", "rank0", "pos0", "known", "first", "prev", "applies", "moved", "last"]


def steps(rows: DataFrame, start: DataFrame, heavy_ops: int = HEAVY_OPS, segment: int = SEGMENT) -> DataFrame:
    """Every operation with the image that it meets: ``prev`` (rank) and ``last`` (the move that set the position, null
    for the base's own), whether it ``applies`` and ``moved`` the position, and of its edge rank0, pos0, known and ``first``.

    rows: edge key, seq, idx, rank, pos. start: one row per edge of the base, edge key, rank0, pos0, known. One shuffle by
    edge and two windows over the same order. The edges with the most operations, if they have more than ``heavy_ops``, a
    list of at most HEAVY edges, are scanned in segments by (edge, segment), so that none of their rows ever come together
    by edge: only one row per segment does, which carries ranks and moves from segment to segment.
    """
    counted = rows.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy_ops)
    heavy = [tuple(r)[:3] for r in counted.orderBy(F.desc("n"), *EDGE).limit(HEAVY).collect()]
    parts = []
    if heavy:
        hot = F.broadcast(rows.sparkSession.createDataFrame(heavy, rows.select(*EDGE).schema))
        key = [*EDGE, "seg"]
        seg = rows.join(hot, list(EDGE), "left_semi").withColumn("seg", F.floor(F.col("seq") / segment))
        rows = rows.join(hot, list(EDGE), "left_anti")
        heads = _carried(seg, "carry", F.col("rank"), key).join(start.join(hot, list(EDGE), "left_semi"), list(EDGE), "left")
        s = _running(seg, "before", F.col("rank"), key).join(heads, key)
        s = _decided(s.withColumn("first", F.col("carry").isNull() & F.col("before").isNull()).withColumn("before", F.greatest("before", "carry")))
        moves = _carried(s, "moved_before", F.col("move"), key)
        s = _running(s, "last", F.col("move"), key).join(moves, key)
        parts.append(s.withColumn("last", F.coalesce("last", "moved_before")).select(*_STEP))
    s = _running(rows.join(start, list(EDGE), "left"), "before", F.col("rank"), EDGE)
    s = _decided(s.withColumn("first", F.col("before").isNull()))
    parts.append(_running(s, "last", F.col("move"), EDGE).select(*_STEP))
    return reduce(DataFrame.unionByName, parts)


def images_of(rows: DataFrame, start: DataFrame, heavy_ops: int = HEAVY_OPS, segment: int = SEGMENT) -> DataFrame:
    """Per edge that an operation names: the keys, rank0, pos0, known (in the base) and rank1, pos1 at the end; see :func:`steps`."""
    s = steps(rows, start, heavy_ops, segment)
    end = F.max(F.when(F.col("moved"), F.struct("seq", "idx", "pos"))).alias("m")
    out = s.groupBy(*EDGE).agg(F.max(F.greatest("rank", "rank0")).alias("rank1"), end, F.max("rank0").alias("rank0"), F.max("pos0").alias("pos0"), F.max("known").alias("known"))
    return out.select(*EDGE, "rank0", "pos0", F.coalesce("known", F.lit(False)).alias("known"), "rank1", F.when(F.col("m").isNotNull(), F.col("m.pos")).otherwise(F.col("pos0")).alias("pos1"))


def _base(base: DataFrame) -> DataFrame:
    return current_rows(base, EDGE, ["position"]).select(*EDGE, F.col("rank").alias("rank0"), F.col("position").alias("pos0"), F.lit(True).alias("known"))


def _row(r, p):
    return [L.rank_state(r).alias("state"), L.rank_time(r).alias("updated_at"), F.col(p).alias("position")]


def signed_images(base: DataFrame, ops: DataFrame, heavy_ops: int = HEAVY_OPS, segment: int = SEGMENT) -> DataFrame:
    """Signed rows, summed: graph_id, source_id, destination_id, rank, pos, ``base`` (1 for the base's row of an edge that an
    operation names) and ``change`` (the sum of the before- and after-images of the operations that apply)."""
    s = steps(explicit_ops(ops), _base(base), heavy_ops, segment)
    pos = F.when(F.col("last").isNotNull(), F.col("last.pos")).otherwise(F.col("pos0"))
    image = lambda when, b, m, r, p: F.when(when, F.struct(F.lit(b).alias("base"), F.lit(m).alias("change"), r.alias("rank"), p.alias("pos")))
    three = F.array(image(F.col("first") & F.col("known"), 1, 0, F.col("rank0"), F.col("pos0")),
                    image(F.col("applies") & F.col("prev").isNotNull(), 0, -1, F.col("prev"), pos),
                    image(F.col("applies"), 0, 1, F.col("rank"), F.when(F.col("moved"), F.col("pos")).otherwise(pos)))
    x = s.select(*EDGE, F.inline(F.array_compact(three)))
    return x.groupBy(*EDGE, "rank", "pos").agg(F.sum("base").alias("base"), F.sum("change").alias("change"))


def signed_changes(base: DataFrame, ops: DataFrame, heavy_ops: int = HEAVY_OPS, segment: int = SEGMENT) -> DataFrame:
    """What the operations add and take away: graph_id, source_id, destination_id, state, updated_at, position, multiplicity.

    Images that an edge has only in between sum to zero and don't come out, nor does an edge that ends as it began. No
    operations give no rows.
    """
    x = signed_images(base, ops, heavy_ops, segment).filter("change != 0")
    return x.select(*EDGE, *_row("rank", "pos"), F.col("change").alias("multiplicity"))


def changed_rows(base: DataFrame, ops: DataFrame, heavy_ops: int = HEAVY_OPS, segment: int = SEGMENT) -> DataFrame:
    """graph_id, source_id, destination_id, state, updated_at, position: rows with a positive sum that the base hasn't.

    The base counts by the rows of the edges that an operation names; those of other edges keep their one and aren't new.
    """
    x = signed_images(base, ops, heavy_ops, segment).filter("base + change > 0 AND base = 0")
    return x.select(*EDGE, *_row("rank", "pos"))


def consolidated(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Base rows, each once, and signed rows summed; rows with a positive sum: graph_id .. position."""
    cols = [*EDGE, "state", "updated_at", "position"]
    b = _base(base).select(*EDGE, *_row("rank0", "pos0"), F.lit(1).cast("long").alias("multiplicity"))
    return b.unionByName(changes.select(*cols, "multiplicity")).groupBy(*cols).agg(F.sum("multiplicity").alias("m")).filter("m > 0").select(*cols)
