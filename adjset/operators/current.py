"""Current rows: the newest row of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lattice as L

EDGE = ("graph_id", "source_id", "destination_id")
NODE = ("graph_id", "source_id")


def current_rows(df: DataFrame, keys=EDGE, fields=(), arrival: bool = False, where: Column | None = None) -> DataFrame:
    """One row per key: the keys, ``rank``, the named ``fields`` and, if asked for, ``arrived``.

    The current row has the greatest ``updated_at`` and among those the greatest state. Rows that still tie are
    settled by the greatest fields, in the order given, null lowest, so the result is the same on every run.
    ``arrived`` is the smallest ``loaded_at`` of all rows of the key. Rows with a null key take no part. Other columns
    of ``df`` are never looked at. Repeated rows are combined before the shuffle on the whole key, which spreads a hot
    source or destination by itself.
    """
    need = [F.col(k) for k in keys] + [L.rank().alias("rank")] + [F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]
    if arrival:
        need.append(F.col("loaded_at").alias("arrived"))
    rows = df.dropna(subset=list(keys))
    rows = (rows if where is None else rows.filter(where)).select(*need)
    names = [f"f{i}" for i in range(len(fields))]
    best = F.max(F.struct("rank", *names)).alias("best") if fields else F.max("rank").alias("rank")
    out = rows.groupBy(*keys).agg(best, *([F.min("arrived").alias("arrived")] if arrival else []))
    if fields:
        out = out.select(*keys, "best.rank", *[F.col(f"best.f{i}").alias(f) for i, f in enumerate(fields)], *(["arrived"] if arrival else []))
    return out


def decoded(rows: DataFrame) -> DataFrame:
    """``rank`` of :func:`current_rows` taken apart into ``updated_at`` and ``state``."""
    return rows.select(*[c for c in rows.columns if c != "rank"], L.rank_time("rank").alias("updated_at"), L.rank_state("rank").alias("state"))
