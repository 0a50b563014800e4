"""Bidirectional keyset pages, for many queries in one job. Keys descend; pages never use an offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CURSOR, START, Cursor


def cursor_column(c: Cursor) -> Column:
    return F.struct(F.lit(c.kind).alias("kind"), F.lit(c.key).cast("long").alias("key"), F.lit(c.tie).cast("long").alias("tie"))


def keyset_pages(rows: DataFrame, by: list[str], key: str, count: Column | int, cursor: Cursor | Column = START, tie: str | None = None) -> DataFrame:
    """The page of every query: the columns of ``rows`` and ``next`` and ``prev``, structs of kind, key and tie.

    by: columns that tell queries apart. Rows descend by ``key`` and, where keys are equal, by ``tie``; null keys are below
    all others. cursor: a :class:`Cursor` for all queries, or a struct column that is the same for all rows of a query; so
    is count. A cursor with a tie is a place between two rows, so pages that follow each other hold every row once. next
    goes on below the last row if any row lies below the page, prev above the first if any lies above, else they are an
    end. An empty page has no row.

    Of each query only the rows of the page, one more, and as many on the other side of the cursor pass the group limit
    before the shuffle; a window over these few rows gives both cursors.
    """
    k, t = F.col(key), F.col(tie) if tie else F.lit(None).cast("long")
    c = (cursor_column(cursor) if isinstance(cursor, Cursor) else cursor).cast(CURSOR)
    r = rows.withColumn("c_", c).filter(F.col("c_.kind") != "end")
    back, ck, ct = F.col("c_.kind") == "backward", F.col("c_.key"), F.col("c_.tie")

    def side(less) -> Column:
        """On the side of the cursor that ``less`` tells; without a tie a null key is on neither."""
        lower = less(k, ck, k.isNull() & ck.isNotNull(), ck.isNull() & k.isNotNull())
        return F.when(ct.isNull(), less(k, ck, None, None)).otherwise(F.coalesce(lower, F.lit(False)) | (k.eqNullSafe(ck) & less(t, ct, None, None)))

    below = side(lambda x, y, low, high: x < y if low is None else F.coalesce(x < y, low))
    above = side(lambda x, y, low, high: x > y if low is None else F.coalesce(x > y, high))
    r = r.withColumn("in_", F.when(F.col("c_.kind") == "start", True).when(back, above).otherwise(below)).filter(F.col("in_").isNotNull())
    order = [o for x in [key, *([tie] if tie else [])] for o in (F.when(back, F.col(x)).asc_nulls_first(), F.when(~back, F.col(x)).desc_nulls_last())]
    r = r.withColumn("n_", F.row_number().over(W.partitionBy(*by, "in_").orderBy(*order))).filter(F.col("n_") <= count + 1)
    w = W.partitionBy(*by)
    on_page = F.col("in_") & (F.col("n_") <= count)
    place = F.struct("n_", k.cast("long").alias("key"), t.cast("long").alias("tie"))
    r = r.withColumns({"more_": F.max(F.col("in_") & (F.col("n_") > count)).over(w), "other_": F.max(~F.col("in_")).over(w),
                       "first_": F.min(F.when(on_page, place)).over(w), "last_": F.max(F.when(on_page, place)).over(w)}).filter(on_page)
    more, other = F.col("more_"), F.col("other_")

    def at(kind: str, end: str, there: Column) -> Column:
        got = F.struct(F.lit(kind).alias("kind"), F.col(f"{end}.key").alias("key"), F.col(f"{end}.tie").alias("tie"))
        return F.when(there, got.cast(CURSOR)).otherwise(cursor_column(Cursor("end")).cast(CURSOR))

    return r.select(*rows.columns, F.when(back, at("forward", "first_", other)).otherwise(at("forward", "last_", more)).alias("next"),
                    F.when(back, at("backward", "last_", more)).otherwise(at("backward", "first_", other)).alias("prev"))


def pages(rows: DataFrame, by: list[str], key: str, count: Column | int, cursor: Column | int = -1, tie: str | None = None) -> DataFrame:
    """:func:`keyset_pages` with cursors in wire form, next_cursor and prev_cursor.

    cursor: -1 from the start, c > 0 the keys below c, -c the ``count`` keys closest above c, 0 nothing. next is the last
    key of the page or 0, prev is minus the first key or 0. The wire form has room for the key alone: it passes over rows
    that tie with the cursor's, and has no way to say the keys 0, 1 and below or null. Null keys come last and only from
    the start.
    """
    c = F.lit(cursor).cast("long") if isinstance(cursor, int) else cursor.cast("long")
    kind = F.when(c == -1, "start").when(c == 0, "end").when(c > 0, "forward").otherwise("backward")
    typed = F.struct(kind.alias("kind"), F.abs(c).alias("key"), F.lit(None).cast("long").alias("tie"))
    got = keyset_pages(rows, by, key, count, typed, tie)
    wire = lambda name: F.when(F.col(f"{name}.kind") == "end", F.lit(0)).otherwise(F.col(f"{name}.key"))
    return got.select(*rows.columns, wire("next").cast("long").alias("next_cursor"), (-wire("prev")).cast("long").alias("prev_cursor"))


def scan_after(rows: DataFrame, key: list[str], after: tuple | None, count: int) -> DataFrame:
    """A full scan's next ``count`` rows in ascending order of a composite key, strictly after ``after``."""
    r = rows
    if after is not None:
        later = F.lit(False)
        for i in range(len(key)):
            same = F.lit(True)
            for j in range(i):
                same = same & (F.col(key[j]) == F.lit(after[j]))
            later = later | (same & (F.col(key[i]) > F.lit(after[i])))
        r = r.filter(later)
    return r.orderBy(*key).limit(count)
