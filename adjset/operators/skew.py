"""A few keys holding most records: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are salted. Every key with more than 1/HEAVY of all rows is among them.
HEAVY = 256
#: Parts that a heavy key is split into.
SALTS = 64

#: Rows up to which a key is never worth salts, where keys are looked for at once.
HOT_ROWS = 10_000

#: Measures that merge: partial aggregate and the aggregate that merges partials.
_MERGE = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def heavy_keys(df: DataFrame, keys, most: int = HEAVY) -> DataFrame:
    """The ``most`` keys with the most rows, so any key with more than 1/most of all rows.

    Counted over all rows with partial counts before the shuffle; the result has at most ``most`` rows, whatever the
    input, and may be broadcast for that reason.
    """
    return df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows")).orderBy(F.desc("key_rows"), *keys).limit(most).select(*keys)


def hot_keys(df: DataFrame, keys, least: int = HOT_ROWS, most: int = HEAVY) -> DataFrame:
    """:func:`heavy_keys` of more than ``least`` rows, found at once and held as at most ``most`` rows of the plan itself, so
    that plans in which they stand several times don't count several times, and are plain joins where there is none."""
    counts = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows")).filter(F.col("key_rows") > least)
    got = [tuple(r)[:-1] for r in counts.orderBy(F.desc("key_rows"), *keys).limit(most).collect()]
    return df.sparkSession.createDataFrame(got, df.select(*keys).schema)


def with_salt(df: DataFrame, keys, spread: list[Column], salts: int = SALTS, most: int = HEAVY, heavy: DataFrame | None = None, name: str = "salt_") -> DataFrame:
    """``df`` and a salt column: 0 .. salts-1 for heavy keys, 0 for the others.

    The salt is a hash of ``spread``, not a random number, so a task that runs again gives the same rows the same salt.
    """
    heavy = (heavy_keys(df, keys, most) if heavy is None else heavy.select(*keys)).withColumn("heavy_", F.lit(True))
    hit = df.join(F.broadcast(heavy), list(keys), "left")
    return hit.withColumn(name, F.when(F.col("heavy_"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("heavy_")


def salted_aggregate(df: DataFrame, keys, measures: dict[str, tuple[str, str | None]], by=(), spread=None, salts: int = SALTS, most: int = HEAVY, heavy: DataFrame | None = None) -> DataFrame:
    """Per-key results without a task that holds a whole hot key.

    measures: name -> (kind, column) with the kinds count, sum, min, max, avg and count_distinct; count with column
    None counts rows, else values that aren't null. Stage one aggregates per (key, by, salt), stage two merges the
    partials per (key, by). Rows with a null key form a group of their own, as in SQL; an empty table gives no rows.
    ``by`` are further grouping columns; heavy keys are found by ``keys`` alone. Columns not named are dropped first.
    """
    group = [*keys, *by]
    cols = list(dict.fromkeys([*group, *[c for _, c in measures.values() if c], *(spread or [])]))
    rows = df.select(*cols)
    distinct = [c for k, c in measures.values() if k == "count_distinct"]
    if len(set(distinct)) > 1:
        raise ValueError("one column at most can be counted distinct")
    # a value counted distinct must have one salt only, so that its partial sets don't overlap
    spread_cols = distinct[:1] or spread or [c for c in rows.columns if c not in keys] or list(keys)
    salted = with_salt(rows, keys, [F.col(c) for c in spread_cols], salts, most, heavy)
    part, merge = [], []
    for name, (kind, c) in measures.items():
        x = F.lit(1) if c is None else F.col(c)
        if kind == "avg":
            part += [F.sum(x).alias(f"{name}__s"), F.count(x).alias(f"{name}__n")]
            merge.append((F.sum(f"{name}__s") / F.sum(f"{name}__n")).alias(name))
        elif kind == "count_distinct":
            part.append(F.countDistinct(x).alias(name))
            merge.append(F.sum(name).alias(name))
        else:
            p, m = _MERGE[kind]
            part.append(p(x).alias(name))
            merge.append(m(name).alias(name))
    return salted.groupBy(*group, "salt_").agg(*part).groupBy(*group).agg(*merge)


def salted_join(left: DataFrame, right: DataFrame, keys, spread: list[Column], heavy: DataFrame, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique, with the heavy keys of ``left`` split into salts.

    ``heavy`` is a bounded list as of :func:`heavy_keys`; its rows of ``right`` are repeated once per salt.
    """
    hot = F.broadcast(heavy.select(*keys).withColumn("heavy_", F.lit(True)))
    copies = F.when(F.col("heavy_"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    r = right.join(hot, list(keys), "left").withColumn("salt_", F.explode(copies)).drop("heavy_")
    return with_salt(left, keys, spread, salts, heavy=heavy).join(r, [*keys, "salt_"], how).drop("salt_")
