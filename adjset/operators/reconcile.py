"""Differences between two copies of a table, by reconciling sets of row hashes.

Method: rows are spread over buckets by their key. Each copy sends, per bucket, its number of rows and the values of its
characteristic polynomial (the product of z - h over its row hashes) at a few points of the field of 2**61 - 1 elements.
The ratio of the two polynomials is a rational function of low degree; its numerator and denominator are the solution of
linear equations, whose degree bound doubles until the result also holds at further points. They vanish at exactly the
hashes that only one copy has: those rows are fetched from either copy and compared field by field. A bucket with more
differences than the evaluations at hand allow sends its row hashes, and the doubling goes on there.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gf
from ..functions import lattice as L
from ..functions.session import partitions, written
from .current import EDGE, current_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows meant for one bucket, and evaluations that a copy sends of each.
BUCKET_ROWS = 64
EVALUATIONS = 20
COMPARED = ("position", "updated_at", "count", "state")


def bucket_of(parts: int, per_part: int) -> Column:
    """Bucket by key: the partition that a shuffle by key into ``parts`` puts the row in, times ``per_part``, plus a share
    of it. Buckets refine partitions, so after that shuffle the rows of a bucket are already in one task."""
    return F.pmod(F.hash(*EDGE), F.lit(parts)).cast("long") * per_part + F.pmod(F.xxhash64(*EDGE), F.lit(per_part))


def _hashed(df: DataFrame, parts: int, per_part: int) -> DataFrame:
    """Current rows with bucket and row hash; a null field hashes unlike any value."""
    rows = current_rows(df, EDGE, ["position", "count"])
    values = [*EDGE, "rank"] + [x for f in ("position", "count") for x in (F.col(f), F.col(f).isNull())]
    return rows.withColumns({"bucket": bucket_of(parts, per_part), "h": F.xxhash64(*values)})


_SENT = "bucket long, side int, n long, evals binary"
_POLYS = "bucket long, kind int, only_a binary, only_b binary"
#: What is known of a bucket: nothing yet, polynomials, lists of hashes, or that one copy has no row there.
HARD, POLYNOMIALS, HASHES, ONE_SIDED = range(4)
#: Buckets with many differences that are worked on together.
_TOGETHER = 256


def _sketcher(side: int, zs: list[int]):
    def sketch(batches):
        z = np.array(zs, np.uint64)
        for b in batches:
            if b.num_rows:
                bucket, h = b.column(0).to_numpy(), gf.to_field(b.column(1).to_numpy())
                o = np.argsort(bucket, kind="stable")
                ids, starts, n = np.unique(bucket[o], return_index=True, return_counts=True)
                v = gf.products(h[o], starts, z)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), side, np.int32)), pa.array(n.astype(np.int64)), _binary(v)], names=["bucket", "side", "n", "evals"])

    return sketch


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as binary values."""
    at = (np.arange(len(rows) + 1) * rows.shape[1] * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _trimmed(polys: np.ndarray) -> pa.Array:
    """Polynomials without their leading zeros; a constant, which has no roots, as no bytes."""
    width = polys.shape[1]
    deg = width - 1 - (polys != 0).argmax(1)
    size = np.where(deg > 0, deg + 1, 0)
    at = (np.append(0, np.cumsum(size)) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(polys), [None, pa.py_buffer(at), pa.py_buffer(polys[np.arange(width)[None, :] >= width - size[:, None]])])


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), width)


def _whole(batches, least: int = 1):
    """Batches sorted by bucket -> tables in which every bucket is whole; at least so many rows each, but for the last."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        rest = t
        if t.num_rows > least:
            at = t.column("bucket").to_numpy()
            cut = int(np.searchsorted(at, at[-1]))
            if cut:
                yield t.slice(0, cut).combine_chunks()
                rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _polys(ids, kind, a, b):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kind, pa.int32()), a, b], names=["bucket", "kind", "only_a", "only_b"])


def _solver(zs: list[int]):
    """Evaluations sorted by bucket -> the polynomials of buckets that differ."""

    def run(batches):
        for t in _whole(batches):
            ids, at = np.unique(t.column("bucket").to_numpy(), return_inverse=True)
            side, n = t.column("side").to_numpy(), t.column("n").to_numpy()
            size = np.zeros((2, len(ids)), np.int64)
            np.add.at(size, (side, at), n)
            e = np.ones((2, len(ids), len(zs)), np.uint64)
            evals = _numbers(t.column("evals").combine_chunks(), len(zs))
            # a bucket that lay in several batches has several factors
            key = at * 2 + side
            o = np.argsort(key, kind="stable")
            nth = np.arange(len(o)) - np.searchsorted(key[o], key[o])
            for k in range(int(nth.max()) + 1):
                i = o[nth == k]
                e[side[i], at[i]] = gf.mul(e[side[i], at[i]], evals[i])
            one = (size == 0).any(0)
            if one.any():
                none = pa.array([b""] * int(one.sum()), pa.binary())
                yield _polys(ids[one], np.full(int(one.sum()), ONE_SIDED), none, none)
            i = np.flatnonzero(~one & ((size[0] != size[1]) | (e[0] != e[1]).any(1)))
            if len(i):
                a, b, ok = gf.differences(e[0][i], e[1][i], size[0][i], size[1][i], zs)
                yield _polys(ids[i], np.where(ok, POLYNOMIALS, HARD), _trimmed(a), _trimmed(b))

    return run


def _escalate(batches):
    """Buckets with many differences, from both copies' hashes: the evaluations double once more; where that doesn't do, the
    differing hashes are no fewer than a good part of the bucket and are listed."""
    zs = gf.points(2 * EVALUATIONS)
    for t in _whole(batches, _TOGETHER * BUCKET_ROWS):
        bucket, side, raw = (t.column(c).to_numpy() for c in ("bucket", "side", "h"))
        ids, at = np.unique(bucket, return_inverse=True)
        h = gf.to_field(raw)
        e, size = [], []
        for s in (0, 1):
            i = np.flatnonzero(side == s)
            v = np.ones((len(ids), len(zs)), np.uint64)
            own, starts = np.unique(at[i], return_index=True)
            v[own] = gf.products(h[i], starts, np.array(zs, np.uint64))
            e.append(v)
            size.append(np.bincount(at[i], minlength=len(ids)))
        a, b, ok = gf.differences(*e, *size, zs)
        if ok.any():
            yield _polys(ids[ok], np.full(int(ok.sum()), POLYNOMIALS), _trimmed(a[ok]), _trimmed(b[ok]))
        left = np.flatnonzero(~ok)
        lists = [[np.setdiff1d(raw[j][side[j] == s], raw[j][side[j] != s]).tobytes() for s in (0, 1)] for k in left for j in [slice(*np.searchsorted(at, [k, k + 1]))]]
        if lists:
            yield _polys(ids[left], np.full(len(left), HASHES), *[pa.array(x, pa.binary()) for x in zip(*lists)])


def _recover(batches):
    """Rows that their bucket's differences name; the last three columns, hash, kind and differences, go."""
    for b in batches:
        if b.num_rows:
            raw, kind, known = b.column(b.num_columns - 3).to_numpy(), b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1)
            hit = kind == ONE_SIDED
            lens = pa.compute.binary_length(known).to_numpy(zero_copy_only=False)
            for width in np.unique(lens[kind == POLYNOMIALS]):
                i = np.flatnonzero((kind == POLYNOMIALS) & (lens == width))
                hit[i] = gf.roots(_numbers(known.take(pa.array(i)), width // 8), gf.to_field(raw[i]))
            seen: dict[bytes, set] = {}
            for i in np.flatnonzero(kind == HASHES).tolist():
                x = known[i].as_py()
                if x not in seen:
                    seen = {x: set(np.frombuffer(x, np.int64).tolist())}  # rows of a bucket follow each other
                hit[i] = int(raw[i]) in seen[x]
            yield b.select(b.schema.names[:-3]).filter(pa.array(hit))


def differing_rows(a: DataFrame, b: DataFrame, n_buckets: int | None = None, evaluations: int = EVALUATIONS) -> tuple[DataFrame, DataFrame]:
    """Current rows of either copy that the other doesn't have alike: graph_id, source_id, destination_id, rank, position, count.

    Buckets hold about BUCKET_ROWS rows each; their number, rounded up to a multiple of the shuffle's partitions, follows
    from the larger copy's number of rows unless it is given. A bucket in which one copy has no row needs no polynomial:
    all rows of the other are differences, so an empty copy costs no more than an equal one. Each copy's current rows are
    made once and stored in order of their buckets.
    """
    spark = a.sparkSession
    parts = partitions(spark)
    per_part = max(1, -(-(max(a.count(), b.count()) // BUCKET_ROWS if n_buckets is None else n_buckets) // parts))
    zs = gf.points(evaluations)
    keep = [*EDGE, "rank", "position", "count"]
    sides = [written(_hashed(x, parts, per_part).select(*keep, "bucket", "h").sortWithinPartitions("bucket")) for x in (a, b)]
    sent = [x.select("bucket", "h").mapInArrow(_sketcher(i, zs), _SENT) for i, x in enumerate(sides)]
    polys = written(sent[0].unionByName(sent[1]).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_solver(zs), _POLYS))
    hard = polys.filter(F.col("kind") == HARD).select("bucket")
    hashes = sides[0].select("bucket", F.lit(0).alias("side"), "h").unionByName(sides[1].select("bucket", F.lit(1).alias("side"), "h"))
    more = written(hashes.join(hard, "bucket", "left_semi").repartition("bucket").sortWithinPartitions("bucket", "side").mapInArrow(_escalate, _POLYS))
    known = polys.filter(F.col("kind") != HARD).unionByName(more)
    out = []
    for side, name in zip(sides, ("only_a", "only_b")):
        rows = side.join(known.filter((F.col("kind") == ONE_SIDED) | (F.length(name) > 0)).select("bucket", "kind", name), "bucket").select(*keep, "h", "kind", name)
        out.append(rows.mapInArrow(_recover, side.select(*keep).schema))
    return out[0], out[1]


def copy_differences(a: DataFrame, b: DataFrame, n_buckets: int | None = None, evaluations: int = EVALUATIONS) -> DataFrame:
    """graph_id, source_id, destination_id, field: how the current rows of two copies of an edge table differ.

    field is missing_in_replica or missing_in_primary for a key that one copy lacks, else one row for each of position,
    updated_at, count and state that differs; null equals null and differs from any value. Two empty or equal copies
    give no rows; if one is empty, every key of the other is missing. Rows with a null key take no part.
    """
    only_a, only_b = differing_rows(a, b, n_buckets, evaluations)
    x = only_a.select(*EDGE, F.struct("rank", "position", "count").alias("a"))
    y = only_b.select(*EDGE, F.struct("rank", "position", "count").alias("b"))
    j = x.join(y, list(EDGE), "full")
    pair = {"position": (F.col("a.position"), F.col("b.position")), "count": (F.col("a.count"), F.col("b.count")),
            "updated_at": (L.rank_time("a.rank"), L.rank_time("b.rank")), "state": (L.rank_state("a.rank"), L.rank_state("b.rank"))}
    differ = F.array(*[F.when(~pair[f][0].eqNullSafe(pair[f][1]), F.lit(f)) for f in COMPARED])
    field = F.when(F.col("b").isNull(), F.array(F.lit("missing_in_replica"))).when(F.col("a").isNull(), F.array(F.lit("missing_in_primary"))).otherwise(F.array_compact(differ))
    return j.select(*EDGE, F.explode(field).alias("field"))
