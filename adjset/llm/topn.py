"""Top N items within every group, by a loser-tree merge of stored sorted runs.

Method: every task sorts its rows by bucket, group and score; of a group it keeps the first N, since no other can be among the
first N of all. That is a run, and it is stored in blocks by bucket, a bucket being a hash of the group. A second job reads
the blocks of a bucket, one set of sorted rows per run, and merges them with a loser tree; after N outputs of a group every
run that is still in it seeks to its next group. So at most N rows per group and run are stored, and a group of millions of
items never lies in one task. Where there are very many runs they are merged to fewer first, some at a time.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import partitions, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Buckets per partition of a shuffle, rows of a block, and runs of a bucket that one merge takes.
BUCKETS = 3
BLOCK_ROWS = 1 << 14
FAN_IN = 512
_BLOCKS = "bucket int, run long, part int, body binary"
#: Above every number of 64 bits: what a null is in a key, so nulls come last either way.
_LAST = 1 << 70
_TYPES = (T.IntegralType, T.FractionalType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


class _Falling:
    """A value whose order is turned round, for types that can't be negated."""

    __slots__ = ("x",)

    def __init__(self, x):
        self.x = x

    def __lt__(self, other):
        return other.x < self.x if isinstance(other, _Falling) else NotImplemented

    def __eq__(self, other):
        return isinstance(other, _Falling) and other.x == self.x


class _Null:
    """Above everything, for values that aren't numbers."""

    def __lt__(self, other):
        return False

    def __gt__(self, other):
        return not isinstance(other, _Null)

    def __eq__(self, other):
        return isinstance(other, _Null)


def _key(column: pa.ChunkedArray, falling: bool) -> list:
    """The values as keys that compare in Python as the sort in Spark orders them, nulls last."""
    t = column.type
    if pa.types.is_floating(t):
        most = np.int64(2**63 - 1)
        x = column.cast(pa.float64()).fill_null(0.0).to_numpy() + 0.0
        bits = x.view(np.int64)
        bits = np.where(np.isnan(x), most, np.where(bits < 0, bits ^ most, bits))
        out = (~bits if falling else bits).tolist()
    elif pa.types.is_integer(t) or pa.types.is_boolean(t) or pa.types.is_temporal(t):
        if pa.types.is_temporal(t):
            column = column.cast(pa.int32()) if pa.types.is_date32(t) else column.cast(pa.int64())
        x = column.cast(pa.int64()).fill_null(0).to_numpy()
        out = (~x if falling else x).tolist()
    elif pa.types.is_decimal(t):
        out = [None if v is None else -v if falling else v for v in column.to_pylist()]
    else:
        out = [v.encode() if isinstance(v, str) else v for v in column.to_pylist()]
        out = [None if v is None else _Falling(v) for v in out] if falling else out
        return [_Null() if v is None else v for v in out] if column.null_count else out
    if column.null_count:
        for i in np.flatnonzero(column.is_null().to_numpy()).tolist():
            out[i] = _LAST
    return out


def _same_as_before(t: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Whether a row has the group of the row before; nulls are alike."""
    same = np.ones(t.num_rows, bool)
    same[:1] = False
    for c in names:
        codes = t.column(c)
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).dictionary_encode(null_encoding="encode").indices.to_numpy()
        same[1:] &= codes[1:] == codes[:-1]
    return same


def _blocks(bucket: int, run: int, t: pa.Table):
    """Rows of one bucket and run as blocks."""
    for part, b in enumerate(t.combine_chunks().to_batches(max_chunksize=BLOCK_ROWS)):
        body = pa.BufferOutputStream()
        with pa.ipc.new_stream(body, b.schema) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([run], pa.int64()), pa.array([part], pa.int32()), pa.array([body.getvalue().to_pybytes()], pa.binary())], names=["bucket", "run", "part", "body"])


def _run_writer(group: list[str], n: int):
    """Rows of a task sorted by bucket, group and score -> blocks of its run, with the first n of every group."""

    def run(batches):
        number = TaskContext.get().partitionId()
        last, taken, bucket, held = None, 0, None, []
        for b in batches:
            if not b.num_rows:
                continue
            own = [b.column(c)[0].as_py() for c in group]
            new = ~_same_as_before(b, group)
            new[0] = last is None or own != last
            starts = np.append(0, np.flatnonzero(new[1:]) + 1)
            place = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.append(starts, b.num_rows)))
            if not new[0]:  # the group goes on
                first = int(starts[1]) if len(starts) > 1 else b.num_rows
                place[:first] += taken
            last, taken = [b.column(c)[b.num_rows - 1].as_py() for c in group], int(place[-1]) + 1
            b = b.filter(pa.array(place < n))
            at = b.column("bucket").to_numpy()
            edges = np.flatnonzero(np.diff(at)) + 1
            for i, j in zip([0, *edges], [*edges, b.num_rows]):
                if i == j:
                    continue
                if at[i] != bucket and held:
                    yield from _blocks(bucket, number, pa.Table.from_batches(held))
                    held = []
                bucket = int(at[i])
                held.append(b.slice(i, j - i).drop_columns(["bucket"]))
        if held:
            yield from _blocks(bucket, number, pa.Table.from_batches(held))

    return run


def merged(runs: list[list], groups: list, after: np.ndarray, n: int):
    """Loser tree over runs, given as the first row of each and the row after its last: yields rows in order, with their place
    in their group, the first n of each. keys are compared by ``groups``, a list of (group, score) per row; ``after`` has
    for every row the first one of its run that is of a later group."""
    k = len(runs)
    pos, end = [r[0] for r in runs], [r[1] for r in runs]
    head = [groups[p] if p < e else None for p, e in zip(pos, end)]
    tree = [-1] * k  # tree[1:] holds losers, tree[0] the winner

    def settle(r: int) -> None:
        """Plays run r from its leaf to the root; on the first way up it stays where no other has come yet."""
        node, own = (r + k) >> 1, head[r]
        while node:
            t = tree[node]
            if t < 0:
                tree[node] = r
                return
            other = head[t]
            if other is not None and (own is None or other < own or (other == own and t < r)):
                tree[node], r, own = r, t, other
            node >>= 1
        tree[0] = r

    for r in range(k - 1, -1, -1):
        settle(r)
    group, taken = None, 0
    while True:
        r = tree[0]
        if head[r] is None:
            return
        i = pos[r]
        if head[r][0] != group:
            group, taken = head[r][0], 0
        if taken < n:
            taken += 1
            yield i, taken
            i += 1
        else:
            i = int(after[i])  # seek
        pos[r] = i
        head[r] = groups[i] if i < end[r] else None
        settle(r)


def _merge_bucket(parts: list, group: list[str], order: list[tuple[str, bool]], n: int) -> tuple[pa.Table, np.ndarray]:
    """Blocks (run, body) of one bucket, in order -> its rows and their places."""
    batches = [pa.ipc.open_stream(body).read_all() for _, body in parts]
    t = pa.concat_tables(batches).combine_chunks()
    number = np.repeat([run for run, _ in parts], [b.num_rows for b in batches])
    starts = np.append(0, np.flatnonzero(np.diff(number)) + 1)
    ends = np.append(starts[1:], len(number))
    same = _same_as_before(t, group)
    same[starts] = False
    firsts = np.append(np.flatnonzero(~same), t.num_rows)
    after = firsts[np.searchsorted(firsts, np.arange(t.num_rows), "right")]
    keys = list(zip(zip(*[_key(t.column(c), False) for c in group]), zip(*[_key(t.column(c), down) for c, down in order])))
    got = list(merged(list(zip(starts.tolist(), ends.tolist())), keys, after, n))
    at, place = np.array(got, np.int64).reshape(-1, 2).T
    return t.take(pa.array(at)), place


def _merger(group, order, n: int, again: bool):
    """Blocks sorted by bucket, run and part -> merged rows with their places, or blocks of longer runs."""

    def run(batches):
        at, parts = None, []

        def done():
            t, place = _merge_bucket(parts, group, order, n)
            if again:
                yield from _blocks(at[0], at[1], t)
            else:
                yield from t.append_column("place", pa.array(place)).combine_chunks().to_batches(max_chunksize=1 << 16)

        for b in batches:
            bucket, number, into = (b.column(c).to_pylist() for c in ("bucket", "run", "into"))
            bodies = b.column("body")
            for i in range(b.num_rows):
                if (bucket[i], into[i]) != at:
                    if parts:
                        yield from done()
                    at, parts = (bucket[i], into[i]), []
                parts.append((number[i], bodies[i].as_py()))
        if parts:
            yield from done()

    return run


def top_n(rows: DataFrame, group: list[str], order: list[str], n: int, rank_column: str | None = None, fan_in: int | None = None) -> DataFrame:
    """The first ``n`` rows of every group by ``order``: names of columns, with a minus in front to descend.

    Nulls come last either way. ``order`` should settle all ties; rows that still tie come in any order, and repeated rows each
    count. Nulls in the group form a group; an empty table gives no rows, n < 1 gives none. All columns of ``rows`` are
    kept, whatever their names; with rank_column the place from 1 is added. Columns of group and order are numbers, strings,
    binary, booleans or times.
    """
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    down = [(c.lstrip("-"), c.startswith("-")) for c in order]
    for c in [*group, *[c for c, _ in down]]:
        if not isinstance(rows.schema[c].dataType, _TYPES):
            raise TypeError(f"rows can't be ordered by {c}")
    out = [F.col(names[c]).alias(c) for c in rows.columns] + ([F.col("place").cast("int").alias(rank_column)] if rank_column else [])
    plain = rows.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()])
    if n < 1:
        return plain.withColumn("place", F.lit(0)).filter(F.lit(False)).select(*out)
    own, scores = [names[c] for c in group], [(names[c], d) for c, d in down]
    buckets = BUCKETS * partitions(rows.sparkSession)
    cut = plain.select(F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int").alias("bucket"), *plain.columns)
    cut = cut.sortWithinPartitions("bucket", *[F.col(c).asc_nulls_last() for c in own], *[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in scores])
    runs = written(cut.mapInArrow(_run_writer(own, n), _BLOCKS))
    fan_in = FAN_IN if fan_in is None else fan_in
    width, most = runs.groupBy("bucket").agg(F.countDistinct("run").alias("w"), F.max("run").alias("r")).agg(F.max("w"), F.max("r")).head()
    width, most = width or 0, most or 0

    def merge(into, again: bool, ddl):
        r = runs.withColumn("into", into)
        return r.repartition("bucket", "into").sortWithinPartitions("bucket", "into", "run", "part").mapInArrow(_merger(own, scores, n, again), ddl)

    while width > fan_in:
        runs = written(merge(F.floor(F.col("run") / fan_in), True, _BLOCKS))
        most //= fan_in
        width = most + 1
    rows_out = T.StructType([*[T.StructField(f.name, f.dataType) for f in plain.schema], T.StructField("place", T.LongType())])
    return merge(F.lit(0).cast("long"), False, rows_out).select(*out)
