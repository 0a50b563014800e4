"""Overlap sizes between many large sets.

Method: identifiers are range-partitioned. Each task holds, of its range, a sorted run per set, and merges all runs with a
heap; at each identifier the counters of all co-present pairs go up by one, some identifiers at a time. Only counters
leave a task, and sums of counters are the exact overlaps: no intersection is made, and no pair is written per identifier.

An identifier in very many sets would have one task count all its pairs. Its sets are dealt to blocks, and each pair of
blocks is a group of its own, so a group has at most some BLOCK**2 pairs and every pair is still counted once.
"""

from __future__ import annotations

import heapq
import itertools
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import written
from ..operators.skew import HEAVY, SALTS, salted_join

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sets that one group holds of an identifier, per block.
BLOCK = 2048
#: Pairs that a task makes in one step, and counters it holds before it hands them on.
STEP, HELD = 1 << 20, 1 << 22
_NAMES = ["graph_id", "set_a", "set_b", "size_a", "size_b"]


def merged_runs(starts: list[int], ends: list[int], ids: list[int]):
    """Sorted runs, given as places in ``ids``, merged with a heap: the numbers of the runs that hold an identifier together,
    for every identifier that two or more hold."""
    at = list(starts)
    heap = [(ids[i], r) for r, i in enumerate(starts)]
    heapq.heapify(heap)
    while heap:
        x, r = heap[0]
        present = []
        while True:
            present.append(r)
            at[r] = i = at[r] + 1
            if i < ends[r]:
                heapq.heapreplace(heap, (ids[i], r))
            else:
                heapq.heappop(heap)
                if not heap:
                    break
            y, r = heap[0]
            if y != x:
                break
        if len(present) > 1:
            yield present


def _counter(share: float):
    """Rows sorted by graph, pair of blocks, set and identifier -> counters of pairs. share: pairs whose sizes rule out that
    Jaccard similarity are left out."""

    def pairs(members, lens, blk, s, size, split):
        """Pairs of the sets present together at some identifiers, in chunks: numbers of runs. Those of an identifier stand in
        order of their sets, so the first of a pair is the lesser."""
        n = len(members)
        k = np.repeat(np.cumsum(lens), lens) - np.arange(n) - 1
        total = np.cumsum(k)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + STEP, "right")))
            c = k[i:j]
            left = np.repeat(np.arange(i, j), c)
            a, b = members[left], members[left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)]
            ok = np.minimum(size[a], size[b]) >= share * np.maximum(size[a], size[b])
            if split:
                ok &= blk[a] != blk[b]
            yield a[ok], b[ok]
            i = j

    def counted(t: pa.Table):
        """Counters of one graph and pair of blocks."""
        g, lo, hi, blk, s, size, d = (c.to_numpy() for c in t.combine_chunks().columns)
        starts = np.append(0, np.flatnonzero(s[1:] != s[:-1]) + 1)
        ends = np.append(starts[1:], len(s))
        blk, s, size, split = blk[starts], s[starts], size[starts], bool(lo[0] != hi[0])
        ranks = d.tolist()
        members, lens, due = [], [], 0
        sums: list[pa.Table] = []
        held = 0

        def flush():
            for a, b in pairs(np.array(members, np.int64), np.array(lens, np.int64), blk, s, size, split):
                code, n = np.unique(a * len(s) + b, return_counts=True)
                yield pa.table({"a": code // len(s), "b": code % len(s), "shared": n})

        def summed(parts):
            t = pa.concat_tables(parts).group_by(["a", "b"], use_threads=False).aggregate([("shared", "sum")])
            return t.rename_columns(["a", "b", "shared"])

        def batch(t):
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), g[0], g.dtype)), pa.array(s[a]), pa.array(s[b]), pa.array(size[a]), pa.array(size[b]), t.column("shared").combine_chunks().cast(pa.int64())], names=[*_NAMES, "shared"])

        for present in merged_runs(starts.tolist(), ends.tolist(), ranks):
            members += present
            lens.append(len(present))
            due += len(present) * (len(present) - 1) // 2
            if due > STEP:
                new = list(flush())
                sums += new
                held += sum(x.num_rows for x in new)
                members, lens, due = [], [], 0
                if held > HELD:
                    sums = [summed(sums)]
                    held = sums[0].num_rows
                    if held > HELD // 2:
                        yield batch(sums[0])
                        sums, held = [], 0
        sums += flush()
        if sums:
            yield batch(summed(sums))

    def run(batches):
        rest = None
        for b in itertools.chain(batches, [None]):
            if b is not None and not b.num_rows:
                continue
            t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            rest = None
            if t is None:
                continue
            if b is not None and all(t.column(c)[0] == b.column(c)[b.num_rows - 1] for c in ("graph_id", "lo", "hi")):
                rest = t  # one merge so far
                continue
            g, lo, hi = (t.column(c).to_numpy() for c in ("graph_id", "lo", "hi"))
            edges = (np.flatnonzero((g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist()
            bounds = [0, *edges, t.num_rows]
            for i, j in zip(bounds, bounds[1:]):
                if j == t.num_rows and b is not None:
                    rest = t.slice(i)
                else:
                    yield from counted(t.slice(i, j - i))

    return run


def overlap_sizes(members: DataFrame, set_column: str = "source_id", id_column: str = "destination_id", least: int = 1, share: float = 0.0, block: int = BLOCK, salts: int = SALTS) -> DataFrame:
    """graph_id, set_a, set_b, size_a, size_b, shared: exact overlaps of all pairs of sets of one graph that share anything.

    members: graph_id, a set and an identifier per row, of which repeated rows count once and rows with nulls not at all.
    Only sets of ``least`` identifiers or more take part; set_a < set_b. With ``share``, only pairs come out whose shared
    identifiers are at least that part of all distinct identifiers of the two. Nothing is estimated or left out.
    """
    # read for the sizes, the popular identifiers and the counting: written once instead of made three times
    m = written(members.select("graph_id", F.col(set_column).alias("s"), F.col(id_column).alias("d")).dropna().dropDuplicates())
    sizes = m.groupBy("graph_id", "s").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    heavy = sizes.orderBy(F.desc("size"), "graph_id", "s").limit(HEAVY)
    m = salted_join(m, sizes, ["graph_id", "s"], [F.col("d")], heavy, salts)
    popular = written(m.groupBy("graph_id", "d").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > block))
    hot = popular.orderBy(F.desc("k"), "graph_id", "d").limit(HEAVY)
    m = salted_join(m, popular, ["graph_id", "d"], [F.col("s")], hot, salts, "left")
    blocks = F.coalesce(F.ceil(F.col("k") / block), F.lit(1)).cast("int")
    m = m.withColumn("n", blocks).withColumn("blk", F.pmod(F.xxhash64("s"), F.col("n")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    m = m.select("graph_id", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "s", "size", "d")
    # a range of identifiers per task, and in it the sets' runs one after another
    ranged = m.repartitionByRange("graph_id", "d", "lo", "hi").sortWithinPartitions("graph_id", "lo", "hi", "s", "d")
    kind = dict(m.dtypes)
    counted = ranged.mapInArrow(_counter(share), f"graph_id {kind['graph_id']}, set_a {kind['s']}, set_b {kind['s']}, size_a long, size_b long, shared long")
    out = counted.groupBy(*_NAMES).agg(F.sum("shared").alias("shared"))
    return out.filter(F.col("shared") >= share * (F.col("size_a") + F.col("size_b") - F.col("shared"))) if share else out
