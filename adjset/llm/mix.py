"""Mixing sources to target weights.

Method: a splitting tree over exact quotas. The documents of a source stand in a random order, which is a hash of the
document, and lie in blocks of that order. A source's quota is met by whole passes and by one more pass up to a cut in the
order: the blocks' totals tell the block that holds the cut, and within that block documents are chosen until no change of
one or exchange of two comes nearer. Then each mix's uses per source are split among its output shards by recursive halving
with draws from the multivariate hypergeometric distribution, so quotas stay exact. Every shard takes its own range of
each source's uses, which stand in random order once more, and is put in random order by itself. The number of shards
follows from the size of the mix, so every step is spread over tasks of bounded size.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.session import written
from .encode import encode_corpus

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of the random order, documents meant for one block of it, and ranks of uses that are looked up together.
ORDER_BITS, BLOCK_DOCS, BIN = 56, 20_000, 256
#: Documents at a cut up to which exchanges of two for two are tried.
PAIRED = 400
#: Tokens meant for one output shard.
SHARD_TOKENS = 1 << 22
#: Rows that a table of targets may have, since it goes to every task.
MOST_TARGETS = 10_000
#: Shards whose part of the splitting tree one task works out, and what numpy can draw from at once.
SUBTREE, MOST_DRAWN = 4096, 10**9 - 1


def _order(seed: int, *more: Column) -> Column:
    """Place in the random order, 0 to 2**ORDER_BITS - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *more), 64 - ORDER_BITS)


def block_bits(n: int) -> int:
    """Bits of the order that number the blocks of a source with n documents."""
    return (n // BLOCK_DOCS).bit_length()


def quotas(targets: list[dict], tokens: dict[tuple, int]) -> dict[tuple, float]:
    """(mix, source) -> tokens wanted: the largest mix whose shares are exact for the sources that have any tokens.

    A source without documents can't be given, and the others keep their proportions. Shares that are null or not
    positive and sources that may not be used (max_repeats below 1) want nothing; a null max_repeats is 1.
    """
    out: dict[tuple, float] = {}
    for mix in {t["mix_id"] for t in targets}:
        own = [t for t in targets if t["mix_id"] == mix and (t["target_share"] or 0) > 0 and t["cap"] >= 1 and tokens.get((mix, t["source"]), 0) > 0]
        whole = sum(t["target_share"] for t in own)
        if own:
            size = min(t["cap"] * tokens[mix, t["source"]] * whole / t["target_share"] for t in own)
            out |= {(mix, t["source"]): size * t["target_share"] / whole for t in own}
    return out


def drawn(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among ``take`` items drawn without replacement. Very many items are drawn from in parts of
    the same composition."""
    total = int(counts.sum())
    m = total // MOST_DRAWN + 1
    out, done, used = counts * 0, counts * 0, 0
    for j in range(1, m + 1):
        upto = counts * j // m
        part, goal = upto - done, take * int(upto.sum()) // max(1, total)
        if part.sum():
            out = out + rng.multivariate_hypergeometric(part, goal - used, method="marginals")
        done, used = upto, goal
    return out


def split_counts(counts: np.ndarray, shards: int, seed, first: int = 0) -> np.ndarray:
    """Counts per source -> (shards, sources), exact in both sums: each half of the shards draws its part of all items without
    replacement, and so on down to single shards. A node of the tree draws by its place, so it can be worked out anywhere."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    a, b = _halved(counts, shards, seed, first)
    return np.concatenate([split_counts(a, left, seed, first), split_counts(b, shards - left, seed, first + left)])


def _halved(counts: np.ndarray, shards: int, seed, first: int) -> tuple[np.ndarray, np.ndarray]:
    got = drawn(counts, int(counts.sum()) * (shards // 2) // shards, np.random.default_rng([*seed, first, shards]))
    return got, counts - got


def _subtrees(counts: np.ndarray, shards: int, seed, first: int = 0):
    """The nodes of the tree with at most SUBTREE shards."""
    if shards <= SUBTREE:
        yield first, shards, counts
        return
    left = shards // 2
    a, b = _halved(counts, shards, seed, first)
    yield from _subtrees(a, left, seed, first)
    yield from _subtrees(b, shards - left, seed, first + left)


def _leaves(seed: int):
    def run(batches):
        for b in batches:
            for mix, first, shards, sources, counts in zip(*[c.to_pylist() for c in b.columns]):
                parts = split_counts(np.array(counts, np.int64), shards, [seed, mix & 0xFFFFFFFF], first)
                n = shards * len(sources)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, mix, np.int32)), pa.array(np.repeat(np.arange(first, first + shards, dtype=np.int64), len(sources))), pa.array(sources * shards, pa.string()), pa.array(parts.reshape(-1))], names=["mix_id", "shard", "source", "n"])

    return run


def _picks(tokens: np.ndarray, which: np.ndarray, two: bool) -> tuple[np.ndarray, np.ndarray]:
    """All choices of none, one and, if asked for, two of some documents: (choices, 2) numbers, -1 for none, and their sums."""
    i = np.stack([np.append(-1, which), np.full(len(which) + 1, -1)], 1)
    if two:
        i = np.concatenate([i, np.stack([which[x] for x in np.triu_indices(len(which), 1)], 1)])
    t = np.append(tokens, 0)  # number -1 is this 0
    return i, t[i].sum(1)


def nearest(tokens: np.ndarray, goal: float) -> np.ndarray:
    """Which of some documents to take so that their tokens come near to ``goal``: those in front whose sum is nearest, and
    from there the best exchange of at most one document for at most one other (two for two where there are at most PAIRED
    documents), again and again while it comes nearer."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    inside = np.arange(len(tokens)) < int(np.abs(sums - goal).argmin())
    off = goal - sums[int(inside.sum())]
    two = len(tokens) <= PAIRED
    while abs(off) >= 0.5:
        ins, a = _picks(tokens, np.flatnonzero(inside), two)
        outs, b = _picks(tokens, np.flatnonzero(~inside), two)
        o = np.argsort(b, kind="stable")
        at = np.searchsorted(b[o], a + off)
        best = None
        for k in (np.maximum(at - 1, 0), np.minimum(at, len(b) - 1)):
            left = np.abs(off - (b[o[k]] - a))
            i = int(left.argmin())
            if left[i] < abs(off) - 1e-9 and (best is None or left[i] < best[0]):
                best = left[i], i, o[k[i]]
        if best is None:
            break
        _, i, j = best
        off -= b[j] - a[i]
        inside[ins[i][ins[i] >= 0]] = False
        inside[outs[j][outs[j] >= 0]] = True
    return inside


def _chosen(t: pa.Table) -> pa.Table:
    """The documents of a block at a cut, with their numbers of uses."""
    t = t.sort_by([("u", "ascending"), ("doc_id", "ascending")])
    take = nearest(t.column("n_tokens").to_numpy(), t.column("left")[0].as_py())
    times = t.column("passes").to_numpy() + take
    return t.select(["mix_id", "source", "doc_id", "n_tokens"]).append_column("times", pa.array(times.astype(np.int32)))


def _sized(docs: DataFrame, targets: DataFrame, seed: int, ranks_path: str | None) -> tuple[DataFrame, list[dict]]:
    spark = docs.sparkSession
    rows = targets.select("mix_id", "source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("cap")).dropna(subset=["mix_id", "source"])
    rows = rows.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("cap").alias("cap")).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted = [r.asDict() for r in rows]
    size = encode_corpus(docs, ["doc_id", "source"], ranks_path=ranks_path, lengths_only=True).filter(F.col("n_tokens") > 0)
    pairs = spark.createDataFrame([(t["mix_id"], t["source"]) for t in wanted] or [], "mix_id int, source string")
    sized = size.join(F.broadcast(pairs), "source").withColumn("u", _order(seed, F.col("mix_id"), F.col("doc_id")))
    return written(sized.select("mix_id", "source", "doc_id", "n_tokens", "u")), wanted


def _times(sized: DataFrame, quota: dict[tuple, float], totals: dict[tuple, tuple[int, int]]) -> DataFrame:
    """mix_id, source, doc_id, n_tokens, times: how often each document is used, those not used left out."""
    spark = sized.sparkSession
    key = ["mix_id", "source"]
    passes = {k: int(q // totals[k][0] + 1e-9) for k, q in quota.items()}
    plan = spark.createDataFrame([(*k, passes[k], float(q - passes[k] * totals[k][0]), block_bits(totals[k][1])) for k, q in quota.items()] or [], "mix_id int, source string, passes int, rest double, bits int")
    rows = sized.join(F.broadcast(plan), key).withColumn("block", F.expr(f"shiftright(u, {ORDER_BITS} - bits)"))
    # the cut lies in the first block with which the sum passes what is left of the quota
    sums = rows.groupBy(*key, "block", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(W.partitionBy(*key).orderBy("block"))
    cuts = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest")).groupBy(*key).agg(F.min(F.struct("block", (F.col("rest") - F.col("upto") + F.col("t")).alias("left"))).alias("c"))
    cut = spark.createDataFrame([(r["mix_id"], r["source"], r["c"]["block"], float(r["c"]["left"])) for r in cuts.collect()], "mix_id int, source string, cut long, left double")
    r = rows.join(F.broadcast(cut), key, "left")
    whole = r.filter(F.col("cut").isNull() | (F.col("block") != F.col("cut")))
    whole = whole.select(*key, "doc_id", "n_tokens", (F.col("passes") + (F.coalesce(F.col("block") < F.col("cut"), F.lit(True))).cast("int")).alias("times"))
    pool = r.filter(F.col("block") == F.col("cut")).select(*key, "doc_id", "n_tokens", "u", "passes", "left")
    kind = dict(sized.dtypes)["doc_id"]
    chosen = pool.groupBy(*key).applyInArrow(_chosen, f"mix_id int, source string, doc_id {kind}, n_tokens long, times int")
    return whole.unionByName(chosen).filter("times > 0")


def mix_sources(docs: DataFrame, targets: DataFrame, shard_tokens: int = SHARD_TOKENS, seed: int = 1, ranks_path: str | None = None) -> DataFrame:
    """mix_id, shard, place, source, doc_id, copy, n_tokens, target_share, reached_share: the mixed corpus.

    doc_id identifies a document here. One row per use of a document, ordered at random by ``place`` within its shard; a shard
    has about ``shard_tokens`` tokens. Each source's tokens are as near to its share of the largest possible mix as whole
    documents come: no other choice of one or two documents of the block at the cut, which for a small source are all its
    documents, comes nearer. No document is used more than max_repeats times, and the uses of two documents of a source
    differ by one at most. reached_share is the part of all tokens that the source has. Documents of other sources, of a
    null source or without tokens aren't used; a mix none of whose sources has documents has no rows.
    """
    spark = docs.sparkSession
    key = ["mix_id", "source"]
    sized, wanted = _sized(docs, targets, seed, ranks_path)
    # what is collected here and below has a row per target at most
    own = sized.groupBy(*key).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    totals = {(r["mix_id"], r["source"]): (r["t"], r["n"]) for r in own}
    used = written(_times(sized, quotas(wanted, {k: t for k, (t, _) in totals.items()}), totals))
    got = used.groupBy(*key).agg(F.sum("times").cast("long").alias("n"), F.sum(F.col("times") * F.col("n_tokens")).alias("t")).orderBy(*key).collect()
    mixes: dict[int, list] = {}
    for r in got:
        mixes.setdefault(r["mix_id"], []).append(r)
    share = {(t["mix_id"], t["source"]): t["target_share"] for t in wanted}
    plan, nodes = [], []
    for mix, rs in mixes.items():
        all_tokens = sum(r["t"] for r in rs)
        shards = max(1, -(-all_tokens // shard_tokens))
        plan += [(mix, r["source"], share[mix, r["source"]], r["t"] / all_tokens, block_bits(r["n"])) for r in rs]
        sources, counts = [r["source"] for r in rs], np.array([r["n"] for r in rs], np.int64)
        nodes += [(mix, first, n, sources, c.tolist()) for first, n, c in _subtrees(counts, shards, [seed, mix & 0xFFFFFFFF])]
    tree = spark.createDataFrame(nodes, "mix_id int, first long, shards int, sources array<string>, counts array<long>").repartition(max(1, len(nodes)))
    parts = tree.mapInArrow(_leaves(seed), "mix_id int, shard long, source string, n long").filter("n > 0")
    upto = F.sum("n").over(W.partitionBy(*key).orderBy("shard"))
    ranges = parts.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("n"))
    ranges = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor((F.col("hi") - 1) / BIN)))).select(*key, "bin", "shard", "lo", "hi")
    # uses in a random order of their own, numbered from 0: within blocks, which start where those before them end
    p = spark.createDataFrame(plan, "mix_id int, source string, target_share double, reached_share double, bits int")
    uses = used.join(F.broadcast(p), key).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).withColumn("v", _order(seed + 1, F.col("mix_id"), F.col("doc_id"), F.col("copy")))
    uses = uses.withColumn("block", F.expr(f"shiftright(v, {ORDER_BITS} - bits)")).drop("times", "bits")
    before = uses.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(*key, "block", (F.sum("n").over(W.partitionBy(*key).orderBy("block")) - F.col("n")).alias("start"))
    w = W.partitionBy(*key, "block").orderBy("v", "doc_id", "copy")
    uses = uses.withColumn("k", F.row_number().over(w)).join(before, [*key, "block"]).withColumn("k", F.col("start") + F.col("k") - 1)
    uses = uses.withColumn("bin", F.floor(F.col("k") / BIN)).join(ranges, [*key, "bin"]).filter((F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
    place = F.row_number().over(W.partitionBy("mix_id", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "v"), "doc_id", "copy"))
    return uses.select("mix_id", "shard", place.alias("place"), "source", "doc_id", "copy", "n_tokens", "target_share", "reached_share")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, target_share, reached_share, tokens, documents, most_repeats: the report of a mix, sources without
    documents included."""
    got = mixed.groupBy("mix_id", "source").agg(F.max("reached_share").alias("reached_share"), F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("copy").alias("most_repeats"))
    t = targets.select("mix_id", "source", "target_share").join(got, ["mix_id", "source"], "left")
    return t.select("mix_id", "source", "target_share", F.coalesce("reached_share", F.lit(0.0)).alias("reached_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "most_repeats")])


def mix_attained(mixed: DataFrame, targets: DataFrame, within: float = 0.01) -> DataFrame:
    """mix_id, source, attainable, near, within_cap: what a mix could reach at best and whether it did.

    attainable is the target share among the sources of the mix that were used at all, 0 for the others, to six places; near whether the share
    reached is nearer than ``within`` to it, within_cap whether no document is used more often than it may be.
    """
    s = mix_shares(mixed, targets).join(targets.select("mix_id", "source", F.coalesce("max_repeats", F.lit(1)).alias("cap")), ["mix_id", "source"])
    mine = F.when(F.col("documents") > 0, F.col("target_share")).otherwise(F.lit(0.0))
    at = mine / F.sum(mine).over(W.partitionBy("mix_id"))
    return s.select("mix_id", "source", F.round(at, 6).alias("attainable"), (F.abs(F.col("reached_share") - at) < within).alias("near"), (F.col("most_repeats") <= F.col("cap")).alias("within_cap"))
