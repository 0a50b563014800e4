import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from simulate import ORD, serial, write

from adjset.functions import gf
from adjset.operators import changefeed, drift, orphans, reconcile, skew
from adjset.operators.current import EDGE, current_rows, decoded

EDGES = "graph_id int, source_id long, destination_id long, position long, updated_at long, count int, state int, loaded_at timestamp, rank string, salt_ int, h int"
NODES = "graph_id int, source_id long, state int, count int, updated_at long, loaded_at timestamp, destination_id string"
OPS = "seq long, graph_id int, source_id long, is_forward boolean, destination_ids array<long>, op int, position long, execute_at long, priority int, queued_at timestamp"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def at(seconds):
    import datetime

    return datetime.datetime.fromtimestamp(seconds)


def random_edges(r, n, ids=6):
    maybe = lambda x, p=0.06: None if r.random() < p else x
    out = []
    for _ in range(n):
        t = r.randint(1, 5)
        key = maybe(r.randint(1, 2), 0.03), maybe(r.choice([1, 1, 1, *range(ids)]), 0.03), maybe(r.randint(0, ids), 0.03)
        # tied rows of a key agree in their fields, as the tables have it
        state, v = r.choice([0, 0, 1, 2, 3]), hash((key, t)) % 3
        out.append((*key, [None, 7, 9][v], t, v, state, maybe(at(r.randint(1, 9)), 0), "x", 1, 2))
    return out + out[: n // 5]


def newest(data):
    best = {}
    for x in data:
        if None not in x[:3]:
            k = (x[4] if x[4] is not None else -1, ORD.get(x[6], -1), (x[3] is not None, x[3] or 0), (x[5] is not None, x[5] or 0))
            if x[:3] not in best or k > best[x[:3]][0]:
                best[x[:3]] = (k, x)
    return {k: v[1] for k, v in best.items()}


def test_current_rows(spark):
    data = random_edges(random.Random(1), 400) + [(1, 50, 1, 5, None, 1, 0, None, "", 0, 0), (1, 50, 2, 5, 3, 1, None, None, "", 0, 0), (1, 50, 2, None, 3, None, None, None, "", 0, 0), (1, 51, 1, 1, 3, 1, 9, None, "", 0, 0)]
    got = decoded(current_rows(spark.createDataFrame(data, EDGES), EDGE, ["position", "count"], arrival=True)).collect()
    want = newest(data)
    assert {(r.graph_id, r.source_id, r.destination_id): (r.position, r.updated_at, r["count"], r.state) for r in got} == {k: (x[3], x[4], x[5], x[6] if x[6] in ORD else None) for k, x in want.items()}
    first = {}
    for x in data:
        if None not in x[:3] and x[7] is not None:
            first[x[:3]] = min(first.get(x[:3], x[7]), x[7])
    assert all(r.arrived == first.get((r.graph_id, r.source_id, r.destination_id)) for r in got)


# --- problem 2


def test_salted_aggregate_equals_plain(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(r.choice([1, 1, 1, 1, 2, None, 3]), r.choice("ab"), r.choice([None, 1, 2, 3])) for _ in range(2000)], "k int, b string, v int")
    m = {"n": ("count", None), "nv": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "mean": ("avg", "v"), "d": ("count_distinct", "v")}
    got = skew.salted_aggregate(df, ["k"], m, by=["b"], most=2, salts=8)
    want = df.groupBy("k", "b").agg(F.count(F.lit(1)), F.count("v"), F.sum("v"), F.min("v"), F.max("v"), F.avg("v"), F.countDistinct("v"))
    assert [tuple(x) for x in rows(got)] == [tuple(x) for x in rows(want)]
    assert skew.salted_aggregate(df.limit(0), ["k"], m).count() == 0
    assert rows(skew.heavy_keys(df, ["k"], 1)) == [(1,)]


def test_salts_spread_a_hot_key_only(spark):
    df = spark.range(1000).selectExpr("if(id < 900, 0L, id) k", "id v")
    s = skew.with_salt(df, ["k"], [F.col("v")], 8, most=1)
    assert s.filter("k = 0").select("salt_").distinct().count() == 8 and s.filter("k > 0").select("salt_").distinct().count() == 1


def test_drifted_counts(spark):
    r = random.Random(4)
    data = random_edges(r, 300)
    nodes = [(r.randint(1, 2), r.choice([None, 1, 2, 3, 4, 99]), r.choice([0, 0, 1, 2, 3]), r.choice([None, 0, 1, 2, 3, 4]), r.randint(0, 3), at(5), "z") for _ in range(60)]
    edges = newest(data)
    best = {}
    for n in nodes:
        k = (n[4], ORD[n[2]], n[3] is not None, n[3] or 0)
        if n[1] is not None and (n[:2] not in best or k > best[n[:2]][0]):
            best[n[:2]] = (k, n)
    want = sorted(k for k, (_, n) in best.items() if n[3] is None or n[3] != sum(e[:2] == k and e[6] == n[2] for e in edges.values()))
    e, n = spark.createDataFrame(data, EDGES), spark.createDataFrame(nodes, NODES)
    assert rows(drift.drifted_counts(e, n).select("graph_id", "source_id")) == sorted(want, key=repr)
    assert drift.drifted_counts(e, n.limit(0)).count() == 0
    assert all(r_.edges == 0 for r_ in drift.drifted_counts(e.limit(0), n).collect())


# --- problem 4


def random_ops(r, n, wild=0.0, ids=5):
    out = []
    for i in range(n):
        t = None if r.random() < 0.1 and not wild else r.randint(1, 6)
        dest = None if r.random() < wild else [r.choice([None, *range(1, ids)]) if not wild else r.randint(1, ids) for _ in range(r.randint(0, 3))]
        out.append((r.choice([i, i, i, None]) if not wild else i, 1, r.randint(1, ids), r.random() < 0.6, dest, r.randint(1, 4), None if r.random() < 0.1 and not wild else r.randint(1, 999), t, 3, at(r.randint(1, 6) + 0.75)))
    return out + out[: n // 6]


@pytest.mark.parametrize("heavy, segment", [(50_000, 50_000), (3, 4), (0, 1)])
def test_change_feed_equals_serial_application(spark, heavy, segment):
    r = random.Random(heavy)
    base, ops = random_edges(r, 150, 5), random_ops(r, 260)
    start = {k: [x[3], x[4], x[6]] for k, x in newest(base).items()}
    end, seen = {k: list(v) for k, v in start.items()}, set()
    for seq, g, s, fwd, dest, op, pos, t, _, q in sorted((o for o in ops if o[0] is not None), key=lambda o: o[0]):
        if seq not in seen and not seen.add(seq):
            for d in dest:
                if d is not None:
                    sec = q.timestamp()
                    write(end, (g, s, d) if fwd else (g, d, s), int(sec) if t is None else t, {1: 0, 2: 1, 3: 2, 4: 3}[op], int(sec * 1000) * 1048576 if pos is None else pos)
    b, o = spark.createDataFrame(base, EDGES), spark.createDataFrame(ops, OPS).repartition(5)
    changes = changefeed.signed_changes(b, o, heavy, segment)
    plus = {tuple(x[:3]): (x.position, x.updated_at, x.state) for x in changes.filter("multiplicity > 0").collect()}
    assert plus == {k: tuple(v) for k, v in end.items() if start.get(k) != v}
    minus = {tuple(x[:3]): (x.position, x.updated_at, x.state) for x in changes.filter("multiplicity < 0").collect()}
    assert minus == {k: tuple(start[k]) for k in plus if k in start}
    table = {tuple(x[:3]): (x.position, x.updated_at, x.state) for x in changefeed.consolidated(b, changes).collect()}
    assert table == {k: tuple(v) for k, v in end.items()}


def test_change_feed_of_nothing(spark):
    b, o = spark.createDataFrame(random_edges(random.Random(1), 20), EDGES), spark.createDataFrame([(1, 1, 1, True, None, 1, 1, 1, 3, None), (2, 1, 1, True, [], 1, 1, 1, 3, None), (3, 1, 1, True, [4], 9, 1, 1, 3, None)], OPS)
    assert changefeed.signed_changes(b, o).count() == 0
    assert changefeed.signed_changes(b.limit(0), o.limit(0)).count() == 0
    assert changefeed.consolidated(b, changefeed.signed_changes(b, o)).count() == len(newest(random_edges(random.Random(1), 20)))


# --- problem 5


def test_field_products_and_roots():
    import numpy as np

    r = random.Random(9)
    a, b = ([r.randrange(gf.P) for _ in range(50)] for _ in range(2))
    assert gf.mul(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % gf.P for x, y in zip(a, b)]
    assert gf.sub(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [(x - y) % gf.P for x, y in zip(a, b)]
    zs = gf.points(3)
    v = gf.products(np.array(a, np.uint64), np.array([0, 7, 8]), np.array(zs, np.uint64))
    for row, part in zip(v.tolist(), (a[:7], a[7:8], a[8:])):
        for got, z in zip(row, zs):
            want = 1
            for h in part:
                want = want * (z - h) % gf.P
            assert got == want


def test_inverses_and_systems():
    import numpy as np

    r = random.Random(5)
    x = np.array([0, 1, 2, gf.P - 1, *(r.randrange(gf.P) for _ in range(20))], np.uint64)
    assert gf.mul(x, gf.inverses(x)).tolist() == [0] + [1] * 23
    m = np.array([[[2, 1, 5], [4, 2, 10]], [[2, 1, 5], [4, 2, 11]], [[0, 3, 9], [7, 0, 21]]], np.uint64)
    got, ok = gf.solve(m)
    assert ok.tolist() == [True, False, True] and got[2].tolist() == [3, 3] and got[0].tolist() == [5 * pow(2, -1, gf.P) % gf.P, 0]


def test_reconciliation_finds_the_differences_of_many_pairs():
    import numpy as np

    r, zs, pairs = random.Random(10), gf.points(20), []
    for only_a, only_b in itertools.product([0, 1, 2, 7, 11], [0, 1, 5, 7, 30]):
        pairs.append([[r.randrange(gf.P) for _ in range(n)] for n in (40, only_a, only_b)])
    evals = lambda s: gf.products(np.array(s, np.uint64), np.array([0]), np.array(zs, np.uint64))[0]
    ea, eb = np.stack([evals(c + x) for c, x, _ in pairs]), np.stack([evals(c + y) for c, _, y in pairs])
    size = [np.array([40 + len(p[i]) for p in pairs]) for i in (1, 2)]
    pa, pb, ok = gf.differences(ea, eb, *size, zs)
    for (common, x, y), p, q, solved in zip(pairs, pa, pb, ok):
        assert solved == (len(x) + len(y) <= 18)  # too many differences are not guessed
        if solved:
            hit = lambda poly, h: gf.roots(np.tile(poly, (len(h), 1)), np.array(h, np.uint64)).tolist()
            assert hit(p, x + common) == [True] * len(x) + [False] * 40 and hit(q, y + common) == [True] * len(y) + [False] * 40


def plain_differences(a, b):
    x, y = newest(a), newest(b)
    out = [(*k, "missing_in_replica") for k in x.keys() - y.keys()] + [(*k, "missing_in_primary") for k in y.keys() - x.keys()]
    for k in x.keys() & y.keys():
        out += [(*k, f) for f, i in (("position", 3), ("updated_at", 4), ("count", 5), ("state", 6)) if x[k][i] != y[k][i]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("share, buckets", [(0.0, 4), (0.03, 8), (0.5, 4), (1.0, 1)])
def test_copy_differences_equal_a_plain_comparison(spark, share, buckets):
    r = random.Random(int(share * 100))
    a = random_edges(r, 500, 30)
    b = [x if r.random() >= share else (*x[:3], r.choice([None, 8]), x[4], x[5], x[6], *x[7:]) if r.random() < 0.5 else (*x[:6], r.choice([0, 1]), *x[7:]) for x in a if r.random() >= share / 3]
    b += [(1, 900 + i, 1, 5, 5, 5, 0, None, "", 0, 0) for i in range(int(20 * share))]
    b = list({(x[:3], x[4], x[6]): x for x in b}.values())
    r.shuffle(b)
    got = reconcile.copy_differences(spark.createDataFrame(a, EDGES), spark.createDataFrame(b, EDGES), buckets)
    assert rows(got) == plain_differences(a, b)


def test_differences_with_an_empty_copy(spark):
    a = random_edges(random.Random(1), 60, 20)
    x = spark.createDataFrame(a, EDGES)
    assert rows(reconcile.copy_differences(x, x.limit(0))) == plain_differences(a, [])
    assert rows(reconcile.copy_differences(x.limit(0), x)) == plain_differences([], a)
    assert reconcile.copy_differences(x.limit(0), x.limit(0)).count() == 0


# --- problem 6


@pytest.mark.parametrize("most, heavy_refs", [(1, 10), (256, 10), (256, 10_000)])
def test_orphans_equal_brute_force(spark, most, heavy_refs):
    r = random.Random(6)
    data = random_edges(r, 400, 12)
    nodes = [(r.randint(1, 2), r.choice([None, *range(9)]), r.choice([0, 0, 1, 2]), 1, r.randint(0, 3), at(r.randint(1, 9)), "z") for _ in range(25)]
    edges, first, state = newest(data), {}, {}
    for x in data:
        if None not in x[:3]:
            first[x[:3]] = min(first.get(x[:3], x[7]), x[7])
    for n in nodes:
        if n[1] is not None:
            old = state.get(n[:2])
            k = (n[4], ORD[n[2]])
            state[n[:2]] = (max(k, old[0]) if old else k, min(n[5], old[1]) if old else n[5])
    want = []
    for k, e in edges.items():
        for field, node in (("source_id", k[1]), ("destination_id", k[2])):
            n = state.get((k[0], node))
            kind = "missing" if n is None else "deleted" if n[0][1] == 3 and e[6] != 1 else "late" if n[1] > first[k] else None
            if kind:
                want.append((*k, field, kind))
    e, n = spark.createDataFrame(data, EDGES), spark.createDataFrame(nodes, NODES)
    found = orphans.orphan_references(e, n, salts=3, most=most, heavy_refs=heavy_refs)
    assert rows(found.drop("updated_at")) == sorted(want, key=repr)
    months = orphans.orphans_by_month(found).collect()
    assert sum(m.references for m in months) == len(want) and {m.period for m in months} == {"1970-01"}
    assert orphans.orphan_references(e, n.limit(0)).filter("kind != 'missing'").count() == 0
    assert orphans.orphan_references(e.limit(0), n).count() == 0


def test_signed_counts_are_kept_up_by_deltas(spark):
    r = random.Random(8)
    e = spark.createDataFrame(random_edges(r, 100), EDGES)
    n = spark.createDataFrame([(1, i, i % 2, 1, 1, at(3), "") for i in range(4)], NODES)
    d1, d2 = orphans.reference_deltas(orphans.references(e)), orphans.existence_deltas(n)
    assert rows(orphans.signed_counts(orphans.signed_counts(d1), d2)) == rows(orphans.signed_counts(d1, d2))


def test_serial_simulator_agrees_on_counts():
    edges, _ = serial([(1, 1, 1, True, [2], 1, 5, 5), (2, 1, 1, True, None, 3, None, 6)])
    assert Counter(v[2] for v in edges.values()) == {2: 1}


def test_buckets_follow_the_larger_copy(spark, monkeypatch):
    from adjset.operators import reconcile

    monkeypatch.setattr(reconcile, "BUCKET_ROWS", 20)
    hashed, sizes = reconcile._hashed, []

    def watched(x, parts, per_part):
        out = hashed(x, parts, per_part)
        sizes.extend(r["count"] for r in out.groupBy("bucket").count().collect())
        return out

    monkeypatch.setattr(reconcile, "_hashed", watched)
    b = spark.range(1500).selectExpr("1 graph_id", "id % 7 source_id", "id destination_id", "id position", "5L updated_at", "0 count", "0 state")
    got = reconcile.copy_differences(b.limit(0), b)
    assert {(r.destination_id, r.field) for r in got.collect()} == {(i, "missing_in_primary") for i in range(1500)}
    assert max(sizes) <= 60


def test_copies_without_a_row_in_common(spark):
    a = spark.range(700).selectExpr("1 graph_id", "id % 7 source_id", "id destination_id", "id position", "5L updated_at", "0 count", "0 state")
    b = a.selectExpr("graph_id", "source_id", "destination_id", "position + 1 position", "updated_at", "count", "1 state")
    got = reconcile.copy_differences(a, b)
    assert {(r.destination_id, r.field) for r in got.collect()} == {(i, f) for i in range(700) for f in ("position", "state")}
