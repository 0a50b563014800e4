import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from simulate import serial

from adjset import api
from adjset.functions import lattice as L
from adjset.functions import packed, position
from adjset.model import EDGES, END, NODES, OPS, START, Cursor, GraphError
from adjset.operators import algebra, repair
from adjset.operators.algebra import Term, from_postfix, to_postfix
from adjset.operators.fold import both_directions, fold_ops, mass_ops, node_table, node_timeline
from adjset.operators.paging import keyset_pages, pages, scan_after
from adjset.sources.jobs import parse_jobs, to_jobs
from adjset.sources.store import GraphStore, bucket_column, bucket_of
from adjset.streaming.ops import drain, enqueue, read_ops, requeue, stream_ops

ADD, REMOVE, ARCHIVE, NEGATE = 1, 2, 3, 4
N, R, A, NEG = 0, 1, 2, 3


def ops_df(spark, ops):
    return spark.createDataFrame([(*o[:5], o[5], o[6], o[7], 3, None) for o in ops], OPS)


def folded(spark, ops):
    return {tuple(x[:3]): (x.position, x.updated_at, x.state) for x in fold_ops(ops_df(spark, ops)).collect()}


# --- the edge state machine, one edge at times t = 100 and later


STATES = [
    ([(ADD, 1, 0), (ADD, 2, 10)], (1, 110, N)), ([(ARCHIVE, 1, 0), (ADD, 2, 10)], (1, 110, N)), ([(ADD, 1, 0), (ADD, 1, -1)], (1, 100, N)),
    ([(REMOVE, 1, 0), (ADD, 1, 0)], (1, 100, R)), ([(ARCHIVE, 1, 0), (ADD, 1, 0)], (1, 100, A)), ([(NEGATE, 1, 0), (ADD, 1, 0)], (1, 100, NEG)), ([(ADD, 1, 0), (REMOVE, 2, 10)], (1, 110, R)),
    ([(REMOVE, 1, 0), (ARCHIVE, 1, 0)], (1, 100, R)), ([(REMOVE, 1, 0), (REMOVE, 1, 2), (ADD, 1, 1)], (1, 102, R)), ([(ADD, 1, 0), (ARCHIVE, 1, 0)], (1, 100, A)), ([(REMOVE, 1, 0), (ADD, 9, 1)], (9, 101, N)),
]


def test_edge_states(spark):
    ops = [(g * 10 + i, g, 1, True, [2], op, pos, 100 + t) for g, (steps, _) in enumerate(STATES) for i, (op, pos, t) in enumerate(steps)]
    assert folded(spark, ops) == {(g, 1, 2): want for g, (_, want) in enumerate(STATES)}


def test_fold_equals_serial_application(spark):
    r = random.Random(11)
    logs = []
    for graph in range(120):  # a graph per log, so that one job folds them all
        for i in range(r.randint(1, 14)):
            ids = None if r.random() < 0.3 else [r.randint(1, 4) for _ in range(r.randint(1, 2))]
            logs.append((graph * 1000 + i, graph, r.randint(1, 4), r.random() < 0.6, ids, r.randint(1, 4), r.randint(1, 999), r.randint(1, 6)))
    edges, nodes = serial(logs)
    df = ops_df(spark, logs)
    got = {tuple(x[:3]): [x.position, x.updated_at, x.state] for x in fold_ops(df).collect()}
    assert got == edges
    table = {(x.graph_id, x.direction, x.source_id): (x.updated_at, x.state, x["count"]) for x in node_table(fold_ops(df), node_timeline(mass_ops(df))).collect()}
    want = {}
    for n in {(g, 0, s) for g, s, _ in edges} | {(g, 1, d) for g, _, d in edges} | set(nodes):
        t, state = nodes.get(n, (0, 0))
        want[n] = (t, state, sum(e[2] == state for k, e in edges.items() if k[0] == n[0] and k[1 + n[1]] == n[2]))
    assert table == want


def test_endpoint_dominance(spark):
    cases = [(N, N, N, N), (N, A, N, A), (N, N, A, A), (R, N, N, R), (A, N, N, A), (A, N, R, R), (A, R, N, R)]
    op = {N: ADD, R: REMOVE, A: ARCHIVE}
    ops = [o for g, (job, s, d, _) in enumerate(cases) for o in [(g * 10, g, 1, True, None, op[s], None, 1), (g * 10 + 1, g, 2, False, None, op[d], None, 1), (g * 10 + 2, g, 1, True, [2], op[job], 5, 5)]]
    assert {k[0]: v[2] for k, v in folded(spark, ops).items()} == {g: c[3] for g, c in enumerate(cases)}


def test_node_states(spark):
    cases = [([(ADD, 0), (ARCHIVE, -1)], N), ([(ADD, 0), (REMOVE, 0), (ADD, 0)], R), ([(ADD, 0), (ARCHIVE, 0), (ADD, 0)], A), ([(ADD, 0), (NEGATE, 0), (ADD, 0)], NEG), ([(NEGATE, 0), (ARCHIVE, 0), (NEGATE, 0)], A), ([(ARCHIVE, 0), (REMOVE, 0), (ARCHIVE, 0)], R)]
    df = ops_df(spark, [(g * 10 + i, g, 1, True, None, op, None, 100 + t) for g, (ops, _) in enumerate(cases) for i, (op, t) in enumerate(ops)])
    n = node_table(fold_ops(df), node_timeline(mass_ops(df))).collect()
    assert {x.graph_id: (x.state, x["count"]) for x in n} == {g: (want, 0) for g, (_, want) in enumerate(cases)}


def test_archive_and_unarchive_a_node(spark):
    g = api.Graphs.from_ops(ops_df(spark, [(1, 1, 1, True, [2, 3, 4], ADD, 5, 10), (2, 1, 5, True, [1], ADD, 5, 10)]), [1])
    count = lambda h: (h.count(api.select(1, 1)), h.count(api.select(None, 1, 1)))
    assert count(g) == (3, 1)
    g = g.execute(api.archive(1, 1).at(20), api.archive(None, 1, 1).at(20))
    assert count(g) == (0, 0)
    g = g.execute(api.unarchive(1, 1).at(30), api.unarchive(None, 1, 1).at(30))
    assert count(g) == (3, 1)
    assert g.exact_count(api.select(1, 1)) == 3


# --- pages


def edge_rows(spark, graph):
    return both_directions(spark.createDataFrame(graph, "graph_id int, source_id long, destination_id long, position long, updated_at long, count int, state int"))


def graphs(spark, sets, positions=None):
    """source -> destinations; position is the destination unless given."""
    rows = [(1, s, d, (positions or {}).get((s, d), d), 1, 0, 0) for s, ds in sets.items() for d in ds]
    e = edge_rows(spark, rows)
    nodes = spark.createDataFrame([(1, 0, s, 0, len(ds), 0) for s, ds in sets.items() if ds] or [(1, 0, -9, 0, 0, 0)], "graph_id int, direction int, source_id long, state int, count long, updated_at long")
    return api.Graphs(spark, [1], e.cache(), nodes)


def wire(p):
    return p.ids, p.next.wire, p.prev.wire


def paged(spark, cases, key="destination_id"):
    """Cases (ids and positions, count, cursor) as queries of one job -> (ids, next, prev) of each."""
    data = [(q, d, p, n, c) for q, (items, n, c) in enumerate(cases) for d, p in items]
    df = spark.createDataFrame(data, "q int, destination_id long, position long, n int, c long")
    out = {q: ([], 0, 0) for q in range(len(cases))}
    for r in pages(df, ["q"], key, F.col("n"), F.col("c")).orderBy("q", F.desc(key)).collect():
        out[r.q][0].append(r.destination_id)
        out[r.q] = out[r.q][0], r.next_cursor, r.prev_cursor
    return [out[q] for q in range(len(cases))]


def test_pages_by_position(spark):
    cases = [(1, -1, ([3], 5, 0)), (5, -1, ([3, 2], 0, 0)), (1, 5, ([2], 0, -3)), (1, 4, ([2], 0, -3)), (3, 4, ([2], 0, -3)), (1, -5, ([], 0, 0)), (1, -3, ([3], 5, 0)), (1, -4, ([3], 5, 0)), (1, -2, ([2], 0, -3)), (3, -2, ([3, 2], 0, 0)), (1, 0, ([], 0, 0))]
    assert paged(spark, [([(2, 3), (3, 5)], n, c) for n, c, _ in cases], "position") == [w for *_, w in cases]
    g = graphs(spark, {1: [2, 3]}, {(1, 2): 3, (1, 3): 5})
    assert wire(g.select(api.select(1, 1), 1, Cursor.of(-2))) == ([2], 0, -3)


def test_pages_of_ids(spark):
    cases = [(10, 90, ([85, 75, 65, 55], 0, 0)), (10, 75, ([65, 55], 0, -65)), (2, -65, ([85, 75], 75, 0))]
    assert paged(spark, [([(x, 0) for x in (55, 65, 75, 85)], n, c) for n, c, _ in cases]) == [w for *_, w in cases]


@pytest.fixture(scope="module")
def sets(spark):
    return graphs(spark, {1: [2, 3, 4], 3: [2, 4], 5: list(range(1, 11)), 6: list(range(2, 13, 2)), 7: [1, 2, 3, 4, 11], 8: list(range(1, 13)), 9: [3, 4, 7, 11], 10: []})


def test_pages_of_set_expressions(spark, sets):
    cases = [
        (1, "&", 3, 1, -1, ([4], 4, 0)), (1, "&", 3, 1, 4, ([2], 0, -2)), (1, "&", 3, 2, -1, ([4, 2], 0, 0)), (5, "&", 10, 10, -1, ([], 0, 0)),
        (5, "-", 6, 10, -1, ([9, 7, 5, 3, 1], 0, 0)), (5, "-", 6, 2, -1, ([9, 7], 7, 0)), (5, "-", 6, 2, 7, ([5, 3], 3, -5)), (5, "-", 6, 2, 3, ([1], 0, -1)),
        (5, "|", 7, 10, 9, ([8, 7, 6, 5, 4, 3, 2, 1], 0, -8)), (8, "-", 9, 5, -1, ([12, 10, 9, 8, 6], 6, 0)), (8, "-", 9, 10, 12, ([10, 9, 8, 6, 5, 2, 1], 0, -10)), (5, "&", 7, 5, -1, ([4, 3, 2, 1], 0, 0)),
    ]
    ids = {}
    for a, op, b, *_ in cases:
        if (a, op, b) not in ids:
            x, y = api.select(a, 1), api.select(b, 1)
            ids[a, op, b] = [(r.destination_id, 0) for r in algebra.evaluate(sets.edges, {"&": x & y, "|": x | y, "-": x - y}[op]).collect()]
    assert paged(spark, [(ids[c[:3]], c[3], c[4]) for c in cases]) == [c[5] for c in cases]


def test_estimates(sets):
    x, y, z = api.select(5, 1), api.select(7, 1), api.select(8, 1)
    assert sets.count2([x | y, z - api.select(9, 1), x & y, x, api.select(5, 1, [1, 2, 99])]) == [10, 12, 0, 10, 3]
    assert sets.exact_count(x & y) == 4


def test_pages_forward_join_up_and_back_again(sets):
    e = api.select(8, 1) - api.select(9, 1)
    assert [i for ids in sets.paginate(e, 3) for i in ids] == [12, 10, 9, 8, 6, 5, 2, 1]
    first = sets.select(e, 3)
    second = sets.select(e, 3, first.next)
    assert sets.select(e, 3, second.prev).ids == first.ids


def test_batched_pages_with_ties_nulls_and_their_own_cursors(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", None, 3), ("b", 9, 4), ("b", 8, 5), ("c", 1, 6)], "q string, k long, d long")
    got = [(r.q, r.d, r.next_cursor, r.prev_cursor) for r in pages(df, ["q"], "k", 2, -1, "d").orderBy("q", F.desc("k"), F.desc("d")).collect()]
    assert got == [("a", 2, 5, 0), ("a", 1, 5, 0), ("b", 4, 0, 0), ("b", 5, 0, 0), ("c", 6, 0, 0)]
    c = F.when(F.col("q") == "b", 9).otherwise(0)
    assert [(r.q, r.d, r.prev_cursor) for r in pages(df, ["q"], "k", 2, c, "d").collect()] == [("b", 5, -8)]
    assert pages(df.limit(0), ["q"], "k", 2).count() == 0


def walk(spark, data, count, cursor, back=False):
    """All pages one after another, in one direction."""
    df = spark.createDataFrame([("q", k, d) for k, d in data], "q string, k long, d long")
    out = []
    while cursor != END:
        got = keyset_pages(df, ["q"], "k", count, cursor, "d").collect()
        if not got:
            break
        got.sort(key=lambda r: (r.k is not None, r.k or 0, r.d), reverse=True)
        out.insert(0, [(r.k, r.d) for r in got]) if back else out.append([(r.k, r.d) for r in got])
        x = got[0].prev if back else got[0].next
        cursor = END if x.kind == "end" else Cursor(x.kind, x.key, x.tie)
    return out


@pytest.mark.parametrize("data, count", [([(k, d) for k in (5, 5, 5, 1, 0, -1, None) for d in range(2)], 3), ([(None, d) for d in range(5)] + [(2, 9)], 2), ([(1, 0), (0, 1)], 1)])
def test_pages_hold_every_row_once_either_way(spark, data, count):
    data = sorted(set(data), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    forward = walk(spark, data, count, START)
    assert [x for p in forward for x in p] == data and {len(p) for p in forward[:-1]} <= {count}
    last = Cursor("backward", *data[-1])
    assert [x for p in walk(spark, data, count, last, back=True) for x in p] == data[:-1]


def test_keys_zero_and_one_are_no_ends(spark):
    g = graphs(spark, {1: [0, 1, 2, 3, 4], 2: [0, 1, 2, 3, 4]})
    e = api.select(1, 1) & api.select(2, 1)
    assert g.select(e, 2, Cursor("backward", 1)).ids == [3, 2]
    p = g.select(e, 2, Cursor("forward", 3))
    assert p.ids == [2, 1] and p.next == Cursor("forward", 1, 1) and g.select(e, 2, p.next).ids == [0]


def test_positions_that_tie_lose_nothing(spark):
    g = graphs(spark, {1: [2, 3, 4, 5]}, {(1, d): 7 for d in (2, 3, 4)})
    assert [i for ids in g.paginate(api.select(1, 1), 2) for i in ids] == [4, 3, 2, 5]
    first = g.select_edges(api.select(1, 1), 3)
    assert [r["destination_id"] for r in first[0]] == [4, 3, 2] and [r["destination_id"] for r in g.select_edges(api.select(1, 1), 3, first[1])[0]] == [5]


def test_queries_of_all_shapes_are_one_job(spark, sets):
    x, y, z = api.select(5, 1), api.select(6, 1), api.select(8, 1)
    queries = [(x & y, 9, START), (x | y, 3, START), ((z - x) | (x & y), 9, START), (x, 2, Cursor("forward", 9)), (api.select(None, 1, 4), 9, START), (api.select(5, 1, [1, 2, 99]), 9, START), (x, 3, END)]
    tracker, group = spark.sparkContext.statusTracker(), "shapes"
    spark.sparkContext.setJobGroup(group, "")
    got = [p.ids for p in sets.select2(queries)]
    few = len(tracker.getJobIdsForGroup(group))
    sets.select2(queries * 30)
    spark.sparkContext.setJobGroup("", "")
    assert got == [[10, 8, 6, 4, 2], [12, 10, 9], [12, 11, 10, 8, 6, 4, 2], [8, 7], [9, 8, 7, 6, 5, 3, 1], [2, 1], []]
    assert len(tracker.getJobIdsForGroup(group)) <= 3 * few


def test_programs_of_many_leaves(spark):
    leaves = spark.createDataFrame([(1, i, i % 5, None) for i in range(70)], "query_id int, leaf_no int, destination_id long, position long")
    e = [0, *[c for i in range(1, 70) for c in (i, -2)]]
    programs = spark.createDataFrame([(1, e)], "query_id int, program array<int>")
    assert sorted(r.destination_id for r in algebra.evaluate_programs(leaves, programs, 70).collect()) == [0, 1, 2, 3, 4]
    programs = spark.createDataFrame([(1, [69, 4, -1, 64, -3])], "query_id int, program array<int>")
    assert algebra.evaluate_programs(leaves, programs, 70).count() == 0


def test_composite_scan(spark, sets):
    rows, after = sets.scan((1, 3), 2, 1)
    assert [(r.source_id, r.destination_id) for r in rows] == [(1, 4), (3, 2)] and after == (3, 2)
    assert sets.scan((9, 7), 5, 1)[1] is None
    assert [tuple(r) for r in scan_after(spark.createDataFrame([(1, 2), (1, 1), (0, 9)], "a int, b int"), ["a", "b"], None, 2).collect()] == [(0, 9), (1, 1)]


# --- programs


def test_programs_and_their_errors():
    a, b, c = (Term(i, 1) for i in (1, 2, 3))
    e = (a & b) - (c | a)
    assert from_postfix(to_postfix(e)) == e and algebra.complexity(e) == 3 and algebra.depth(e) == 2
    assert from_postfix([("term", a), ("term", b), ("difference", None)]) == a - b
    assert (algebra.Everything() & a) == a and (a & algebra.Everything()) == a
    for bad in ([], [("term", a), ("intersection", None)], [("term", a), ("term", b)], [("term", a), ("term", b), ("xor", None)]):
        with pytest.raises(GraphError):
            from_postfix(bad)
    assert a.negative.states == (NEG,) and a.states == (N,) and a.with_states(N, N).states == (N,)


def test_requests_that_cannot_be_answered(sets):
    for f in (lambda: sets.get(1, 900, 2), lambda: sets.get(1, 1, 99), lambda: sets.get_metadata(77, 1), lambda: sets.select(api.select(1, 900), 1), lambda: sets.execute(), lambda: sets.execute(api.add(1, 900, 2))):
        with pytest.raises(GraphError):
            f()
    assert sets.contains(1, 1, 2) and not sets.contains(1, 1, 9) and sets.get(1, 1, 2).state == 0
    assert sets.contains_metadata(1, 1) and not sets.contains_metadata(77, 1) and sets.get_metadata(1, 1)["count"] == 3
    rows, after, before = sets.select_edges(api.select(1, 1), 2)
    assert [r["destination_id"] for r in rows] == [4, 3] and (after.wire, before) == (3, END)
    assert sets.select(api.select(1, 1, []), 5).ids == [] and sets.select(api.select(None, 1, 2), 5).ids and sets.select(api.select([1, 3, 10], 1, 2), 5).ids == [3, 1]


def test_cursors():
    assert Cursor.of(-1) == START and Cursor.of(0) == END and Cursor.of(7).wire == 7 and Cursor.of(-7).reversed() == Cursor.of(7) and START.wire == -1


# --- functions, copies, jobs


def test_lattice(spark):
    df = spark.createDataFrame([(5, 0), (5, 1), (5, 2), (5, 3), (None, 1), (7, None), (7, 9)], "t long, s int")
    got = [(r.t, r.s, r.o, r.bt, r.bs) for r in df.select("t", "s", L.ordinal("s").alias("o"), L.rank_time(L.rank("t", "s")).alias("bt"), L.rank_state(L.rank("t", "s")).alias("bs")).collect()]
    assert got == [(5, 0, 0, 5, 0), (5, 1, 3, 5, 1), (5, 2, 2, 5, 2), (5, 3, 1, 5, 3), (None, 1, 3, None, 1), (7, None, None, 7, None), (7, 9, None, 7, None)]
    assert df.select(L.max_state(F.lit(0), F.lit(2), F.lit(3)).alias("m")).head().m == 2


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=5))
def test_packed_ids(ids):
    assert packed.unpack(packed.pack(ids)) == ids


def test_packed_columns(spark):
    data = [([1, -1, 2**62, -(2**63)],), ([],), (None,)]
    df = packed.pack_column(spark.createDataFrame(data, "x array<long>"), "x")
    assert [tuple(r) for r in df.select(packed.unpack_column(F.col("x"))).collect()] == data
    small = packed.pack_column(spark.createDataFrame([([7, -3],)], "x array<long>"), "x", 4)
    assert small.select(packed.unpack_column(F.col("x"), 4).alias("y")).head().y == [7, -3]


def test_positions(spark):
    r = spark.range(1).select(position.decode(position.encode(F.lit(1234567890123), F.col("id"))).alias("ms"), position.encode(F.lit(5)).alias("p")).head()
    assert (r.ms, r.p) == (1234567890123, 5 << 20)


@pytest.mark.parametrize("copies", [[[1, 2], [1, 2]], [[], [1]], [[1, 3], [2, 4]], [[1], [1], [1]]])
def test_copies_merge(spark, copies):
    schema = "graph_id int, source_id long, destination_id long, position long, updated_at long, count int, state int"
    dfs = [spark.createDataFrame([(1, 1, d, 5, 10 + i, 0, i % 2) for d in c], schema) for i, c in enumerate(copies)]
    merged = repair.merge_copies(*dfs)
    best = {d: i for i, c in enumerate(copies) for d in c}
    assert {r.destination_id: r.updated_at for r in merged.collect()} == {d: 10 + i for d, i in best.items()}
    for i, (c, df) in enumerate(zip(copies, dfs)):
        assert {r.destination_id for r in repair.stale_rows(df, merged).collect()} == {d for d in best if d not in c or best[d] != i}
    assert {r.op for r in repair.as_ops(merged).collect()} <= {1, 2}


def test_jobs(spark):
    lines = [{"Single": {"source_id": 1, "graph_id": 2, "destination_id": 3, "position": 4, "state": 3, "updated_at": 5}}, {"x.y.Multi": {"source_id": 1, "updated_at": 5, "graph_id": 2, "direction": "Backward", "priority": 1, "state": 2, "cursor": -1}},
             {"x.single.Add": {"source_id": 1, "graph_id": 2, "destination_id": 3, "position": 4, "updated_at": 5}}, {"RemoveAll": {"source_id": 1, "graph_id": 2, "updated_at": 5}}, {"Copy": {"a": 1}}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("nonsense",), (None,), ("{}",)], "value string")
    got = [(r.tag, r.op, r.is_forward, r.destination_ids, r.execute_at, r.error) for r in parse_jobs(df).collect()]
    assert got[:4] == [("Single", NEGATE, True, [3], 5, None), ("Multi", ARCHIVE, False, None, 5, None), ("Add", ADD, True, [3], 5, None), ("RemoveAll", REMOVE, True, None, 5, None)]
    assert len(got) == 8 and all(g[5] for g in got[4:])
    wire = [{"Multi": {"source_id": 1, "updated_at": 5, "graph_id": 2, "direction": 1, "priority": 1, "state": 2, "cursor": 77}}, {"Multi": {"source_id": 1, "updated_at": 5, "graph_id": 2, "direction": 0, "priority": 1, "state": 2}},
            {"x.Copy": {"shards": [{"hostname": "h", "table_prefix": "t"}], "cursor1": 3, "cursor2": 4, "count": 500}}, {"x.MetadataCopy": {"shards": [{"hostname": "h", "table_prefix": "t"}], "cursor": 3, "count": 500}}]
    w = parse_jobs(spark.createDataFrame([(json.dumps(x),) for x in wire], "value string")).collect()
    assert [(r.is_forward, r.cursor) for r in w[:2]] == [(False, 77), (True, None)] and not any(r.error for r in w)
    assert [(r.copy.cursor1, r.copy.cursor2, r.copy["count"], r.copy.shards[0].hostname) for r in w[2:]] == [(3, 4, 500, "h"), (3, None, 500, "h")]
    assert {json.loads(r.value)["Multi"]["direction"] for r in to_jobs(ops_df(spark, [(1, 1, 5, False, None, ADD, None, 9)])).collect()} == {1}
    ops = ops_df(spark, [(1, 1, 5, False, [6, 7], REMOVE, 8, 9), (2, 1, 5, True, None, ADD, None, 9)])
    assert sorted((r.tag, r.source_id, r.destination_ids, r.op) for r in parse_jobs(to_jobs(ops)).collect()) == sorted([("Single", 6, [5], REMOVE), ("Single", 7, [5], REMOVE), ("Multi", 5, None, ADD)], key=lambda x: x)


# --- stored graphs


def test_buckets_are_the_same_for_both_sides(spark):
    ids = [0, 1, -1, 7, 2**62, -(2**63), 123456789]
    df = spark.createDataFrame([(i,) for i in ids], "i long").select(bucket_column("i", 13).alias("b"))
    assert [r.b for r in df.collect()] == [bucket_of(i, 13) for i in ids]


def test_a_write_touches_its_partitions_only(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), buckets=4)
    edges = spark.createDataFrame([(g, s, d, 5, 10, 0, 0) for g in (1, 2) for s in range(12) for d in (100, 101)] + [(1, None, 1, 1, 1, 0, 0)], EDGES)
    assert store.bulk_insert(edges) == 1
    before = store.manifest()
    g = api.Graphs.open(store, [1, 2])
    assert (g.count(api.select(3, 1)), g.count(api.select(None, 1, 100)), g.get(3, 1, 100).position) == (2, 12, 5)
    h = g.execute(api.remove(3, 1, 100).at(20), api.add(3, 1, 7).at(20))
    changed = {k for k, v in store.manifest()["edges"].items() if v != before["edges"].get(k)}
    assert changed == {f"0/1/{bucket_of(3, 4)}", f"1/1/{bucket_of(100, 4)}", f"1/1/{bucket_of(7, 4)}"}
    assert (h.count2([api.select(3, 1), api.select(None, 1, 100), api.select(None, 1, 7), api.select(4, 1)])) == [2, 11, 1, 2]
    assert g.count(api.select(None, 1, 100)) == 12  # the former version can still be read
    files = h._of_node(1, 0, 3).inputFiles()
    assert files and all(f"direction=0/graph_id=1/bucket={bucket_of(3, 4)}/" in f for f in files)
    # copies: newer rows win, older don't; nodes: their state counts edges of that state
    store.write_copies(spark.createDataFrame([(1, 4, 100, 9, 30, 0, 2), (1, 4, 101, 9, 1, 0, 2)], EDGES))
    store.write_nodes(spark.createDataFrame([(1, 0, 4, 2, 99, 50)], NODES))
    n = api.Graphs.open(store, [1]).get_metadata(4, 1)
    assert (n.state, n["count"], n.updated_at) == (2, 1, 50)
    assert api.Graphs.open(store, [1]).get(4, 1, 101).updated_at == 10


# --- streaming


def test_stream_equals_one_batch(spark, tmp_path):
    r = random.Random(21)
    ops = [(i, 1, r.randint(1, 4), True, [r.randint(1, 4)], r.randint(1, 4), r.randint(1, 99), r.randint(1, 6)) for i in range(60)]
    (tmp_path / "in").mkdir()
    store = GraphStore(spark, str(tmp_path / "edges"), buckets=2)
    keys = ["seq", "graph_id", "source_id", "is_forward", "destination_ids", "op", "position", "execute_at"]
    for k in range(2):
        part = [dict(zip(keys, o)) for o in ops[k * 30 : k * 30 + 30]] + [{"seq": 1000 + k, "graph_id": 1, "op": 9}]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        q = stream_ops(read_ops(spark, str(tmp_path / "in")), store, str(tmp_path / "checkpoint"), str(tmp_path / "dead"))
        q.awaitTermination(120)
    edges, _ = serial(ops)
    got = lambda: {tuple(x[:3]): [x.position, x.updated_at, x.state] for x in store.read().select("graph_id", "source_id", "destination_id", "position", "updated_at", "state").collect()}
    assert got() == edges
    assert spark.read.json(str(tmp_path / "dead")).count() == 2


def test_queue_by_priority_restart_and_retries(spark, tmp_path):
    store, queue = GraphStore(spark, str(tmp_path / "g"), buckets=2), str(tmp_path / "queue")
    ops = ops_df(spark, [(1, 1, 1, True, [2], ADD, 5, 10), (2, 1, 1, True, [3], 9, 5, 10)])
    enqueue(ops, queue)
    drain(spark, queue, store, str(tmp_path / "c"), str(tmp_path / "dead"))
    enqueue(ops_df(spark, [(3, 1, 1, True, [4], ADD, 5, 10)]), queue)
    drain(spark, queue, store, str(tmp_path / "c2"), str(tmp_path / "dead"))  # a new checkpoint: batch 0 again
    assert {r.destination_id for r in store.read().collect()} == {2, 4}
    assert requeue(spark, str(tmp_path / "dead"), str(tmp_path / "again"), limit=2).count() == 0
    assert spark.read.json(str(tmp_path / "again")).select("seq", "attempts").distinct().collect() == [(2, 1)]
    assert requeue(spark, str(tmp_path / "dead"), str(tmp_path / "again"), limit=1).count() == 2


def mixed_log(r, graphs, length):
    """Logs with lists and wildcards in both directions, a graph for each; seq grows from graph to graph and within one."""
    return [(g * 1000 + i, g, r.randint(1, 4), r.random() < 0.6, None if r.random() < 0.3 else [r.randint(1, 4) for _ in range(r.randint(1, 2))], r.randint(1, 4), r.randint(1, 999), r.randint(1, 6)) for g in range(graphs) for i in range(length)]


def test_stream_with_mass_operations_equals_one_batch(spark, tmp_path):
    ops = mixed_log(random.Random(31), 20, 15)
    store = GraphStore(spark, str(tmp_path / "edges"), buckets=2)
    (tmp_path / "in").mkdir()
    keys = ["seq", "graph_id", "source_id", "is_forward", "destination_ids", "op", "position", "execute_at"]
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(keys, o))) for o in ops if o[0] % 1000 // 8 == k))
        stream_ops(read_ops(spark, str(tmp_path / "in")), store, str(tmp_path / "checkpoint"), str(tmp_path / "dead")).awaitTermination(300)
    edges, nodes = serial(ops)
    got = lambda: {tuple(x[:3]): [x.position, x.updated_at, x.state] for x in store.read().select("graph_id", "source_id", "destination_id", "position", "updated_at", "state").collect()}
    states = lambda: {k: v for k, v in {(x.graph_id, x.direction, x.source_id): (x.updated_at, x.state) for x in store.nodes().collect()}.items() if k in nodes}
    assert got() == edges
    assert states() == nodes
    store.apply(ops_df(spark, [o for o in ops if o[0] % 1000 >= 8 or o[4] is None]))  # the last batch and all mass operations again
    assert got() == edges and states() == nodes


def test_stream_applies_node_states_to_later_and_late_operations(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "edges"), buckets=2)
    store.apply(ops_df(spark, [(1, 1, 1, True, [2], ADD, 5, 10)]))
    store.apply(ops_df(spark, [(4, 1, 1, True, None, ARCHIVE, None, 20)]))
    store.apply(ops_df(spark, [(5, 1, 1, True, [3], ADD, 5, 30), (2, 1, 1, True, [4], ADD, 5, 10)]))
    assert {x.destination_id: (x.state, x.updated_at) for x in store.read().collect()} == {2: (A, 20), 3: (A, 30), 4: (A, 20)}
