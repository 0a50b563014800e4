"""Queries of the edge store's own operators, for all nodes of the derived graphs at once, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lattice as L
from ..functions import packed, position
from ..operators import algebra, changefeed, repair
from ..operators.current import EDGE, NODE
from ..operators.fold import both_directions, dominated, fold_explicit, fold_ops, mass_ops, node_table, node_timeline
from ..model import Cursor
from ..operators.paging import keyset_pages, pages, scan_after
from ..operators.skew import salted_aggregate
from ..functions.session import new_path
from ..sources import jobs
from ..sources.store import GraphStore, table_id
from ..sources.tables import table
from . import derive
from .problems import RANK, STATE

#: Rows of a page, and a cursor in the middle of graph 1.
PAGE, MIDDLE = 5, 50
#: Times of mass operations, after all others.
LATE = 2_000_000_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _edges(spark, sf, graph: int = 1) -> DataFrame:
    return fold_explicit((derive.interactions if graph == 1 else derive.purchases)(spark, sf))


def _normal(spark, sf) -> DataFrame:
    return _edges(spark, sf).filter(F.col("state") == L.NORMAL).select("source_id", "destination_id", "position")


_1, _2 = "WITH " + derive.edges_sql(1), "WITH " + derive.edges_sql(2)
_COLS = "graph_id, source_id, destination_id, position, updated_at, count, state"
_N1 = _1 + ", n AS (SELECT source_id, destination_id, position FROM e WHERE state = 0)"


# --- edges and filters


@query(_1 + f" SELECT {_COLS} FROM e")
def edge_fold(spark, sf):
    return _edges(spark, sf)


@query(_2 + f" SELECT {_COLS} FROM e")
def edge_fold_purchases(spark, sf):
    return _edges(spark, sf, 2)


@query(_1 + " SELECT graph_id, CAST(1 AS INT) AS direction, destination_id AS source_id, source_id AS destination_id, position, updated_at, count, state FROM e")
def backward_edges(spark, sf):
    return both_directions(_edges(spark, sf)).filter("direction = 1")


_PAIRS = ", p AS (SELECT DISTINCT user_id AS source_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS destination_id FROM events WHERE event_type = 'error')"


def _pairs(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").filter(F.col("event_type") == "error")
    return e.select(F.col("user_id").alias("source_id"), F.get_json_object("props", "$.k").cast("long").alias("destination_id")).dropna().distinct()


@query(_1 + _PAIRS + f" SELECT {_COLS} FROM e SEMI JOIN p USING (source_id, destination_id)")
def get_edge(spark, sf):
    return _edges(spark, sf).join(_pairs(spark, sf), ["source_id", "destination_id"], "left_semi")


@query(_1 + _PAIRS + " SELECT source_id, destination_id, coalesce(bool_or(state IN (0, 3)), false) AS found FROM p LEFT JOIN e USING (source_id, destination_id) GROUP BY ALL")
def contains_edge(spark, sf):
    live = _edges(spark, sf).filter(F.col("state").isin(L.NORMAL, L.NEGATIVE)).select("source_id", "destination_id", F.lit(True).alias("found"))
    return _pairs(spark, sf).join(live, ["source_id", "destination_id"], "left").select("source_id", "destination_id", F.coalesce("found", F.lit(False)).alias("found"))


@query(_1 + f" SELECT {_COLS} FROM e WHERE state <> 1")
def not_removed(spark, sf):
    return _edges(spark, sf).filter(F.col("state") != L.REMOVED)


@query(_1 + f" SELECT {_COLS} FROM e WHERE state IN (2, 3)")
def edges_by_state(spark, sf):
    return _edges(spark, sf).filter(F.col("state").isin(L.ARCHIVED, L.NEGATIVE))


_IDS = list(range(0, 100, 7))


@query(_N1 + f" SELECT source_id, destination_id FROM n WHERE destination_id IN ({', '.join(map(str, _IDS))})")
def where_in(spark, sf):
    return _normal(spark, sf).filter(F.col("destination_id").isin(_IDS)).select("source_id", "destination_id")


@query(_1 + f" SELECT {_COLS} FROM e WHERE state = 0 AND destination_id IN ({', '.join(map(str, _IDS))})")
def where_in_edges(spark, sf):
    return _edges(spark, sf).filter((F.col("state") == L.NORMAL) & F.col("destination_id").isin(_IDS))


# --- pages


def _page_sql(rows: str, by: str, key: str, count: int, cursor: int, cols: str, tie: str = "") -> str:
    """Select of one page per query, with both cursors, from rows with columns by, key and cols."""
    inside = "true" if cursor == -1 else f"{key} < {cursor}" if cursor > 0 else f"{key} > {-cursor}"
    way = "ASC" if cursor < -1 else "DESC"
    order = f"{key} {way}" + (f", {tie} {way}" if tie else "")
    below, above = ("o.x IS NOT NULL", f"m.n > {count}") if cursor < -1 else (f"m.n > {count}", "o.x IS NOT NULL")
    return f"""a AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM {rows} WHERE {inside}),
m AS (SELECT {by}, count(*) AS n, min({key}) FILTER (k <= {count}) AS low, max({key}) FILTER (k <= {count}) AS high FROM a GROUP BY {by}),
o AS (SELECT DISTINCT {by}, 1 AS x FROM {rows} WHERE NOT ({inside}))
SELECT {cols}, CASE WHEN {below} THEN m.low ELSE 0 END AS next_cursor, CASE WHEN {above} THEN -m.high ELSE 0 END AS prev_cursor FROM a JOIN m USING ({by}) LEFT JOIN o USING ({by}) WHERE k <= {count}"""


_FIELDS = "source_id, destination_id, position"


@query(_N1 + ", " + _page_sql("n", "source_id", "position", PAGE, -1, _FIELDS, "destination_id"))
def neighbors_by_position(spark, sf):
    return pages(_normal(spark, sf), ["source_id"], "position", PAGE, -1, "destination_id")


@query(_N1 + ", " + _page_sql("n", "source_id", "destination_id", PAGE, -1, _FIELDS))
def neighbors_by_destination(spark, sf):
    return pages(_normal(spark, sf), ["source_id"], "destination_id", PAGE)


@query(_N1 + ", b AS (SELECT destination_id AS source_id, source_id AS destination_id, position FROM n), " + _page_sql("b", "source_id", "position", PAGE, -1, _FIELDS, "destination_id"))
def followers_by_position(spark, sf):
    back = both_directions(_edges(spark, sf)).filter((F.col("direction") == 1) & (F.col("state") == L.NORMAL))
    return pages(back.select("source_id", "destination_id", "position"), ["source_id"], "position", PAGE, -1, "destination_id")


@query(_1 + ", n AS (SELECT * FROM e WHERE state = 0), " + _page_sql("n", "source_id", "position", PAGE, -1, _COLS, "destination_id"))
def select_edges_page(spark, sf):
    return pages(_edges(spark, sf).filter(F.col("state") == L.NORMAL), ["source_id"], "position", PAGE, -1, "destination_id")


for _name, _cursor in (("page_start", -1), ("page_forward", MIDDLE), ("page_backward", -MIDDLE)):

    def _paged(spark, sf, cursor=_cursor):
        return pages(_normal(spark, sf), ["source_id"], "destination_id", PAGE, cursor)

    _paged.__name__ = _name
    query(_N1 + ", " + _page_sql("n", "source_id", "destination_id", PAGE, _cursor, _FIELDS))(_paged)


_TIED = _1 + ", n AS (SELECT source_id, destination_id, position >> 41 AS k FROM e WHERE state = 0)"


@query(_TIED + f""", r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY k DESC, destination_id DESC) AS i, count(*) OVER (PARTITION BY source_id) AS n FROM n)
SELECT source_id, destination_id, k, n > {2 * PAGE} AS more, true AS before FROM r WHERE i BETWEEN {PAGE + 1} AND {2 * PAGE}""")
def page_ties(spark, sf):
    """The second page of every source by a key with many ties, from the cursor of the first."""
    n = _normal(spark, sf).select("source_id", "destination_id", F.shiftright("position", 41).alias("k"))
    first = keyset_pages(n, ["source_id"], "k", PAGE, tie="destination_id").select("source_id", "next").distinct()
    second = keyset_pages(n.join(first.withColumnRenamed("next", "at"), "source_id"), ["source_id"], "k", PAGE, F.col("at"), "destination_id")
    return second.select("source_id", "destination_id", "k", (F.col("next.kind") != "end").alias("more"), (F.col("prev.kind") != "end").alias("before"))


@query(_N1 + f""", r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY destination_id) AS i, count(*) OVER (PARTITION BY source_id) AS n, max(destination_id) OVER (PARTITION BY source_id ORDER BY destination_id ROWS BETWEEN CURRENT ROW AND {PAGE - 1} FOLLOWING) AS high FROM n WHERE destination_id > 1),
o AS (SELECT DISTINCT source_id, true AS x FROM n WHERE destination_id <= 1),
f AS (SELECT source_id, min(destination_id) AS low, max(high) FILTER (i = 1) AS high FROM r GROUP BY ALL)
SELECT source_id, destination_id, CASE WHEN x THEN low END AS next_key, CASE WHEN n > {PAGE} THEN f.high END AS prev_key FROM r JOIN f USING (source_id) LEFT JOIN o USING (source_id) WHERE i <= {PAGE}""")
def page_key_zero_one(spark, sf):
    """The page above id 1, which the wire form can't name: it stands for the start there."""
    got = keyset_pages(_normal(spark, sf).select("source_id", "destination_id"), ["source_id"], "destination_id", PAGE, Cursor("backward", 1))
    return got.select("source_id", "destination_id", F.col("next.key").alias("next_key"), F.col("prev.key").alias("prev_key"))


# --- set expressions: query q combines the neighbours of q, q + 1, q + 2 and q + 3


def _leaves(spark, sf) -> DataFrame:
    n = _normal(spark, sf)
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("leaf_no"), (F.col("source_id") - i).alias("query_id")) for i in range(4)])).alias("x")
    return n.select("destination_id", at).select("x.query_id", "x.leaf_no", "destination_id")


_LEAVES = _N1 + ", l AS (SELECT source_id - i AS query_id, i AS leaf_no, destination_id FROM n, range(4) r(i))"
_LEAF = "(SELECT query_id, destination_id FROM l WHERE leaf_no = {})"
_SHAPES = {
    "intersection": ([0, 1, "intersection"], f"{_LEAF.format(0)} INTERSECT {_LEAF.format(1)}"),
    "union": ([0, 1, "union"], f"{_LEAF.format(0)} UNION {_LEAF.format(1)}"),
    "difference": ([0, 1, "difference"], f"{_LEAF.format(0)} EXCEPT {_LEAF.format(1)}"),
    "nested_set_expr": ([0, 1, "intersection", 2, "union", 3, "difference"], f"(({_LEAF.format(0)} INTERSECT {_LEAF.format(1)}) UNION {_LEAF.format(2)}) EXCEPT {_LEAF.format(3)}"),
}
for _name, (_shape, _sql) in _SHAPES.items():

    def _whole(spark, sf, shape=_shape):
        return algebra.evaluate_batch(_leaves(spark, sf), shape)

    def _part(spark, sf, shape=_shape):
        return pages(algebra.evaluate_batch(_leaves(spark, sf), shape), ["query_id"], "destination_id", PAGE, MIDDLE)

    _whole.__name__, _part.__name__ = _name, f"{_name}_paged"
    query(f"{_LEAVES} SELECT query_id, destination_id FROM ({_sql})")(_whole)
    if _name != "nested_set_expr":
        query(f"{_LEAVES}, s AS ({_sql}), " + _page_sql("s", "query_id", "destination_id", PAGE, MIDDLE, "query_id, destination_id"))(_part)


@query(_N1 + " SELECT a.source_id, a.destination_id FROM n a JOIN n b ON a.source_id = b.destination_id AND a.destination_id = b.source_id")
def mutual_edges(spark, sf):
    n = _normal(spark, sf).select("source_id", "destination_id")
    return n.join(n.select(F.col("destination_id").alias("source_id"), F.col("source_id").alias("destination_id")), ["source_id", "destination_id"], "left_semi")


def _terms(spark, sf) -> DataFrame:
    """For every user: wildcard neighbours in either live state, named ids, and followers of the user's number."""
    u = table(spark, sf, "events").select(F.col("user_id").alias("source_id")).distinct()
    kinds = F.array(*[F.struct(F.lit(i).alias("leaf_no"), F.lit(f).alias("is_forward"), ids.alias("destination_ids"), F.array(*[F.lit(s) for s in st]).alias("states"))
                      for i, (f, ids, st) in enumerate([(True, F.lit(None).cast("array<long>"), (0, 3)), (True, F.array(*[F.lit(x).cast("long") for x in _IDS]), (0,)), (False, F.lit(None).cast("array<long>"), (1, 2))])])
    return u.select(F.col("source_id").alias("query_id"), F.lit(1).alias("graph_id"), "source_id", F.inline(kinds))


_BATCH = _1 + f""", u AS (SELECT DISTINCT user_id FROM events), t AS (
SELECT user_id AS query_id, CAST(0 AS INT) AS leaf_no, destination_id, position FROM u JOIN e ON source_id = user_id WHERE state IN (0, 3) UNION ALL
SELECT user_id, 1, destination_id, position FROM u JOIN e ON source_id = user_id WHERE state = 0 AND destination_id IN ({', '.join(map(str, _IDS))}) UNION ALL
SELECT user_id, 2, source_id, position FROM u JOIN e ON destination_id = user_id WHERE state IN (1, 2))"""


@query(_BATCH + " SELECT query_id, leaf_no, destination_id, position FROM t")
def batched_select(spark, sf):
    return algebra.neighbours(both_directions(_edges(spark, sf)), _terms(spark, sf))


@query(_BATCH + " SELECT query_id, leaf_no, count(*) AS ids FROM t GROUP BY ALL")
def batched_count(spark, sf):
    return algebra.neighbours(both_directions(_edges(spark, sf)), _terms(spark, sf)).groupBy("query_id", "leaf_no").agg(F.count(F.lit(1)).alias("ids"))


#: Shapes of mixed queries over four leaves, as codes of the stack machine, and their SQL.
_MIXED = [([0, 1, -1], _SHAPES["intersection"][1]), ([0, 1, -2], _SHAPES["union"][1]), ([0, 1, -3], _SHAPES["difference"][1]), ([0, 1, -1, 2, -2, 3, -3], _SHAPES["nested_set_expr"][1]), ([2, 0, -3, 3, 1, -1, -2], f"({_LEAF.format(2)} EXCEPT {_LEAF.format(0)}) UNION ({_LEAF.format(3)} INTERSECT {_LEAF.format(1)})")]


@query(f"{_LEAVES} SELECT query_id, destination_id FROM (" + " UNION ALL ".join(f"SELECT * FROM ({s}) WHERE query_id % {len(_MIXED)} = {i}" for i, (_, s) in enumerate(_MIXED)) + ") WHERE query_id >= 0")
def batched_mixed(spark, sf):
    """A query per node, each with one of several shapes, in one job."""
    leaves = _leaves(spark, sf).filter("query_id >= 0")
    shape = F.element_at(F.array(*[F.array(*map(F.lit, codes)) for codes, _ in _MIXED]), (F.col("query_id") % len(_MIXED) + 1).cast("int"))
    programs = leaves.select("query_id").distinct().withColumn("program", shape)
    return algebra.evaluate_programs(leaves.withColumn("position", F.lit(None).cast("long")), programs, 4).select("query_id", "destination_id")


# --- counts

_NODES = ", d AS (SELECT graph_id, CAST(0 AS INT) AS direction, source_id, state FROM e UNION ALL SELECT graph_id, 1, destination_id, state FROM e)"


@query(_1 + _NODES + " SELECT graph_id, direction, source_id, CAST(0 AS INT) AS state, count(*) FILTER (state = 0) AS count, CAST(0 AS BIGINT) AS updated_at FROM d GROUP BY ALL")
def node_count(spark, sf):
    return node_table(_edges(spark, sf))


@query(_1 + _NODES + " SELECT graph_id, direction, source_id, CASE WHEN 0 IN (0, 2) THEN count(*) FILTER (state = 0) ELSE 0 END AS normal_archived, CAST(0 AS BIGINT) AS removed FROM d GROUP BY ALL")
def node_count_multi_state(spark, sf):
    n = node_table(_edges(spark, sf))
    of = lambda *s: F.when(F.col("state").isin(*s), F.col("count")).otherwise(F.lit(0)).cast("long")
    return n.select("graph_id", "direction", "source_id", of(0, 2).alias("normal_archived"), of(1).alias("removed"))


@query(_1 + " SELECT source_id, state, count(*) AS edges FROM e GROUP BY ALL")
def exact_count(spark, sf):
    return salted_aggregate(_edges(spark, sf), ["source_id"], {"edges": ("count", None)}, by=["state"], spread=["destination_id"])


def _pair_sizes(spark, sf) -> DataFrame:
    n = _leaves(spark, sf).filter("leaf_no < 2").groupBy("query_id").agg(F.count(F.when(F.col("leaf_no") == 0, 1)).alias("a"), F.count(F.when(F.col("leaf_no") == 1, 1)).alias("b"))
    return n


for _kind, _sql in (("intersection", "CAST(floor(least(a, b) * 0.1) AS BIGINT)"), ("union", "greatest(a, b)"), ("difference", "a")):

    def _estimate(spark, sf, kind=_kind):
        return _pair_sizes(spark, sf).select("query_id", algebra.estimate_columns(kind, F.col("a"), F.col("b")).alias("estimate"))

    _estimate.__name__ = f"estimate_{_kind}"
    query(f"{_LEAVES}, s AS (SELECT query_id, count(*) FILTER (leaf_no = 0) AS a, count(*) FILTER (leaf_no = 1) AS b FROM l WHERE leaf_no < 2 GROUP BY ALL) SELECT query_id, {_sql} AS estimate FROM s")(_estimate)


# --- scans with a cursor: the limit is the page


@query("WITH e AS (SELECT DISTINCT CAST(3 AS INT) AS graph_id, l_suppkey AS source_id, l_partkey AS destination_id FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL) SELECT * FROM e WHERE (source_id, destination_id) > (7, 100) ORDER BY source_id, destination_id LIMIT 1000")
def scan_all_cursor(spark, sf):
    return scan_after(derive.supplies(spark, sf), ["source_id", "destination_id"], (7, 100), 1000)


@query(_1 + f"{_NODES} SELECT graph_id, direction, source_id, CAST(0 AS INT) AS state, count(*) FILTER (state = 0) AS count, CAST(0 AS BIGINT) AS updated_at FROM d WHERE direction = 0 AND source_id > 20 GROUP BY ALL ORDER BY source_id LIMIT 100")
def scan_nodes_cursor(spark, sf):
    return scan_after(node_table(_edges(spark, sf)).filter("direction = 0"), ["source_id"], (20,), 100)


# --- node states and mass operations on graph 2: customers in debt are archived, those deeper in debt added again


def _debtors(spark, sf, early: bool = False, again: bool = True) -> DataFrame:
    c = table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).dropna(subset=["c_custkey"])
    seq = F.lit(-2 * 10**12 if early else 2 * 10**12) + F.col("c_custkey") * 2
    t = 0 if early else LATE
    first = c.select(F.lit(2).alias("graph_id"), F.lit(0).alias("direction"), F.col("c_custkey").alias("node"), seq.alias("seq"), L.rank_of(F.lit(t), F.lit(L.ORDER.index(L.ARCHIVED))).alias("rank"))
    if not again:
        return first
    more = c.filter(F.col("c_acctbal") < -500)
    return first.unionByName(more.select(F.lit(2).alias("graph_id"), F.lit(0).alias("direction"), F.col("c_custkey").alias("node"), (seq + 1).alias("seq"), L.rank_of(F.lit(t + 1), F.lit(0)).alias("rank")))


@query(f"""SELECT CAST(2 AS INT) AS graph_id, CAST(0 AS INT) AS direction, c_custkey AS node, 2000000000000 + c_custkey * 2 AS seq, CAST(2 AS INT) AS state FROM customer WHERE c_acctbal < 0 UNION ALL
SELECT 2, 0, c_custkey, 2000000000000 + c_custkey * 2 + 1, 0 FROM customer WHERE c_acctbal < -500""")
def node_states(spark, sf):
    return node_timeline(_debtors(spark, sf)).select("graph_id", "direction", "node", "seq", L.rank_state("node_rank").alias("state"))


QUERIES["node_timeline"], SQL["node_timeline"] = QUERIES.pop("node_states"), SQL.pop("node_states")


@query(_2 + """ SELECT o.source_id, o.destination_id, o.seq, o.r // 8 AS updated_at, CAST(CASE greatest(o.r % 8, CASE WHEN c_acctbal < 0 AND c_acctbal >= -500 THEN 3 ELSE 1 END) WHEN 1 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS INT) AS state
FROM ops2 o LEFT JOIN customer ON c_custkey = o.source_id""")
def endpoint_dominance(spark, sf):
    d = dominated(derive.purchases(spark, sf), node_timeline(_debtors(spark, sf, early=True)))
    return d.select("source_id", "destination_id", "seq", L.rank_time("rank").alias("updated_at"), L.rank_state("rank").alias("state"))


def _mass_log(spark, sf, again: bool) -> DataFrame:
    """Graph 2 as a log of operations with mass operations at its end."""
    rows = derive.purchases(spark, sf)
    # one seq per operation, in the order of the rows: lines that share a seq are told apart by shipping day and state, and by their edge
    day = F.floor(L.rank_time("rank") / 86400) * 8 + L.rank_ordinal("rank") + 1
    seq = F.shiftleft("seq", 27) + F.shiftleft(day, 10) + F.pmod(F.xxhash64(*EDGE), F.lit(1024))
    explicit = rows.select(seq.alias("seq"), "graph_id", "source_id", F.lit(True).alias("is_forward"), F.array("destination_id").alias("destination_ids"),
                           F.when(L.rank_ordinal("rank") == 0, 1).when(L.rank_ordinal("rank") == 2, 3).otherwise(2).alias("op"), F.col("pos").alias("position"), L.rank_time("rank").alias("execute_at"))
    m = _debtors(spark, sf, again=again)
    mass = m.select((F.col("seq") + F.lit(1 << 62)).alias("seq"), "graph_id", F.col("node").alias("source_id"), F.lit(True).alias("is_forward"), F.lit(None).cast("array<long>").alias("destination_ids"),
                    F.when(L.rank_ordinal("rank") == 0, 1).otherwise(3).alias("op"), F.lit(None).cast("long").alias("position"), L.rank_time("rank").alias("execute_at"))
    return explicit.unionByName(mass).withColumns({"priority": F.lit(3), "queued_at": F.lit(None).cast("timestamp")})


def _mass_sql(again: bool) -> str:
    s = "CASE WHEN r % 8 = 4 OR c_acctbal IS NULL OR c_acctbal >= 0 THEN {old} " + ("WHEN c_acctbal < -500 THEN {added} " if again else "") + "ELSE {archived} END"
    t = s.format(old="updated_at", added=LATE + 1, archived=LATE)
    return _2 + f" SELECT source_id, destination_id, position, {t} AS updated_at, CAST({s.format(old='state', added=0, archived=2)} AS INT) AS state FROM e LEFT JOIN customer ON c_custkey = source_id"


@query(_mass_sql(False))
def wildcard_archive(spark, sf):
    return fold_ops(_mass_log(spark, sf, False)).select("source_id", "destination_id", "position", "updated_at", "state")


@query(_mass_sql(True))
def wildcard_unarchive(spark, sf):
    return fold_ops(_mass_log(spark, sf, True)).select("source_id", "destination_id", "position", "updated_at", "state")


_STATED = f""", w AS (SELECT CAST(2 AS INT) AS graph_id, * FROM ({_mass_sql(True)})), d AS (SELECT graph_id, CAST(0 AS INT) AS direction, source_id, state FROM w UNION ALL SELECT graph_id, 1, destination_id, state FROM w),
c AS (SELECT graph_id, direction, source_id, state, count(*) AS n FROM d GROUP BY ALL),
t AS (SELECT CAST(2 AS INT) AS graph_id, CAST(0 AS INT) AS direction, c_custkey AS source_id, CAST(CASE WHEN c_acctbal < -500 THEN 0 ELSE 2 END AS INT) AS s, CASE WHEN c_acctbal < -500 THEN {LATE + 1} ELSE {LATE} END AS t FROM customer WHERE c_acctbal < 0),
k AS (SELECT graph_id, direction, source_id FROM c UNION SELECT graph_id, direction, source_id FROM t)
SELECT graph_id, direction, source_id, coalesce(s, 0) AS state, coalesce(n, 0) AS count, coalesce(t, CAST(0 AS BIGINT)) AS updated_at FROM k LEFT JOIN t USING (graph_id, direction, source_id) LEFT JOIN c ON (c.graph_id, c.direction, c.source_id, c.state) = (k.graph_id, k.direction, k.source_id, coalesce(s, 0))"""


@query("WITH x AS (SELECT 1)" + _STATED)
def node_count_states(spark, sf):
    """Counts of nodes in different states: customers in debt are Archived."""
    log = _mass_log(spark, sf, True)
    return node_table(fold_ops(log), node_timeline(mass_ops(log)))


@query("WITH x AS (SELECT 1)" + _STATED)
def stored_node_counts(spark, sf):
    """The same from a store that takes the log in two parts and keeps its counts up."""
    log = _mass_log(spark, sf, True)
    store = GraphStore(spark, new_path(spark))
    store.apply(log.filter(F.col("destination_ids").isNotNull()))
    store.apply(log.filter(F.col("destination_ids").isNull()))
    return store.nodes()


@query(_mass_sql(True))
def stored_edges(spark, sf):
    """Edges of such a store, read back by direction and graph."""
    log = _mass_log(spark, sf, True)
    store = GraphStore(spark, new_path(spark))
    store.apply(log.filter(F.col("destination_ids").isNotNull()))
    store.apply(log.filter(F.col("destination_ids").isNull()))
    e = store.edges().filter((F.col("graph_id") == 2) & (F.col("direction") == 1))
    return e.select(F.col("destination_id").alias("source_id"), F.col("source_id").alias("destination_id"), "position", "updated_at", "state")


@query(None)
def fold_all_ops(spark, sf):
    """The whole change feed from nothing, with wildcards and node states; checked against a simulator in the tests."""
    return fold_ops(table(spark, sf, "execute_operations"))


# --- copies


def _merged(keys: str, fields: str, *tables: str) -> str:
    union = " UNION ALL ".join(f"SELECT {keys}, {fields}, updated_at, state FROM {t}" for t in tables)
    wrapped = ", ".join(f"'{f}': {{'k': {f} IS NOT NULL, 'v': coalesce({f}, 0)}}" for f in fields.split(", "))
    out = ", ".join(f"CASE WHEN m.{f}.k THEN m.{f}.v END AS {f}" for f in fields.split(", "))
    some = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"SELECT {keys}, {out}, m.r // 8 AS updated_at, CAST(CASE m.r % 8 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS INT) AS state, m.r AS r FROM (SELECT {keys}, max({{'r': {RANK}, {wrapped}}}) AS m FROM ({union}) WHERE {some} GROUP BY {keys})"


_EDGE_KEYS = ", ".join(EDGE)
_BOTH = _merged(_EDGE_KEYS, "position, count", "graph_edges", "replica_edges")


@query(f"SELECT {_COLS} FROM ({_BOTH})")
def replica_merge(spark, sf):
    return repair.merge_copies(table(spark, sf, "graph_edges"), table(spark, sf, "replica_edges"))


@query(f"WITH b AS ({_BOTH}), r AS ({_merged(_EDGE_KEYS, 'position, count', 'replica_edges')}) SELECT {_COLS} FROM b ANTI JOIN r USING ({_EDGE_KEYS}, r)")
def replica_diff(spark, sf):
    replica = table(spark, sf, "replica_edges")
    return repair.stale_rows(replica, repair.merge_copies(table(spark, sf, "graph_edges"), replica))


#: A second copy of the nodes, as the replica's edges have them: the newest time and state of a source's edges.
_NODE_COPY = f"(SELECT graph_id, source_id, CAST(NULL AS INT) AS count, r // 8 AS updated_at, CAST({STATE.format('r')} AS INT) AS state FROM (SELECT graph_id, source_id, max({RANK}) AS r FROM replica_edges GROUP BY ALL))"


def _node_copies(spark, sf) -> tuple[DataFrame, DataFrame]:
    r = table(spark, sf, "replica_edges").groupBy(*NODE).agg(F.max(L.rank()).alias("r"))
    return table(spark, sf, "graph_metadata"), r.select(*NODE, F.lit(None).cast("int").alias("count"), L.rank_time("r").alias("updated_at"), L.rank_state("r").alias("state"))


_NODE_KEYS = ", ".join(NODE)


@query(f"SELECT {_NODE_KEYS}, count, updated_at, state FROM ({_merged(_NODE_KEYS, 'count', 'graph_metadata', _NODE_COPY)})")
def node_replica_merge(spark, sf):
    return repair.merge_nodes(*_node_copies(spark, sf))


@query(f"WITH b AS ({_merged(_NODE_KEYS, 'count', 'graph_metadata', _NODE_COPY)}), r AS ({_merged(_NODE_KEYS, 'count', 'graph_metadata')}) SELECT {_NODE_KEYS}, CAST(CASE state WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 END AS INT) AS op, updated_at AS execute_at FROM b ANTI JOIN r USING ({_NODE_KEYS}, r)")
def node_repair_ops(spark, sf):
    """What the first copy lacks or has older, as the operations that repair it."""
    a, b = _node_copies(spark, sf)
    return repair.nodes_as_ops(repair.stale_nodes(a, repair.merge_nodes(a, b))).select(*NODE, "op", "execute_at")


@query(_1 + " SELECT graph_id AS table_id, source_id, destination_id FROM e UNION ALL SELECT -graph_id, destination_id, source_id FROM e")
def table_ids(spark, sf):
    two = both_directions(_edges(spark, sf))
    return two.select(table_id(F.col("direction"), F.col("graph_id")).alias("table_id"), "source_id", "destination_id")


# --- positions, operations, jobs, packed ids


@query("SELECT event_id, epoch_us(ts) // 1000 * 1048576 AS position FROM events")
def position_encode(spark, sf):
    return table(spark, sf, "events").select("event_id", position.encode(F.unix_millis(F.col("ts").cast("timestamp"))).alias("position"))


@query("SELECT graph_id, source_id, destination_id, position >> 20 AS millis FROM graph_edges")
def position_decode(spark, sf):
    return table(spark, sf, "graph_edges").select(*EDGE, position.decode(F.col("position")).alias("millis"))


_OPS = """WITH o1 AS (SELECT DISTINCT ON (seq) * FROM execute_operations WHERE seq IS NOT NULL AND len(destination_ids) > 0 ORDER BY seq, queued_at),
o2 AS (SELECT *, unnest(destination_ids) AS other, unnest(range(len(destination_ids))) AS idx FROM o1)
SELECT graph_id, CASE WHEN is_forward THEN source_id ELSE other END AS source_id, CASE WHEN is_forward THEN other ELSE source_id END AS destination_id, seq, CAST(idx AS INT) AS idx,
  coalesce(execute_at, epoch_us(queued_at) // 1000000) AS updated_at, CAST(CASE op WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 END AS INT) AS state, coalesce(position, epoch_us(queued_at) // 1000 * 1048576) AS position FROM o2 WHERE other IS NOT NULL"""


@query(_OPS)
def op_explode(spark, sf):
    o = changefeed.explicit_ops(table(spark, sf, "execute_operations"))
    return o.select(*EDGE, "seq", "idx", L.rank_time("rank").alias("updated_at"), L.rank_state("rank").alias("state"), F.col("pos").alias("position"))


@query("""SELECT 'Single' AS tag, graph_id, CASE WHEN is_forward THEN source_id ELSE d END AS source_id, CASE WHEN is_forward THEN d ELSE source_id END AS destination_id, true AS is_forward, op, position, execute_at
  FROM (SELECT *, unnest(destination_ids) AS d FROM execute_operations) WHERE d IS NOT NULL UNION ALL
SELECT 'Multi', graph_id, source_id, NULL, is_forward, op, NULL, execute_at FROM execute_operations WHERE destination_ids IS NULL""")
def json_job_parse(spark, sf):
    j = jobs.parse_jobs(jobs.to_jobs(table(spark, sf, "execute_operations")))
    return j.filter("error IS NULL").select("tag", "graph_id", "source_id", F.col("destination_ids")[0].alias("destination_id"), "is_forward", "op", "position", "execute_at")


@query("SELECT seq, CAST(list_sum(destination_ids) AS BIGINT) AS total, CAST(len(destination_ids) AS INT) AS ids FROM execute_operations WHERE destination_ids IS NOT NULL AND len(destination_ids) > 0")
def packed_ids(spark, sf):
    o = table(spark, sf, "execute_operations").filter(F.size("destination_ids") > 0).select("seq", "destination_ids")
    ids = packed.unpack_column(F.col("destination_ids"))
    return packed.pack_column(o, "destination_ids").select("seq", F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(ids).alias("ids"))
