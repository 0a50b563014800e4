"""The service's methods over stored graphs, and a fluent way to write queries and operations.

Many queries at once, each of its own shape, are one job (``select2``, ``count2``).
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lattice as L
from .functions.session import new_path
from .model import CURSOR, END, HIGH, OPS, START, Cursor, GraphError, Page
from .operators import algebra
from .operators.algebra import Expr, Term, from_postfix
from .operators.paging import keyset_pages, scan_after
from .sources.store import GraphStore


def select(source_id=None, graph_id: int = 0, destination_id=None) -> Term:
    """``select(a, g)`` all neighbours of a; ``select(None, g, b)`` all that point to b; lists name ids."""
    many = (list, tuple, set)
    if isinstance(source_id, many):
        return Term(destination_id, graph_id, False, tuple(source_id))
    if source_id is None:
        return Term(destination_id, graph_id, False)
    ids = None if destination_id is None else tuple(destination_id) if isinstance(destination_id, many) else (destination_id,)
    return Term(source_id, graph_id, True, ids)


@dataclass(frozen=True)
class Change:
    """An operation on the edges of a term; ``at`` sets its time, in seconds."""

    op: int
    term: Term
    position: int | None = None
    execute_at: int | None = None

    def at(self, seconds: int) -> Change:
        return replace(self, execute_at=seconds)


def add(*where, position: int | None = None) -> Change:
    return Change(L.ADD, select(*where), position)


unarchive = add


def remove(*where, position: int | None = None) -> Change:
    return Change(L.REMOVE, select(*where), position)


def archive(*where, position: int | None = None) -> Change:
    return Change(L.ARCHIVE, select(*where), position)


def negate(*where, position: int | None = None) -> Change:
    return Change(L.NEGATE, select(*where), position)


class Graphs:
    """A set of graphs: edges of both directions and nodes, as frames or in a store (see :mod:`adjset.sources.store`)."""

    def __init__(self, spark: SparkSession, graph_ids, edges: DataFrame | None = None, nodes: DataFrame | None = None, store: GraphStore | None = None):
        self.spark, self.graph_ids, self.store = spark, frozenset(graph_ids), store
        self._edges, self._nodes = edges, nodes

    @classmethod
    def open(cls, store: GraphStore, graph_ids) -> Graphs:
        """The newest version of a store."""
        v = store.versions()
        return cls(store.spark, graph_ids, store=store.pinned_at(v[-1]) if v else store)

    @classmethod
    def from_ops(cls, ops: DataFrame, graph_ids, path: str | None = None, buckets: int = 16) -> Graphs:
        """A new store with a log of operations applied, in the shared folder unless a path is given."""
        store = GraphStore(ops.sparkSession, path or new_path(ops.sparkSession), buckets)
        store.apply(ops)
        return cls.open(store, graph_ids)

    @property
    def edges(self) -> DataFrame:
        return self._edges if self.store is None else self.store.edges()

    @property
    def nodes(self) -> DataFrame:
        return self._nodes if self.store is None else self.store.nodes()

    def _of_node(self, graph_id: int, direction: int, node: int) -> DataFrame:
        """Edges stored under a node: of a store one partition is read."""
        e = self._edges if self.store is None else self.store.edges(self.store.partitions(graph_id, direction, [node]))
        return e.filter((F.col("graph_id") == graph_id) & (F.col("direction") == direction) & (F.col("source_id") == node))

    # --- checks

    def _known(self, graph_id: int) -> None:
        if graph_id not in self.graph_ids:
            raise GraphError(f"unknown graph {graph_id}")

    def _checked(self, e: Expr | list) -> Expr:
        e = from_postfix(e) if isinstance(e, list) else e
        for kind, t in algebra.to_postfix(e):
            if kind == "term":
                self._known(t.graph_id)
        return e

    # --- single records

    def _edge(self, s: int, g: int, d: int) -> DataFrame:
        self._known(g)
        return self._of_node(g, 0, s).filter(F.col("destination_id") == d).drop("direction", "bucket")

    def _node(self, s: int, g: int) -> DataFrame:
        self._known(g)
        nodes = self._nodes if self.store is None else self.store.nodes(self.store.partitions(g, 0, [s]))
        return nodes.filter((F.col("graph_id") == g) & (F.col("direction") == 0) & (F.col("source_id") == s)).drop("direction")

    def contains(self, s: int, g: int, d: int) -> bool:
        """Whether the edge is there, Normal or Negative."""
        return not self._edge(s, g, d).filter(F.col("state").isin(L.NORMAL, L.NEGATIVE)).isEmpty()

    def get(self, s: int, g: int, d: int):
        """The edge in any state; an error if there is none."""
        row = self._edge(s, g, d).head()
        if row is None:
            raise GraphError("record not found")
        return row

    def get_metadata(self, s: int, g: int):
        row = self._node(s, g).head()
        if row is None:
            raise GraphError("record not found")
        return row

    def contains_metadata(self, s: int, g: int) -> bool:
        return not self._node(s, g).isEmpty()

    # --- pages

    def select2(self, queries) -> list[Page]:
        """Pages of (expression or program, count, cursor), all in one job. A single wildcard pages by position, all else by id."""
        asked = [(self._checked(e), n, c) for e, n, c in queries]
        if not asked:
            return []
        terms, programs, most = [], [], 1
        for q, (e, n, c) in enumerate(asked):
            codes, own = algebra.program_of(e)
            terms += [(q, i, t) for i, t in enumerate(own)]
            most = max(most, len(own))
            programs.append((q, codes, isinstance(e, Term) and e.destination_ids is None, n, (c.kind, c.key, c.tie)))
        p = self.spark.createDataFrame(programs, f"query_id int, program array<int>, simple boolean, n int, c {CURSOR}")
        leaves = algebra.neighbours(self._stored_for(t for *_, t in terms), algebra.terms_frame(self.spark, terms))
        rows = algebra.evaluate_programs(leaves, p, most).join(p.drop("program"), "query_id")
        rows = rows.withColumn("k", F.when(F.col("simple"), F.col("position")).otherwise(F.col("destination_id")))
        pages: dict[int, list] = {}
        for r in keyset_pages(rows, ["query_id"], "k", F.col("n"), F.col("c"), "destination_id").select("query_id", "k", "destination_id", "next", "prev").collect():
            pages.setdefault(r["query_id"], []).append(r)
        return [_page(pages.get(q, []))[0] for q in range(len(asked))]

    def _stored_for(self, terms) -> DataFrame:
        """The edges, of a store those partitions that hold the terms' nodes."""
        if self.store is None:
            return self._edges
        m = self.store.manifest()
        return self.store.edges({k for t in terms for k in self.store.partitions(t.graph_id, 0 if t.is_forward else 1, [t.source_id], m)})

    def select(self, e, count: int, cursor: Cursor = START) -> Page:
        return self.select2([(e, count, cursor)])[0]

    def paginate(self, e, count: int):
        """All pages, one after another."""
        c = START
        while c != END:
            p = self.select(e, count, c)
            yield p.ids
            c = p.next

    def select_edges(self, t: Term, count: int, cursor: Cursor = START) -> tuple[list, Cursor, Cursor]:
        """Full edges of one term: by position, or by id if ids are named."""
        self._known(t.graph_id)
        key = "position" if t.destination_ids is None else "destination_id"
        rows = self._of_node(t.graph_id, 0 if t.is_forward else 1, t.source_id).filter(F.col("state").isin(*t.states))
        if t.destination_ids is not None:
            rows = rows.filter(F.col("destination_id").isin(*t.destination_ids)) if t.destination_ids else rows.filter(F.lit(False))
        got = keyset_pages(rows.withColumn("k", F.col(key)), ["graph_id"], "k", count, cursor, "destination_id").collect()
        page, got = _page(got)
        return [{k: v for k, v in r.asDict().items() if k not in ("k", "bucket", "next", "prev")} for r in got], page.next, page.prev

    def scan(self, after: tuple | None, count: int, graph_id: int, direction: int = 0):
        """Edges of a graph in order of (source, destination), after a composite key, and the key to go on from."""
        self._known(graph_id)
        rows = scan_after(self.edges.filter((F.col("graph_id") == graph_id) & (F.col("direction") == direction)), ["source_id", "destination_id"], after, count + 1).collect()
        more = len(rows) > count
        rows = rows[:count]
        return rows, (rows[-1]["source_id"], rows[-1]["destination_id"]) if more else None

    # --- counts

    def node_count(self, t: Term) -> int:
        """The node's count if its state is asked for, else 0."""
        self._known(t.graph_id)
        return self._node_counts([t])[t]

    def _node_counts(self, terms: list[Term]) -> dict[Term, int]:
        """Node counts of many terms in one job."""
        out = dict.fromkeys(terms, 0)
        if not out:
            return out
        asked = self.spark.createDataFrame([(i, t.graph_id, 0 if t.is_forward else 1, t.source_id) for i, t in enumerate(out)], "i int, graph_id int, direction int, source_id long")
        nodes = self._nodes
        if self.store is not None:
            m = self.store.manifest()
            nodes = self.store.nodes({k for t in out for k in self.store.partitions(t.graph_id, 0 if t.is_forward else 1, [t.source_id], m)})
        order = list(out)
        for r in nodes.join(asked, ["graph_id", "direction", "source_id"]).select("i", "state", "count").collect():
            if r["state"] in order[r["i"]].states:
                out[order[r["i"]]] = r["count"]
        return out

    def count2(self, queries) -> list[int]:
        """Sizes, estimated for compound expressions; all node counts they take come from one job."""
        asked = [self._checked(e) for e in queries]
        leaves = [t for e in asked for kind, t in algebra.to_postfix(e) if kind == "term" and t.destination_ids is None]
        sizes = self._node_counts(list(dict.fromkeys(leaves)))
        return [algebra.size_estimate(e, sizes.__getitem__) for e in asked]

    def count(self, e) -> int:
        return self.count2([e])[0]

    def exact_count(self, e) -> int:
        e = self._checked(e)
        return algebra.evaluate(self._stored_for(t for kind, t in algebra.to_postfix(e) if kind == "term"), e).count()

    # --- writing

    def execute(self, *changes: Change, priority: int = HIGH, now: int | None = None) -> Graphs:
        """The graphs with the changes applied in order. Nothing to do and unknown graphs or operations are errors.

        Only partitions that the changes touch are read and written. The former version can still be read until
        the store has dropped it (see :data:`adjset.sources.store.KEPT_VERSIONS`).
        """
        if not changes:
            raise GraphError("nothing to execute")
        now = int(time.time()) if now is None else now
        for c in changes:
            self._known(c.term.graph_id)
            if c.op not in L.STATE_OF_OP:
                raise GraphError(f"unknown operation {c.op}")
        store = GraphStore(self.spark, self.store.path) if self.store is not None else GraphStore(self.spark, new_path(self.spark))
        if self.store is None:
            store.write_nodes(self._nodes)
            store.write_copies(self._edges.filter("direction = 0"))
        start = store.manifest()["seq"] + 1
        rows = []
        for i, c in enumerate(changes):
            t = c.term
            at = now if c.execute_at is None else c.execute_at
            rows.append((start + i, t.graph_id, t.source_id, t.is_forward, None if t.destination_ids is None else list(t.destination_ids), c.op, at * 1000 << 20 if c.position is None else c.position, at, priority, None))
        store.apply(self.spark.createDataFrame(rows, OPS))
        return Graphs.open(store, self.graph_ids)


def _page(rows: list) -> tuple[Page, list]:
    """The page that rows of keyset_pages are, highest key first, and these rows in order."""
    rows = sorted(rows, key=lambda r: (r["k"] is not None, r["k"] or 0, r["destination_id"]), reverse=True)
    cursor = lambda x: END if x["kind"] == "end" else Cursor(x["kind"], x["key"], x["tie"])
    return (Page([r["destination_id"] for r in rows], cursor(rows[0]["next"]), cursor(rows[0]["prev"])) if rows else Page([], END, END)), rows
