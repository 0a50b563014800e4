"""Set expressions over neighbours: terms, a syntax tree, postfix programs, and their evaluation for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lattice as L
from ..model import GraphError

#: Part of the smaller side that an intersection is assumed to keep (fixed value of the estimate).
KEPT = 0.1


@dataclass(frozen=True)
class Expr:
    """A node of the tree; ``&``, ``|`` and ``-`` build set expressions."""

    def __and__(self, other: Expr) -> Expr:
        return self if isinstance(other, Everything) else other if isinstance(self, Everything) else Op("intersection", self, other)

    def __or__(self, other: Expr) -> Expr:
        return Op("union", self, other)

    def __sub__(self, other: Expr) -> Expr:
        return Op("difference", self, other)

    intersect, union, difference = __and__, __or__, __sub__


@dataclass(frozen=True)
class Everything(Expr):
    """The identity of intersection."""


@dataclass(frozen=True)
class Term(Expr):
    """Neighbours of a node. destination_ids None is a wildcard, an empty tuple names nothing; states default to Normal."""

    source_id: int
    graph_id: int
    is_forward: bool = True
    destination_ids: tuple[int, ...] | None = None
    states: tuple[int, ...] = (L.NORMAL,)

    def with_states(self, *states: int) -> Term:
        return Term(self.source_id, self.graph_id, self.is_forward, self.destination_ids, tuple(dict.fromkeys(states)))

    @property
    def negative(self) -> Term:
        return self.with_states(L.NEGATIVE)


@dataclass(frozen=True)
class Op(Expr):
    kind: str
    left: Expr
    right: Expr


def depth(e: Expr) -> int:
    return 1 + max(depth(e.left), depth(e.right)) if isinstance(e, Op) else 0


def complexity(e: Expr) -> int:
    """Number of set operations in the tree."""
    return 1 + complexity(e.left) + complexity(e.right) if isinstance(e, Op) else 0


def to_postfix(e: Expr) -> list[tuple[str, Term | None]]:
    if isinstance(e, Op):
        return [*to_postfix(e.left), *to_postfix(e.right), (e.kind, None)]
    if isinstance(e, Everything):
        raise GraphError("nothing to select from")
    return [("term", e)]


def from_postfix(program: list[tuple[str, Term | None]]) -> Expr:
    """A stack program to a tree. An empty program, an operation short of operands, more than one value left over and an
    unknown operation are errors. Of a difference, the value pushed last is what is taken away."""
    stack: list[Expr] = []
    for kind, term in program:
        if kind == "term":
            stack.append(term)
        elif kind in ("intersection", "union", "difference"):
            if len(stack) < 2:
                raise GraphError(f"{kind} needs two operands")
            right, left = stack.pop(), stack.pop()
            stack.append({"intersection": left.__and__, "union": left.__or__, "difference": left.__sub__}[kind](right))
        else:
            raise GraphError(f"unknown operation {kind}")
    if len(stack) != 1:
        raise GraphError("a program must leave one value")
    return stack[0]


def leaf(edges: DataFrame, t: Term) -> DataFrame:
    """destination_id and position of a term; edges hold both directions. All conditions reach the scan."""
    direction = 0 if t.is_forward else 1
    rows = edges.filter((F.col("graph_id") == t.graph_id) & (F.col("direction") == direction) & (F.col("source_id") == t.source_id) & F.col("state").isin(*t.states))
    if t.destination_ids is not None:
        rows = rows.filter(F.col("destination_id").isin(*t.destination_ids)) if t.destination_ids else rows.filter(F.lit(False))
    return rows.select("destination_id", "position")


def evaluate(edges: DataFrame, e: Expr) -> DataFrame:
    """The ids of an expression, distinct: destination_id."""
    if isinstance(e, Op):
        return combined(evaluate(edges, e.left), evaluate(edges, e.right), e.kind, ["destination_id"])
    return leaf(edges, e).select("destination_id")


def combined(left: DataFrame, right: DataFrame, kind: str, on: list[str]) -> DataFrame:
    """A set operation of rows that are distinct on each side, for all queries in ``on`` at once: semi join, distinct
    union, anti join. Sides of a measured small size are broadcast by the optimizer."""
    if kind == "union":
        return left.select(*on).unionByName(right.select(*on)).dropDuplicates(on)
    return left.join(right.select(*on), on, "left_semi" if kind == "intersection" else "left_anti")


def neighbours(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Many terms in one job: terms(query_id, leaf_no, graph_id, source_id, is_forward, destination_ids, states) to
    (query_id, leaf_no, destination_id, position). null destination_ids is a wildcard, null states is Normal."""
    return matches(edges, terms).select("query_id", "leaf_no", "destination_id", "position")


def matches(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Full edges of many terms: the columns of edges and query_id, leaf_no. Edges stored in buckets by source (a column
    ``bucket``, see :mod:`adjset.sources.store`) are read only where a term has its source."""
    t = terms.withColumn("direction", F.when(F.coalesce("is_forward", F.lit(True)), 0).otherwise(1)).drop("is_forward")
    on = ["graph_id", "direction", "source_id"]
    if "bucket" in edges.columns:
        from ..sources.store import bucket_column

        n = edges.schema["bucket"].metadata["buckets"]
        t, on = t.withColumn("bucket", bucket_column("source_id", n)), ["graph_id", "direction", "bucket", "source_id"]
    j = edges.join(t, on)
    named = F.col("destination_ids").isNull() | F.array_contains("destination_ids", F.col("destination_id"))
    return j.filter(named & F.array_contains(F.coalesce("states", F.array(F.lit(L.NORMAL))), F.col("state"))).select("query_id", "leaf_no", *edges.columns)


def evaluate_batch(leaves: DataFrame, shape: Expr | list, on=("query_id", "destination_id")) -> DataFrame:
    """The same postfix shape for every query: a list of leaf numbers and operation names."""
    stack: list[DataFrame] = []
    for x in shape:
        if isinstance(x, int):
            stack.append(leaves.filter(F.col("leaf_no") == x).select(*on).dropDuplicates(list(on)))
        else:
            if len(stack) < 2:
                raise GraphError(f"{x} needs two operands")
            right, left = stack.pop(), stack.pop()
            stack.append(combined(left, right, x, list(on)))
    if len(stack) != 1:
        raise GraphError("a program must leave one value")
    return stack[0]


#: Leaves whose membership fits in one long.
_WORD = 63
_CODES = {"intersection": -1, "union": -2, "difference": -3}


def program_of(e: Expr, first: int = 0) -> tuple[list[int], list[Term]]:
    """An expression as codes of a stack machine, leaf numbers from ``first`` and -1 to -3 for the operations, and its
    terms in the order of their numbers."""
    codes, terms = [], []
    for kind, t in to_postfix(e):
        codes.append(first + len(terms) if kind == "term" else _CODES[kind])
        if kind == "term":
            terms.append(t)
    return codes, terms


def evaluate_programs(leaves: DataFrame, programs: DataFrame, most_leaves: int) -> DataFrame:
    """Every query by its own program, all in one job: query_id, destination_id, position (the greatest of the leaves).

    leaves: see :func:`neighbours`. programs: query_id and ``program``, an array of codes (see :func:`program_of`).
    most_leaves: the greatest number of leaves of a query. The leaves that an id is in become bits, one aggregation per
    query and id, combined before its shuffle; a program then works on these bits. A query's own large sets are spread by
    id. An id with a null and a query without program take no part.
    """
    words = [F.coalesce(F.bit_or(F.expr(f"CASE WHEN leaf_no >= {w} AND leaf_no < {w + _WORD} THEN shiftleft(1L, leaf_no - {w}) END")), F.lit(0).cast("long")).alias(f"w{w // _WORD}_") for w in range(0, max(1, most_leaves), _WORD)]
    got = leaves.groupBy("query_id", "destination_id").agg(*words, F.max("position").alias("position")).join(programs.select("query_id", "program"), "query_id")
    bits = F.array(*[F.col(f"w{i}_") for i in range(len(words))])

    def step(stack: Column, code: Column) -> Column:
        n = F.size(stack)
        a, b = F.get(stack, n - 2), F.get(stack, n - 1)
        value = F.when(code == -1, a & b).when(code == -2, a | b).otherwise(a & ~b)
        leaf = F.getbit(F.get(bits, F.floor(code / _WORD).cast("int")), F.pmod(code, F.lit(_WORD))) == 1
        return F.when(code >= 0, F.concat(stack, F.array(leaf))).otherwise(F.concat(F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(value)))

    inside = F.get(F.aggregate("program", F.array().cast("array<boolean>"), step), F.lit(0))
    return got.filter(inside).select("query_id", "destination_id", "position")


def terms_frame(spark, terms: list[tuple[int, int, Term]]) -> DataFrame:
    """(query, leaf number, term) as the rows that :func:`neighbours` takes."""
    rows = [(q, i, t.graph_id, t.source_id, t.is_forward, None if t.destination_ids is None else list(t.destination_ids), list(t.states)) for q, i, t in terms]
    return spark.createDataFrame(rows, "query_id int, leaf_no int, graph_id int, source_id long, is_forward boolean, destination_ids array<long>, states array<int>")


def size_estimate(e: Expr, leaf_size) -> int:
    """leaf_size(term) for leaves; intersection int(min * 0.1), union max, difference left."""
    if isinstance(e, Term):
        return len(e.destination_ids) if e.destination_ids is not None else leaf_size(e)
    a, b = size_estimate(e.left, leaf_size), size_estimate(e.right, leaf_size)
    return {"intersection": int(min(a, b) * KEPT), "union": max(a, b), "difference": a}[e.kind]


def estimate_columns(kind: str, a: Column, b: Column) -> Column:
    return {"intersection": F.floor(F.least(a, b) * F.lit(KEPT)).cast("long"), "union": F.greatest(a, b), "difference": a}[kind]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
