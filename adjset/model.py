"""Schemas of edges, nodes and operations, and typed cursors."""

from __future__ import annotations

from dataclasses import dataclass

EDGES = "graph_id int, source_id long, destination_id long, position long, updated_at long, count int, state int"
NODES = "graph_id int, direction int, source_id long, state int, count long, updated_at long"
OPS = "seq long, graph_id int, source_id long, is_forward boolean, destination_ids array<long>, op int, position long, execute_at long, priority int, queued_at timestamp"

CURSOR = "struct<kind: string, key: bigint, tie: bigint>"

FORWARD, BACKWARD = 0, 1
LOW, MEDIUM, HIGH = 1, 2, 3


class GraphError(ValueError):
    """A request that can't be answered: unknown graph or operation, missing record, malformed program."""


@dataclass(frozen=True)
class Cursor:
    """Where a page begins: at the start, below a key (forward) or above it (backward).

    ``tie`` is the destination of the row that the key comes from: rows of equal keys are told apart by it, so none is
    lost between two pages, and a null key, which is below all others, can be gone on from, too. Kinds keep start and end
    apart from the keys 0 and 1, which the wire form (-1, 0, key, -key) can't do. A cursor from the wire has no tie: it
    stands below (above) all rows of its key.
    """

    kind: str
    key: int | None = None
    tie: int | None = None

    @classmethod
    def of(cls, wire: int) -> Cursor:
        if wire == -1:
            return START
        if wire == 0:
            return END
        return cls("forward", wire) if wire > 0 else cls("backward", -wire)

    @property
    def wire(self) -> int:
        return {"start": -1, "end": 0, "forward": self.key, "backward": -(self.key or 0)}[self.kind]

    def reversed(self) -> Cursor:
        return {"forward": Cursor("backward", self.key, self.tie), "backward": Cursor("forward", self.key, self.tie)}.get(self.kind, self)


START, END = Cursor("start"), Cursor("end")


@dataclass(frozen=True)
class Page:
    ids: list
    next: Cursor
    prev: Cursor
