"""The state lattice and the merge key ``rank``.

States are stored by id and compared by ordinal. ``rank`` packs ``(updated_at, ordinal)`` into one sortable long,
``updated_at * 8 + ordinal + 1``. A null or unknown state sorts below every state and a null ``updated_at`` below
every time, so rank is never null and newest-wins is a plain ``max``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State ids, their order, operation types and the state each leads to.
NORMAL, REMOVED, ARCHIVED, NEGATIVE = 0, 1, 2, 3
ORDER = (NORMAL, NEGATIVE, ARCHIVED, REMOVED)
ADD, REMOVE, ARCHIVE, NEGATE = 1, 2, 3, 4
STATE_OF_OP = {ADD: NORMAL, REMOVE: REMOVED, ARCHIVE: ARCHIVED, NEGATE: NEGATIVE}

#: Stands for a null time inside a rank; no real epoch second is near it.
NO_TIME = -(2**59)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(x: Column, pairs, otherwise) -> Column:
    out = None
    for k, v in pairs:
        out = F.when(x == k, F.lit(v)) if out is None else out.when(x == k, F.lit(v))
    return out.otherwise(otherwise)


def ordinal(state: Column | str) -> Column:
    """State id to its place in the order Normal < Negative < Archived < Removed; null for anything else."""
    return _map(_c(state), [(s, i) for i, s in enumerate(ORDER)], F.lit(None).cast("int"))


def state_of(ordinal_: Column | str) -> Column:
    """Ordinal back to the state id (int)."""
    return _map(_c(ordinal_), list(enumerate(ORDER)), F.lit(None).cast("int"))


def max_state(*states: Column | str) -> Column:
    """The greatest of several states by ordinal, nulls left out."""
    o = [ordinal(s) for s in states]
    return state_of(F.greatest(*o) if len(o) > 1 else o[0])


def op_ordinal(op: Column | str) -> Column:
    """Operation type to the ordinal of the state it leads to; null for an unknown type."""
    return _map(_c(op), [(k, ORDER.index(v)) for k, v in STATE_OF_OP.items()], F.lit(None).cast("int"))


def rank_of(updated_at: Column, ordinal_: Column) -> Column:
    """``(updated_at, ordinal)`` as one long."""
    return F.coalesce(updated_at.cast("long"), F.lit(NO_TIME)) * 8 + F.coalesce(ordinal_ + 1, F.lit(0))


def rank(updated_at: Column | str = "updated_at", state: Column | str = "state") -> Column:
    return rank_of(_c(updated_at), ordinal(state))


def rank_ordinal(r: Column | str) -> Column:
    """The ordinal inside a rank; -1 stands for a null state."""
    return (F.pmod(_c(r), F.lit(8)) - 1).cast("int")


def rank_state(r: Column | str) -> Column:
    return state_of(rank_ordinal(r))


def rank_time(r: Column | str) -> Column:
    t = F.shiftright(_c(r), 3)
    return F.when(t != NO_TIME, t)
