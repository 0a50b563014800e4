"""Queries of the general data problems over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import changefeed, drift, orphans, reconcile
from ..operators.current import EDGE, NODE
from ..sources.tables import table

RANK = "updated_at * 8 + CASE state WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 2 THEN 3 WHEN 1 THEN 4 ELSE 0 END"
STATE = "CASE {} % 8 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 END"


def _current(name: str, keys, fields=(), arrival: bool = False) -> str:
    cols = [f"max_by({f}, k) AS {f}" for f in fields] + (["min(loaded_at) AS arrived"] if arrival else [])
    k = f"{{'r': {RANK}" + "".join(f", '{f}': ({f} IS NOT NULL, coalesce({f}, 0))" for f in fields) + "}"
    # null fields are wrapped, since max_by leaves out null values
    cols = [f"max(k).{f} AS {f}_" for f in fields] + cols[len(fields) :]
    inner = f"SELECT *, {k} AS k FROM {name} WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in keys)
    out = [f"CASE WHEN {f}_[1] THEN {f}_[2] END AS {f}" for f in fields]
    ks = ", ".join(keys)
    agg = f"SELECT {ks}, max(k).r AS r" + "".join(", " + c for c in cols) + f" FROM ({inner}) GROUP BY {ks}"
    return f"SELECT {ks}, r // 8 AS updated_at, r, CAST({STATE.format('r')} AS INT) AS state" + "".join(", " + c for c in out) + (", arrived" if arrival else "") + f" FROM ({agg})"


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drifted_counts(table(spark, sf, "graph_edges"), table(spark, sf, "graph_metadata")).select(*NODE)


def p2_edge_counts(spark: SparkSession, sf: str) -> DataFrame:
    return drift.edge_counts(table(spark, sf, "graph_edges"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return changefeed.changed_rows(table(spark, sf, "graph_edges"), table(spark, sf, "execute_operations")).select(*EDGE, "state", "position")


def p4_table(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "graph_edges")
    return changefeed.consolidated(edges, changefeed.signed_changes(edges, table(spark, sf, "execute_operations")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.copy_differences(table(spark, sf, "graph_edges"), table(spark, sf, "replica_edges"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_references(table(spark, sf, "graph_edges"), table(spark, sf, "graph_metadata")).select(*EDGE, "field", "kind")


def p6_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphans_by_month(orphans.orphan_references(table(spark, sf, "graph_edges"), table(spark, sf, "graph_metadata")))


QUERIES = {f.__name__: f for f in (p2_found, p2_edge_counts, p4_found, p4_table, p5_found, p6_found, p6_by_month)}

_E = _current("graph_edges", EDGE, ["position", "count"], True)
_N = _current("graph_metadata", NODE, ["count"], True)

_FOLD = f"""
WITH RECURSIVE base AS ({_current("graph_edges", EDGE, ["position"])}),
o1 AS (SELECT DISTINCT ON (seq) * FROM execute_operations WHERE seq IS NOT NULL AND len(destination_ids) > 0 ORDER BY seq, queued_at),
o2 AS (SELECT *, unnest(destination_ids) AS other, unnest(range(len(destination_ids))) AS idx FROM o1),
ops AS (SELECT graph_id, CASE WHEN coalesce(is_forward, true) THEN source_id ELSE other END AS source_id,
  CASE WHEN coalesce(is_forward, true) THEN other ELSE source_id END AS destination_id, seq, idx,
  coalesce(execute_at, epoch_us(queued_at) // 1000000) * 8 + CASE op WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 2 THEN 4 END AS r,
  coalesce(position, epoch_us(queued_at) // 1000 * 1048576) AS pos FROM o2 WHERE op IN (1, 2, 3, 4)),
seqd AS (SELECT *, row_number() OVER (PARTITION BY graph_id, source_id, destination_id ORDER BY seq, idx) AS n FROM ops
  WHERE graph_id IS NOT NULL AND source_id IS NOT NULL AND destination_id IS NOT NULL),
fold AS (
  SELECT s.graph_id, s.source_id, s.destination_id, CAST(0 AS BIGINT) AS n, b.r, b.position AS pos FROM (SELECT DISTINCT graph_id, source_id, destination_id FROM seqd) s
    LEFT JOIN base b USING (graph_id, source_id, destination_id)
  UNION ALL
  SELECT f.graph_id, f.source_id, f.destination_id, s.n, CASE WHEN f.r IS NULL OR s.r >= f.r THEN s.r ELSE f.r END,
    CASE WHEN f.r IS NULL OR (s.r >= f.r AND s.r % 8 = 1 AND f.r % 8 IN (2, 4)) THEN s.pos ELSE f.pos END
  FROM fold f JOIN seqd s ON f.graph_id = s.graph_id AND f.source_id = s.source_id AND f.destination_id = s.destination_id AND s.n = f.n + 1),
done AS (SELECT DISTINCT ON (graph_id, source_id, destination_id) * FROM fold ORDER BY graph_id, source_id, destination_id, n DESC)
"""

_ORPHANS = f"""
WITH e AS ({_E}), n AS ({_N}),
refs AS (SELECT *, 'source_id' AS field, source_id AS node FROM e UNION ALL SELECT *, 'destination_id', destination_id FROM e),
found AS (SELECT r.graph_id, r.source_id, r.destination_id, r.field, r.updated_at,
  CASE WHEN n.source_id IS NULL THEN 'missing' WHEN n.state = 1 AND r.state <> 1 THEN 'deleted' WHEN n.arrived > r.arrived THEN 'late' END AS kind
  FROM refs r LEFT JOIN n ON n.graph_id = r.graph_id AND n.source_id = r.node)
"""

SQL = {
    "p2_found": f"WITH e AS ({_E}), n AS ({_N}) SELECT n.graph_id, n.source_id FROM n LEFT JOIN (SELECT graph_id, source_id, state, count(*) AS c FROM e GROUP BY ALL) x"
    " ON x.graph_id = n.graph_id AND x.source_id = n.source_id AND x.state = n.state WHERE n.count IS DISTINCT FROM coalesce(x.c, 0)",
    "p2_edge_counts": f"SELECT graph_id, source_id, state, count(*) AS edges FROM ({_E}) GROUP BY ALL",
    "p4_found": _FOLD + f"""SELECT d.graph_id, d.source_id, d.destination_id, CAST({STATE.format('d.r')} AS INT) AS state, d.pos AS position FROM done d
  LEFT JOIN base b USING (graph_id, source_id, destination_id) WHERE b.r IS NULL OR b.r <> d.r OR b.position IS DISTINCT FROM d.pos""",
    "p4_table": _FOLD + f"""SELECT graph_id, source_id, destination_id, CAST({STATE.format('x.r')} AS INT) AS state, x.r // 8 AS updated_at, x.position FROM
  (SELECT graph_id, source_id, destination_id, r, pos AS position FROM done UNION ALL
   SELECT graph_id, source_id, destination_id, r, position FROM base b ANTI JOIN done USING (graph_id, source_id, destination_id)) x""",
    "p5_found": f"""WITH a AS ({_current("graph_edges", EDGE, ["position", "count"])}), b AS ({_current("replica_edges", EDGE, ["position", "count"])}),
j AS (SELECT graph_id, source_id, destination_id, a.r AS ar, b.r AS br, a.position AS ap, b.position AS bp, a.count AS ac, b.count AS bc FROM a FULL JOIN b USING (graph_id, source_id, destination_id))
SELECT graph_id, source_id, destination_id, 'missing_in_replica' AS field FROM j WHERE br IS NULL UNION ALL
SELECT graph_id, source_id, destination_id, 'missing_in_primary' FROM j WHERE ar IS NULL UNION ALL
SELECT graph_id, source_id, destination_id, 'position' FROM j WHERE ar IS NOT NULL AND br IS NOT NULL AND ap IS DISTINCT FROM bp UNION ALL
SELECT graph_id, source_id, destination_id, 'count' FROM j WHERE ar IS NOT NULL AND br IS NOT NULL AND ac IS DISTINCT FROM bc UNION ALL
SELECT graph_id, source_id, destination_id, 'updated_at' FROM j WHERE ar // 8 <> br // 8 UNION ALL
SELECT graph_id, source_id, destination_id, 'state' FROM j WHERE ar % 8 <> br % 8""",
    "p6_found": _ORPHANS + "SELECT graph_id, source_id, destination_id, field, kind FROM found WHERE kind IS NOT NULL",
    "p6_by_month": _ORPHANS + "SELECT 'graph_edges' AS \"table\", strftime(make_timestamp(updated_at * 1000000), '%Y-%m') AS period, field, kind, count(*) AS \"references\" FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
