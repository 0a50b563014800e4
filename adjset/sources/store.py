"""Stored graphs: edges in both directions and counts of nodes, in partitions that are written and read by themselves.

``edges`` is partitioned by direction, graph and bucket, which is a hash of the node that an edge is stored under, and sorted
by it and the other end, so a look-up reads one partition and skips most of its row groups. ``counts`` holds the number of
edges per node and state, partitioned alike, and is kept up by the differences that a write makes. ``mass`` holds the mass
operations. A version is a manifest that says where each partition was written last; a write makes new files for the
partitions that it touches and then the manifest, which makes it count. A write that fails leaves no manifest and
runs again from the same base. There is one writer at a time.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lattice as L
from ..functions.session import written
from ..model import EDGES, NODES
from ..operators.current import EDGE, current_rows
from ..operators.fold import both_directions, fold_onto, mass_ops, node_timeline
from ..operators.changefeed import explicit_ops

MASS = "graph_id int, direction int, node long, seq long, rank long"
#: Partition columns come last and are bounded: two directions, the graphs, the buckets.
PARTITION = ("direction", "graph_id", "bucket")
_EDGE_FILE = "source_id long, destination_id long, position long, updated_at long, count int, state int"
_COUNT_FILE = "source_id long, state int, n long"
_PARTS = ", version int, direction int, graph_id int, bucket int"
KEPT_VERSIONS = 2


def bucket_column(node: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def bucket_of(node: int, buckets: int) -> int:
    """:func:`bucket_column` of one node, for look-ups."""
    import xxhash

    h = xxhash.xxh64_intdigest(struct.pack("<q", node), seed=42)
    return (h - (1 << 64) if h >= 1 << 63 else h) % buckets


class GraphStore:
    """Versions of stored graphs in a folder; see the module. ``buckets`` is fixed by the first version: a bucket of a graph
    should have some hundreds of MB. A node with most of the edges is stored in several files of its bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, version: int | None = None):
        self.spark, self.path, self._buckets, self.pinned = spark, path.rstrip("/"), buckets, version

    # --- manifests

    def _fs(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm

    def versions(self) -> list[int]:
        fs, p, _ = self._fs("manifest")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, by default of the pinned one or the newest."""
        version = self.pinned if version is None else version
        if version is None:
            v = self.versions()
            if not v:
                return {"version": 0, "buckets": self._buckets, "edges": {}, "counts": {}, "mass": [], "seq": 0}
            version = v[-1]
        fs, p, jvm = self._fs("manifest", f"v{version}.json")
        s = fs.open(p)
        try:
            return json.loads(str(jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")))
        finally:
            s.close()

    def _commit(self, m: dict) -> None:
        fs, p, jvm = self._fs("manifest", f"v{m['version']}.json")
        _, temp, _ = self._fs("manifest", f".v{m['version']}.tmp")
        out = fs.create(temp, True)
        try:
            out.write(bytearray(json.dumps(m).encode()))
        finally:
            out.close()
        if not fs.rename(temp, p):
            raise RuntimeError(f"version {m['version']} was written by someone else")
        for old in self.versions()[:-KEPT_VERSIONS]:
            fs.delete(self._fs("manifest", f"v{old}.json")[1], False)
        # files of versions that no manifest kept refers to any more
        kept = [self.manifest(v) for v in self.versions()]
        for table in ("edges", "counts"):
            used = {v for k in kept for v in k[table].values()}
            fs, base, jvm = self._fs(table)
            for s in fs.listStatus(base) if fs.exists(base) else []:
                v = int(s.getPath().getName().split("=")[1])
                if v not in used and v < m["version"]:
                    fs.delete(s.getPath(), True)

    def pinned_at(self, version: int) -> GraphStore:
        return GraphStore(self.spark, self.path, self._buckets, version)

    @property
    def buckets(self) -> int:
        return self.manifest()["buckets"]

    # --- reading

    def _read(self, table: str, schema: str, m: dict, keep=None) -> DataFrame:
        parts = {k: v for k, v in m[table].items() if keep is None or k in keep}
        full = schema + _PARTS
        if not parts:
            df = self.spark.createDataFrame([], full)
        else:
            paths = [f"{self.path}/{table}/version={v}/direction={d}/graph_id={g}/bucket={b}" for k, v in parts.items() for d, g, b in [k.split("/")]]
            df = self.spark.read.schema(full).option("basePath", f"{self.path}/{table}").parquet(*paths)
        return df.drop("version").withMetadata("bucket", {"buckets": m["buckets"]})

    def partitions(self, graph_id: int, direction: int, nodes, m: dict | None = None) -> set[str]:
        """Names of the partitions that hold these nodes."""
        n = (m or self.manifest())["buckets"]
        return {f"{direction}/{graph_id}/{bucket_of(x, n)}" for x in nodes}

    def edges(self, keep: set[str] | None = None) -> DataFrame:
        """Edges of both directions, or those of the partitions named."""
        return self._read("edges", _EDGE_FILE, self.manifest(), keep)

    def read(self) -> DataFrame:
        """Forward edges, one row each: graph_id, source_id, destination_id, position, updated_at, count, state."""
        m = self.manifest()
        return self._read("edges", _EDGE_FILE, m, {k for k in m["edges"] if k.startswith("0/")}).select(*EDGE, "position", "updated_at", "count", "state")

    def counts(self, keep: set[str] | None = None) -> DataFrame:
        return self._read("counts", _COUNT_FILE, self.manifest(), keep)

    def mass(self) -> DataFrame:
        """All mass operations, once each."""
        vs = self.manifest()["mass"]
        return self.spark.read.schema(MASS).parquet(*[f"{self.path}/mass/v{v}" for v in vs]) if vs else self.spark.createDataFrame([], MASS)

    def nodes(self, keep: set[str] | None = None) -> DataFrame:
        """Nodes of both directions with edges or mass operations: graph_id, direction, source_id, state, count, updated_at.
        count is the number of edges in the node's own state, from the counts kept up; edges aren't read."""
        key = ["graph_id", "direction", "source_id"]
        line = node_timeline(self.mass()).groupBy("graph_id", "direction", F.col("node").alias("source_id")).agg(F.max("node_rank").alias("node_rank"))
        if keep is not None:
            line = line.withColumn("bucket", bucket_column("source_id", self.buckets)).filter(F.concat_ws("/", *PARTITION).isin(list(keep))).drop("bucket")
        j = self.counts(keep).select(*key, F.col("state").alias("s"), "n").join(line, key, "full").withColumn("node_rank", F.coalesce("node_rank", F.lit(1).cast("long")))
        mine = F.coalesce(F.sum(F.when(F.col("s").eqNullSafe(L.rank_state("node_rank")), F.col("n"))), F.lit(0)).cast("long")
        return j.groupBy(*key, "node_rank").agg(mine.alias("count")).select(*key, L.rank_state("node_rank").alias("state"), "count", L.rank_time("node_rank").alias("updated_at"))

    # --- writing

    def _write(self, rows: DataFrame, table: str, version: int, n: int) -> None:
        """By partition; a range of (partition, node, other end) per task, so a hot node is cut into several files."""
        order = [*PARTITION, "source_id", *(["destination_id"] if "destination_id" in rows.columns else [])]
        r = rows.withColumn("bucket", bucket_column("source_id", n))
        w = r.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").mode("overwrite")
        w.partitionBy(*PARTITION).parquet(f"{self.path}/{table}/version={version}")

    def _written(self, table: str, version: int) -> dict[str, int]:
        """The partitions that a version wrote."""
        fs, base, _ = self._fs(table, f"version={version}")
        out = {}
        for d in fs.listStatus(base) if fs.exists(base) else []:
            if d.isDirectory():
                for g in fs.listStatus(d.getPath()):
                    for b in fs.listStatus(g.getPath()):
                        out["/".join(x.getPath().getName().split("=")[1] for x in (d, g, b))] = version
        return out

    def _changed(self, images: DataFrame, m: dict, new_mass: DataFrame | None, seq: int) -> int:
        """Writes what images (EDGE, known, rank0, rank1, pos1) change, and the next version's manifest."""
        v, n = m["version"] + 1, m["buckets"]
        ends = F.array(*[F.struct(F.lit(i).alias("direction"), F.col(a).alias("source_id"), F.col(b).alias("destination_id")) for i, (a, b) in enumerate((EDGE[1:], EDGE[:0:-1]))])
        both = images.select("graph_id", "known", "rank0", "rank1", "pos1", F.inline(ends))
        touched = {f"{r.direction}/{r.graph_id}/{r.b}" for r in both.select("direction", "graph_id", bucket_column("source_id", n).alias("b")).distinct().collect()}
        manifest = {**m, "version": v, "seq": max(seq, m["seq"])}
        if touched:
            edge_key = ["direction", *EDGE]
            old = self._read("edges", _EDGE_FILE, m, touched).drop("bucket")
            now = both.select(*edge_key, F.col("pos1").alias("position"), L.rank_time("rank1").alias("updated_at"), F.lit(0).alias("count"), L.rank_state("rank1").alias("state"))
            self._write(old.join(both.select(*edge_key), edge_key, "left_anti").unionByName(now), "edges", v, n)
            # a difference of counts per edge that changed its state: one less in the old, one more in the new
            parts = F.array_compact(F.array(F.when(F.col("known"), F.struct(L.rank_state("rank0").alias("state"), F.lit(-1).alias("n"))), F.struct(L.rank_state("rank1").alias("state"), F.lit(1).alias("n"))))
            delta = both.filter(~F.col("known") | (L.rank_ordinal("rank0") != L.rank_ordinal("rank1"))).select("direction", "graph_id", "source_id", F.inline(parts))
            delta = delta.groupBy("direction", "graph_id", "source_id", "state").agg(F.sum("n").alias("n"))
            counts = self._read("counts", _COUNT_FILE, m, touched).drop("bucket").unionByName(delta).groupBy("direction", "graph_id", "source_id", "state").agg(F.sum("n").alias("n")).filter("n != 0")
            self._write(counts, "counts", v, n)
            manifest["edges"] = {**m["edges"], **self._written("edges", v)}
            manifest["counts"] = {**{k: x for k, x in m["counts"].items() if k not in touched}, **self._written("counts", v)}
        if new_mass is not None and not new_mass.isEmpty():
            new_mass.write.mode("overwrite").parquet(f"{self.path}/mass/v{v}")
            manifest["mass"] = [*m["mass"], v]
        self._commit(manifest)
        return v

    def apply(self, ops: DataFrame) -> int:
        """Operations folded onto the stored edges; the new version. Only partitions with an edge that an operation names or
        a mass operation touches are read and written. Operations may come again: the newest time and state wins, and a mass
        operation counts once by its seq."""
        m = self.manifest()
        n = m["buckets"]
        ops = written(ops)
        seq = ops.agg(F.max("seq")).head()[0] or 0
        new = written(mass_ops(ops).join(self.mass().select("seq"), "seq", "left_anti").select("graph_id", "direction", "node", "seq", "rank"))
        first = explicit_ops(ops).select("graph_id", "source_id").unionByName(new.filter("direction = 0").select("graph_id", F.col("node").alias("source_id")))
        at = new.filter("direction = 1").select("graph_id", F.col("node").alias("source_id"))
        back = {f"1/{r.graph_id}/{r.b}" for r in at.select("graph_id", bucket_column("source_id", n).alias("b")).distinct().collect()}
        if back:  # sources of the edges that point to a node of a mass operation
            met = self._read("edges", _EDGE_FILE, m, back).join(at.distinct(), ["graph_id", "source_id"], "left_semi")
            first = first.unionByName(met.select("graph_id", F.col("destination_id").alias("source_id")))
        touched = {f"0/{r.graph_id}/{r.b}" for r in first.select("graph_id", bucket_column("source_id", n).alias("b")).distinct().collect()}
        base = self._read("edges", _EDGE_FILE, m, touched).select(*EDGE, L.rank().alias("rank0"), F.col("position").alias("pos0"))
        images = fold_onto(base, self.mass(), new, ops)
        known = base.select(*EDGE, "rank0", F.lit(True).alias("known"))
        return self._changed(written(images.join(known, list(EDGE), "left").withColumn("known", F.coalesce("known", F.lit(False)))), m, new, seq)

    def write_copies(self, edges: DataFrame) -> int:
        """Edge rows merged into the stored ones, the newest time and state winning, counts kept up; the new version."""
        m = self.manifest()
        rows = written(current_rows(edges, EDGE, ["position"]))
        touched = {f"0/{r.graph_id}/{r.b}" for r in rows.select("graph_id", bucket_column("source_id", m["buckets"]).alias("b")).distinct().collect()}
        old = self._read("edges", _EDGE_FILE, m, touched).select(*EDGE, L.rank().alias("rank0"), F.lit(True).alias("known"))
        j = rows.select(*EDGE, F.col("rank").alias("rank1"), F.col("position").alias("pos1")).join(old, list(EDGE), "left").withColumn("known", F.coalesce("known", F.lit(False)))
        return self._changed(written(j.filter(~F.col("known") | (F.col("rank1") > F.col("rank0")))), m, None, 0)

    def bulk_insert(self, edges: DataFrame) -> int:
        """Edges that aren't stored yet, one row each, in bulk: not looked for, only put beside the others. Keys that are
        stored would stand twice. Rows with a null key take no part."""
        m = self.manifest()
        rows = edges.dropna(subset=list(EDGE)).select(*EDGE, F.lit(False).alias("known"), F.lit(None).cast("long").alias("rank0"), L.rank().alias("rank1"), F.col("position").alias("pos1"))
        return self._changed(written(rows), m, None, 0)

    def write_nodes(self, nodes: DataFrame) -> int:
        """Node rows (graph_id, direction, source_id, state, updated_at) as states of their nodes; the newest time and state
        wins. Their edges aren't touched and counts follow from these, so a count in the rows is left out of account."""
        m = self.manifest()
        # in front of all operations: a node row is where a node starts from
        seq = F.lit(-(1 << 62)) + F.shiftrightunsigned(F.xxhash64("graph_id", "direction", "source_id", "state", "updated_at"), 3)
        new = nodes.dropna(subset=["graph_id", "direction", "source_id"]).select("graph_id", "direction", F.col("source_id").alias("node"), seq.alias("seq"), L.rank().alias("rank")).distinct()
        return self._changed(self._nothing(), m, written(new), 0)

    bulk_insert_nodes = write_nodes

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "graph_id int, source_id long, destination_id long, known boolean, rank0 long, rank1 long, pos1 long")


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Tables of edges and nodes without rows."""
    return spark.createDataFrame([], EDGES), spark.createDataFrame([], NODES)


def table_id(direction: Column, graph_id: Column) -> Column:
    """One number for graph and direction: the graph forward, minus the graph backward."""
    return graph_id * F.when(direction == 0, 1).otherwise(-1)
