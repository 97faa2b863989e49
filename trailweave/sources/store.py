"""Versioned storage of the object and edge tables: atomic batch commits, snapshots, followers."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.cluster import shared_dir

FORMAT = 1
OBJECTS = "id string, content string, vector array<double>, meta string"
EDGES = "src string, relation string, dst string, weight double, meta string, ord bigint"
SIGNATURES = "id string, topo_signature array<double>, n_nodes long"
CHANGES = "seq bigint, op string, id string, content string, vector array<double>, meta string, edges array<struct<relation:string,dst:string,weight:double,meta:string,ord:bigint>>"


class Files:
    """Small files and folders of any Hadoop file system, by its own API."""

    def __init__(self, spark: SparkSession, top: str):
        self.jvm, self.top = spark._jvm, top.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes beside and renames: the name appears with its whole content or not at all.

        FileExistsError if it is there already, which is how two writers of one version are told apart.
        """
        beside = f"{name}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self._path(beside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(name) or not self.fs.rename(self._path(beside), self._path(name)):
            self.fs.delete(self._path(beside), False)
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def merged_edges(old: DataFrame, replaced: DataFrame, new: DataFrame, parallel: bool = False) -> DataFrame:
    """Old edges but those out of ``replaced`` ids, and the new ones; the last of each (src, relation, dst) stays, or all if ``parallel``."""
    kept = old.join(replaced.select(F.col("id").alias("src")), "src", "left_anti")
    if parallel:
        return kept.unionByName(new.select(kept.columns))
    kept = kept.withColumn("_n", F.lit(0))
    both = kept.unionByName(new.withColumn("_n", F.lit(1)))
    last = both.groupBy("src", "relation", "dst").agg(F.max_by(F.struct("weight", "meta"), F.struct("_n", "ord")).alias("v"), F.min("ord").alias("ord"))
    return last.select("src", "relation", "dst", "v.weight", "v.meta", "ord")


class GraphStore:
    """Objects and edges in a folder of committed versions.

    ``versions/N.json`` names the snapshot and the change folders that make up version N; it is
    created by one rename, so a batch is there as a whole or not. Readers open a version and never
    see a later one; writers add one. ``compact`` folds changes into a snapshot. Upserts replace
    an object's outgoing edges and keep incoming ones; deletes take the object and all its edges
    for good; targets that were never inserted may be walked through but aren't objects. A store
    made with ``parallel`` keeps edges of one (src, relation, dst) side by side.
    """

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, compact_every: int = 20, parallel: bool = False):
        self.spark, self.path, self.read_only, self.compact_every, self.parallel = spark, path.rstrip("/"), read_only, compact_every, parallel
        self.files = Files(spark, self.path)
        if not self.files.exists("versions"):
            if read_only:
                raise FileNotFoundError(f"no store in {path}")
            self._snapshot_commit(self._frame([], OBJECTS), self._frame([], EDGES), 0)
        self.refresh()

    def _frame(self, rows, schema):
        return self.spark.createDataFrame(rows, schema)

    def refresh(self) -> int:
        """Opens the latest committed version, which a follower does to catch up; returns its number."""
        versions = [int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json") and n.removesuffix(".json").isdigit()]
        self.version = max(versions)
        self.manifest = self._manifest(self.version)
        self.parallel = self.manifest.get("parallel", False)
        self._view = None
        return self.version

    def _manifest(self, version: int) -> dict:
        found = json.loads(self.files.read(f"versions/{version}.json"))
        if found["format"] > FORMAT:
            raise ValueError(f"store format {found['format']} is newer than {FORMAT}")
        return found

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def changes(self) -> DataFrame:
        """All changes since the snapshot, as committed."""
        names = self.manifest["changes"]
        return self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/{n}" for n in names]) if names else self._frame([], CHANGES)

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        if self._view is None:
            objects, edges = self._read(f"{self.manifest['snapshot']}/objects", OBJECTS), self._read(f"{self.manifest['snapshot']}/edges", EDGES)
            if self.manifest["changes"]:
                objects, edges = replayed(objects, edges, self.changes(), self.parallel)
            self._view = objects, edges
        return self._view

    @property
    def objects(self) -> DataFrame:
        return self._tables()[0]

    @property
    def edges(self) -> DataFrame:
        return self._tables()[1]

    def get(self, id: str) -> DataFrame:
        return self.objects.where(F.col("id") == id)

    def get_many(self, ids: DataFrame) -> DataFrame:
        """Objects of ``ids`` (id, ord) with that ord; missing ones are skipped."""
        return ids.join(self.objects, "id")

    def __contains__(self, id: str) -> bool:
        return not self.get(id).isEmpty()

    def __len__(self) -> int:
        return self.objects.count()

    def out_edges(self, id: str) -> DataFrame:
        return self.edges.where(F.col("src") == id).orderBy("ord")

    def in_edges(self, id: str) -> DataFrame:
        return self.edges.where(F.col("dst") == id).orderBy("src", "ord")

    def dangling(self) -> DataFrame:
        """Targets that are no objects."""
        return self.edges.select(F.col("dst").alias("id")).distinct().join(self.objects.select("id"), "id", "left_anti")

    def _check(self, edges: DataFrame | None) -> None:
        if self.read_only:
            raise PermissionError("this store is open for reading only")
        if edges is not None and not edges.where((F.col("weight") < 0) | F.col("dst").isNull() | F.col("relation").isNull()).isEmpty():
            raise ValueError("edges need a relation, a target and a weight of 0 or more")

    def put(self, objects: DataFrame, edges: DataFrame | None = None) -> int:
        """Upserts objects with their outgoing edges; returns the new version. Of equal ids the last row stays."""
        with self.transaction() as t:
            t.put(objects, edges)
        return self.version

    def delete(self, ids: DataFrame) -> int:
        """Deletes objects; returns how many of the ids were objects."""
        n = ids.select("id").distinct().join(self.objects, "id", "left_semi").count()
        if n:
            with self.transaction() as t:
                t.delete(ids)
        return n

    def update(self, patches: DataFrame, edges: DataFrame | None = None) -> int:
        """Sets content where ``patches`` (id, content) has one and appends edges; unknown ids are left out."""
        known = self.objects.join(patches.groupBy("id").agg(F.last("content", True).alias("_new")), "id")
        objects = known.withColumn("content", F.coalesce("_new", "content")).drop("_new")
        own = self.edges.join(objects.select(F.col("id").alias("src")), "src", "left_semi")
        if edges is not None:
            most = own.groupBy("src").agg(F.max("ord").alias("_m"))
            new = full_edges(edges).join(objects.select(F.col("id").alias("src")), "src", "left_semi").join(most, "src", "left")
            own = own.unionByName(new.withColumn("ord", F.coalesce(F.col("_m") + 1, F.lit(0)) + F.col("ord")).drop("_m"))
        n = objects.count()
        if n:
            self.put(objects, own)
        return n

    def insert_text(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """Adds what the rules extract from ``texts`` as objects and edges; returns the ids, sorted."""
        from trailweave.operators.extraction import extract_triples

        found = extract_triples(texts.withColumn("_doc", F.monotonically_increasing_id()), "_doc", text)
        triples = found.groupBy(F.col("subject").alias("src"), "relation", F.col("object").alias("dst")).agg(F.lit(1.0).alias("weight"), F.min(F.struct("_doc", "sentence")).alias("o"))
        ids = triples.select(F.col("src").alias("id")).unionByName(triples.select(F.col("dst").alias("id"))).distinct()
        fresh = ids.join(self.objects.select("id"), "id", "left_anti").select("id", F.col("id").alias("content"))
        old = self.objects.join(triples.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
        objects = full_objects(fresh).unionByName(old)
        kept = self.edges.join(objects.select(F.col("id").alias("src")), "src", "left_semi")
        new = full_edges(triples.select("src", "relation", "dst", "weight")).withColumn("ord", F.lit(1 << 41) + F.col("ord"))
        self.put(objects, kept.unionByName(new))
        return ids.orderBy("id")

    @contextmanager
    def transaction(self):
        """Collects changes and commits them as one version; an exception leaves the store as it was."""
        self._check(None)
        t = Transaction(self)
        yield t
        if t.parts:
            self._commit(t.parts)

    def _commit(self, parts: list[DataFrame]) -> None:
        name = f"changes/{uuid.uuid4().hex}"
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        both.write.parquet(f"{self.path}/{name}")
        version = self.version + 1
        manifest = self.manifest | {"version": version, "changes": [*self.manifest["changes"], name]}
        self._commit_manifest(manifest, name)
        if len(self.manifest["changes"]) >= self.compact_every:
            self.compact()

    def _commit_manifest(self, manifest: dict, name: str) -> None:
        version = manifest["version"]
        try:
            self.files.create(f"versions/{version}.json", json.dumps(manifest))
        except FileExistsError:
            self.files.delete(name)
            raise RuntimeError("another writer committed first; refresh and try again") from None
        self.refresh()

    def _snapshot_commit(self, objects: DataFrame, edges: DataFrame, version: int, signatures: dict | None = None) -> None:
        name = f"snapshots/{uuid.uuid4().hex}"
        objects.write.parquet(f"{self.path}/{name}/objects")
        edges.repartition("src").sortWithinPartitions("src", "ord").write.parquet(f"{self.path}/{name}/edges")
        self.files.create(f"versions/{version}.json", json.dumps({"format": FORMAT, "version": version, "snapshot": name, "changes": [], "parallel": self.parallel} | ({"signatures": signatures} if signatures else {})))

    def compact(self) -> int:
        """Folds the changes into a snapshot under a new version. Files of older versions stay until ``vacuum``."""
        self._check(None)
        known = self.manifest.get("signatures")
        if known:  # changes that they don't cover yet go on counting as such
            known = known | {"stale": [*known["stale"], *self.manifest["changes"][known["changes"] :]], "changes": 0}
        self._snapshot_commit(self.objects, self.edges, self.version + 1, known)
        return self.refresh()

    def signatures(self) -> DataFrame:
        """``id, topo_signature, n_nodes`` as last indexed; empty before that."""
        known = self.manifest.get("signatures")
        return self._read(known["name"], SIGNATURES) if known else self._frame([], SIGNATURES)

    def reindex(self, hops: int = 2) -> int:
        """Brings the signatures up to date and commits them; returns how many were computed.

        After changes only ego nets are computed anew that hold a changed object or a neighbour
        that it had or has; objects without neighbours have none.
        """
        from trailweave.operators import topology

        self._check(None)
        known = self.manifest.get("signatures")
        objects, edges, old = self.objects, self.edges, self.signatures()
        if known and known["hops"] == hops:
            names = [*known["stale"], *self.manifest["changes"][known["changes"] :]]
            if not names:
                return 0
            changed = self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/{n}" for n in names])
            before = self._read(known["edges"], EDGES)
            ids = changed.select("id").distinct()
            both = before.unionByName(edges)
            near = ids.unionByName(both.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))).unionByName(both.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")))
            stale = topology.affected(near.distinct(), both, hops)
            fresh = topology.signatures(objects.join(stale, "id", "left_semi"), edges, hops)
            kept = old.join(stale, "id", "left_anti").join(objects.select("id"), "id", "left_semi")
        else:
            fresh, kept = topology.signatures(objects, edges, hops), old.where("false")
        name = f"signatures/{uuid.uuid4().hex}"
        fresh = fresh.select("id", "topo_signature", "n_nodes")
        fresh.write.parquet(f"{self.path}/{name}/new")
        fresh = self._read(f"{name}/new", SIGNATURES)
        kept.unionByName(fresh).write.parquet(f"{self.path}/{name}/all")
        edges.write.parquet(f"{self.path}/{name}/edges")
        entry = {"name": f"{name}/all", "edges": f"{name}/edges", "hops": hops, "changes": len(self.manifest["changes"]), "stale": []}
        self._commit_manifest(self.manifest | {"version": self.version + 1, "signatures": entry}, name)
        return fresh.count()

    def vacuum(self) -> None:
        """Deletes what the current version doesn't use."""
        self._check(None)
        known = self.manifest.get("signatures") or {"name": "", "stale": []}
        used = {self.manifest["snapshot"], *self.manifest["changes"], *known["stale"], known["name"].removesuffix("/all")}
        for top in ("snapshots", "changes", "signatures"):
            for n in self.files.names(top):
                if f"{top}/{n}" not in used:
                    self.files.delete(f"{top}/{n}")
        for n in self.files.names("versions"):
            if n != f"{self.version}.json":
                self.files.delete(f"versions/{n}")

    def backup(self, path: str) -> GraphStore:
        """A store of its own with this version's tables."""
        target = Files(self.spark, path)
        if target.exists("versions"):
            raise FileExistsError(path)
        copy = object.__new__(GraphStore)
        copy.spark, copy.path, copy.files, copy.read_only, copy.compact_every, copy.parallel = self.spark, path.rstrip("/"), target, False, self.compact_every, self.parallel
        copy._snapshot_commit(self.objects, self.edges, self.version)
        copy.refresh()
        return copy

    @staticmethod
    def restore(spark: SparkSession, backup: str, into: str) -> GraphStore:
        return GraphStore(spark, backup, read_only=True).backup(into)


class Transaction:
    """Changes of one commit, in the order of the calls."""

    def __init__(self, store: GraphStore):
        self.store, self.parts = store, []

    def _add(self, rows: DataFrame) -> None:
        seq = (self.store.version + 1) * (1 << 20) + len(self.parts)
        self.parts.append(rows.select(F.lit(seq).cast("bigint").alias("seq"), "op", "id", "content", "vector", "meta", "edges"))

    def put(self, objects: DataFrame, edges: DataFrame | None = None) -> None:
        full = full_objects(objects)
        edges = full_edges(edges) if edges is not None else self.store._frame([], EDGES)
        self.store._check(edges)
        one = full.groupBy("id").agg(F.last(F.struct("content", "vector", "meta")).alias("o")).select("id", "o.*").where("id is not null")
        e = F.struct("relation", "dst", "weight", "meta", "ord")
        own = edges.groupBy(F.col("src").alias("id")).agg(F.collect_list(e).alias("edges"))
        self._add(one.join(own, "id", "left").withColumn("op", F.lit("put")))

    def delete(self, ids: DataFrame) -> None:
        none = {c: F.lit(None).cast(k) for c, k in (("content", "string"), ("vector", "array<double>"), ("meta", "string"))}
        edges = F.lit(None).cast("array<struct<relation:string,dst:string,weight:double,meta:string,ord:bigint>>")
        self._add(ids.select("id").distinct().withColumns({"op": F.lit("delete"), **none, "edges": edges}))


def full_objects(df: DataFrame) -> DataFrame:
    """The columns of an object table; missing ones are null."""
    kinds = {"id": "string", "content": "string", "vector": "array<double>", "meta": "string"}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def full_edges(df: DataFrame) -> DataFrame:
    """The columns of an edge table; weight 1 and an order by target and relation where they are missing."""
    own = {"weight": F.lit(1.0), "meta": F.lit(None).cast("string"), "ord": F.pmod(F.xxhash64("dst", "relation"), F.lit(1 << 40))}
    return df.select("src", "relation", "dst", *[(F.coalesce(F.col(c), v) if c in df.columns and c != "meta" else F.col(c) if c in df.columns else v).alias(c) for c, v in own.items()])


def open_store(spark: SparkSession, kind: str, path: str | None = None, **options) -> GraphStore:
    """A store by kind: "durable" (one edge of a key) or "multi" (parallel edges) in ``path``, or "memory", which goes with the application."""
    if kind == "memory":
        path = f"{shared_dir(spark)}/trailweave/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"
    elif kind not in ("durable", "multi"):
        raise ValueError("kind is memory, durable or multi")
    if path is None:
        raise ValueError(f"a {kind} store needs a path")
    return GraphStore(spark, path, parallel=kind == "multi", **options)


def replayed(objects: DataFrame, edges: DataFrame, changes: DataFrame, parallel: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tables after a batch of changes, of which the last for each id counts.

    A delete also takes the edges into the object, those that the snapshot or earlier changes
    have; an edge of a later change into it stays, as dangling or into the object put again.
    """
    last = changes.groupBy("id").agg(F.max_by(F.struct("op", "content", "vector", "meta", "edges"), "seq").alias("c"), F.max("seq").alias("seq"))
    touched = last.select("id")
    put = last.where("c.op = 'put'").select("id", "seq", "c.*")
    gone = changes.where("op = 'delete'").groupBy(F.col("id").alias("dst")).agg(F.max("seq").alias("gone"))
    kept = objects.join(touched, "id", "left_anti").unionByName(put.select("id", "content", "vector", "meta"))
    old = edges.join(touched.select(F.col("id").alias("src")), "src", "left_anti").select("*", F.lit(-1).cast("bigint").alias("seq"))
    new = put.where("edges is not null").select(F.col("id").alias("src"), "seq", F.inline("edges")).select("src", "relation", "dst", "weight", "meta", "ord", "seq")
    last_edge = new if parallel else new.groupBy("src", "relation", "dst").agg(F.max_by(F.struct("weight", "meta"), F.struct("seq", "ord")).alias("v"), F.min("ord").alias("ord"), F.max("seq").alias("seq")).select("src", "relation", "dst", "v.weight", "v.meta", "ord", "seq")
    every = old.unionByName(last_edge).join(gone, "dst", "left").where("gone is null or seq > gone")
    return kept, every.select("src", "relation", "dst", "weight", "meta", "ord")
