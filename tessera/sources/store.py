"""A stored graph: versioned Parquet tables with a manifest a version.

A version is a list of table folders.  Inserts add folders, deletes add folders of tombstones that hold
for all folders before them, and ``compact`` rewrites everything into one.  Readers use the newest manifest,
which is written last; a writer that fails leaves no trace in it.  Quads are clustered by predicate and object,
dictionaries by hash, so that row groups prune.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig
from ..functions.terms import hash_column, hash_term
from ..operators import fts, vectors
from ..plans.graph import StoredGraph
from ..plans.materialize import materialized
from . import ntriples

QUADS = T.StructType([T.StructField(c, T.LongType()) for c in "spog"])
TERMS = T.StructType([T.StructField("hash", T.LongType()), T.StructField("value", T.StringType())])
TEXT_QUADS = T.StructType([T.StructField(c, T.StringType()) for c in "spog"])

#: A literal on more rows than the larger of OFTEN and one in MOST_OFTEN of them is made distinct before it is moved.
OFTEN, MOST_OFTEN = 1_000, 10_000


def encoded(quads: DataFrame) -> DataFrame:
    """Text quads as hashes."""
    return quads.select(*(hash_column(c).alias(c) for c in "spog"))


def dictionary(quads: DataFrame) -> DataFrame:
    """``hash, value`` of the distinct terms of text quads; the default graph's empty name is none."""
    terms = quads.select(F.explode(F.array("s", "p", "o", "g")).alias("value")).where("value <> ''")
    return terms.select(hash_column("value").alias("hash"), "value").groupBy("hash").agg(F.any_value("value").alias("value"))


def new_terms(quads: DataFrame, known: DataFrame) -> DataFrame:
    """The dictionary rows of text quads that ``known(hash)`` lacks."""
    return dictionary(quads).join(known.select("hash"), "hash", "left_anti")


class TripleStore:
    """A graph under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or EngineConfig()

    # manifests, through Hadoop's file system so that any scheme works

    def _fs(self):  # noqa: ANN202
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def version(self) -> int:
        """The newest version; 0 before the first build."""
        jvm, fs, root = self._fs()
        if not fs.exists(root):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "triples": [], "deleted": [], "iris": [], "literals": [], "fts": None, "vectors": None, "documents": None}
        jvm, fs, root = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(root, f"manifest-{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, m: dict) -> None:
        jvm, fs, root = self._fs()
        m = m | {"version": m["version"] + 1}
        part = jvm.org.apache.hadoop.fs.Path(root, f"_{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(root, f"manifest-{m['version']:012d}.json")):
            raise RuntimeError("another writer committed this version")

    def _write(self, df: DataFrame, kind: str, *cluster: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        if cluster:
            df = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster)
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _write_literals(self, objects: DataFrame, others: DataFrame) -> str:
        """The dictionary of the literals ``objects(o)`` and of the terms ``others(hash, value)``, each text moved once.

        Rows go to the ranges of their hashes as they are, and every range drops its repeats; only of literals on very
        many rows, which would fill a range, is one of each task kept before.
        """
        rows = objects.select(hash_column("o").alias("hash"), F.col("o").alias("value"))
        counted = materialized(rows.groupBy("hash").agg(F.count("*").alias("n")), "counted")
        least = max(OFTEN, (counted.agg(F.sum("n")).first()[0] or 0) // MOST_OFTEN)
        often = F.broadcast(counted.where(F.col("n") > least).select("hash"))  # at most MOST_OFTEN
        every = rows.join(often, "hash", "left_anti").union(rows.join(often, "hash", "left_semi").select("hash", "value").distinct()).union(others)
        name = f"literals/{uuid.uuid4().hex}"
        # equal hashes share a range: no further shuffle
        every.repartitionByRange("hash").groupBy("hash").agg(F.any_value("value").alias("value")).sortWithinPartitions("hash").write.parquet(f"{self.path}/{name}")
        return name

    def _drop(self, name: str) -> None:
        jvm, fs, root = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, name), True)

    def _read(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names))

    # reading

    def _quads(self, m: dict, kind: str = "triples") -> DataFrame:
        """The quads, clustered by predicate and object, or (``subjects``) by subject; small inserts are in both as they are."""
        names = m.get(kind) or m["triples"]
        if not m["deleted"]:
            return self._read(names, QUADS)
        parts = None
        for i, name in enumerate(names):
            df = self._read([name], QUADS)
            later = [d for at, d in m["deleted"] if at > i]
            if later:
                df = df.join(self._read(later, QUADS).distinct(), [*"spog"], "left_anti").select(*"spog")
            parts = df if parts is None else parts.union(df)
        return parts if parts is not None else self._read([], QUADS)

    def graph(self, version: int | None = None) -> StoredGraph:
        m = self._manifest(version)
        vecs = self.spark.read.parquet(f"{self.path}/{m['vectors']}") if m["vectors"] else None
        return StoredGraph(self._quads(m), self._read(m["iris"], TERMS), self._read(m["literals"], TERMS), vecs, str(m["version"]), self._quads(m, "subjects"))

    def index(self) -> fts.Index | None:
        """The full-text index; it shows the literals at the last ``reindex``."""
        m = self._manifest()
        return fts.Index.open(self.spark, self.config.fts, f"{self.path}/{m['fts']['name']}") if m["fts"] else None

    def stale(self) -> bool:
        """Whether literals were written since the last ``reindex``."""
        m = self._manifest()
        return not m["fts"] or m["fts"]["literals"] != m["literals"]

    # building

    def build(self, paths: list[str], graphs: bool | None = None) -> dict:
        """Build from N-Triples or TriG files."""
        if not paths:
            return {"duration": 0, "error": "no input"}
        return self.build_from(ntriples.read(self.spark, paths, graphs))

    def build_from(self, quads: DataFrame | list) -> dict:
        """Build from text quads, a DataFrame ``s, p, o, g`` or an iterable of tuples; a store is built once."""
        began = time.time()
        if self.version():
            return {"duration": 0, "error": "the store already has data"}
        if not isinstance(quads, DataFrame):
            quads = self.spark.createDataFrame([*quads], TEXT_QUADS)
        staged = f"staged/{uuid.uuid4().hex}"
        quads.write.option("compression", "zstd").parquet(f"{self.path}/{staged}")
        text = self._read([staged], TEXT_QUADS)
        m = self._manifest()
        # objects alone are mostly literals: literal texts are moved by themselves, once
        is_literal = F.col("o").startswith('"')
        terms = dictionary(text.withColumn("o", F.when(~is_literal, F.col("o"))))
        m["triples"] = [self._write(encoded(text), "triples", "p", "o", "s")]
        m["subjects"] = [self._write(self._read(m["triples"], QUADS), "subjects", "s")]
        m["iris"] = [self._write(terms.where(~F.col("value").startswith('"')), "iris", "hash")]
        m["literals"] = [self._write_literals(text.where(is_literal).select("o"), terms.where(F.col("value").startswith('"')))]
        self._commit(m)
        self._drop(staged)
        self.reindex()
        return {"duration": time.time() - began, "count": self.graph().quads().count()}

    def reindex(self) -> None:
        m = self._manifest()
        name = f"fts/{uuid.uuid4().hex}"
        fts.Index.build(self._read(m["literals"], TERMS).select(F.col("hash").alias("key"), "value"), self.config.fts, f"{self.path}/{name}")
        self._commit(m | {"fts": {"name": name, "literals": m["literals"]}})

    def build_documents(self) -> dict:
        """The document of each subject, for embedding."""
        began = time.time()
        name = self._write(vectors.subject_documents(self.graph()), "documents")
        self._commit(self._manifest() | {"documents": name})
        return {"duration": time.time() - began, "count": self.spark.read.parquet(f"{self.path}/{name}").count()}

    def build_vectors(self, embed: vectors.Embedder | None = None, batch: int = vectors.BATCH) -> dict:
        """Embed the subjects' documents, building those first if they are missing."""
        began = time.time()
        if not self._manifest()["documents"]:
            self.build_documents()
        m = self._manifest()
        docs = self.spark.read.parquet(f"{self.path}/{m['documents']}")
        name = self._write(vectors.build(docs, embed or vectors.hashing_embedder(), batch), "vectors")
        self._commit(m | {"vectors": name})
        return {"duration": time.time() - began, "count": self.spark.read.parquet(f"{self.path}/{name}").count()}

    # writing

    @staticmethod
    def _checked(row: dict) -> str | None:
        s, p, o = (row.get(k) for k in "spo")
        if not (s and p and o):
            return "s, p and o are needed"
        if not (s.startswith("<") and s.endswith(">") or s.startswith("_:")):
            return "the subject must be an IRI or a blank node"
        if not (p.startswith("<") and p.endswith(">")):
            return "the predicate must be an IRI"
        if not (o.startswith(('"', "_:")) or o.startswith("<") and o.endswith(">")):
            return "the object must be a literal, an IRI or a blank node"
        return None

    def insert(self, data: list[dict]) -> dict:
        """Add quads.  A bad row refuses the whole batch; rows that exist (without a graph: in any graph) are left out."""
        for row in data:
            if error := self._checked(row):
                return {"error": error}
        rows = [*dict.fromkeys((r["s"], r["p"], r["o"], r.get("g") or "") for r in data)]
        if not rows:
            return {"triples_inserted": 0}
        m = self._manifest()
        text = self.spark.createDataFrame(rows, TEXT_QUADS)
        keys = self.spark.createDataFrame([tuple(hash_term(x) for x in r) for r in rows], QUADS)
        have = self._quads(m).join(F.broadcast(keys.select(*"spo").distinct()), [*"spo"], "left_semi").select(*"spog").distinct().collect()  # rows of the batch only
        exact, anywhere = {tuple(r) for r in have}, {tuple(r)[:3] for r in have}
        fresh = [r for r in rows if (h := tuple(hash_term(x) for x in r)) not in exact and (r[3] or h[:3] not in anywhere)]
        if not fresh:
            return {"error": "the triples exist already"}
        text = self.spark.createDataFrame(fresh, TEXT_QUADS)
        out = {}
        added = self._write(encoded(text).coalesce(1), "triples")
        m["subjects"] = [*(m.get("subjects") or m["triples"]), added]
        m["triples"] = [*m["triples"], added]
        for kind, literal in (("iris", False), ("literals", True)):
            terms = dictionary(text).where(F.col("value").startswith('"') == literal)
            mine = [hash_term(x) for r in fresh for x in r if x and x.startswith('"') == literal]
            known = {r["hash"] for r in self._read(m[kind], TERMS).where(F.col("hash").isin(*mine)).select("hash").collect()} if mine else set()
            missing = {*mine} - known
            if missing:
                m[kind] = [*m[kind], self._write(terms.where(F.col("hash").isin(*missing)).coalesce(1), kind)]
                out[f"{kind}_inserted"] = len(missing)
        self._commit(m)
        return out | {"triples_inserted": len(fresh)}

    def delete(self, data: list[dict], are_hashes: bool = False) -> dict:
        """Remove quads: every row of exactly (s, p, o, g); without p or o, of any.  A request that finds nothing refuses the batch."""
        m = self._manifest()
        quads, asked = self._quads(m), []
        for i, row in enumerate(data):
            keys = []
            for c in "spog":
                term = row.get(c)
                if c == "g" and not term:
                    term = hash_term("") if are_hashes else ""
                if term is None and c == "s":
                    return {"error": "s is needed"}
                h = None if term is None else int(term) if are_hashes else hash_term(term)
                keys.append(h - (1 << 64) if h is not None and h >= 1 << 63 else h)
            asked.append((i, *keys))
        if not asked:
            return {"triples_deleted": 0, "rows_deleted": 0}
        # one job for the batch, which the caller holds in memory
        batch = self.spark.createDataFrame(asked, "_i long, _s long, _p long, _o long, _g long")
        fits = [F.col("s") == F.col("_s"), F.col("g") == F.col("_g"), *(F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}")) for c in "po")]
        hit = quads.join(F.broadcast(batch), fits[0] & fits[1] & fits[2] & fits[3])
        staged = self._write(hit.groupBy(*"spog").agg(F.count("*").alias("n"), F.collect_set("_i").alias("i")), "staged")
        found = self.spark.read.parquet(f"{self.path}/{staged}")
        removed = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if found.select(F.explode("i").alias("i")).distinct().count() < len(asked):
            self._drop(staged)
            return {"error": "the triple doesn't exist"}
        name = self._write(found.select(*"spog").coalesce(1), "deleted")
        self._drop(staged)
        m["deleted"] = [*m["deleted"], [len(m["triples"]), name]]
        self._commit(m)
        return {"triples_deleted": len(data), "rows_deleted": removed}

    def compact(self) -> None:
        """Rewrite all folders into one a table."""
        m = self._manifest()
        m["triples"] = [self._write(self._quads(m), "triples", "p", "o", "s")]
        m["deleted"] = []
        m["subjects"] = [self._write(self._read(m["triples"], QUADS), "subjects", "s")]
        current = bool(m["fts"]) and m["fts"]["literals"] == m["literals"]
        for kind in ("iris", "literals"):
            m[kind] = [self._write(self._read(m[kind], TERMS).dropDuplicates(["hash"]), kind, "hash")]
        if current:
            m["fts"] = m["fts"] | {"literals": m["literals"]}
        self._commit(m)
