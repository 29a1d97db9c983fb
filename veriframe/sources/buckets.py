"""A store of chunks and all sinks derived from them, in buckets of documents, with versions that one writer can name."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.operators import chunking, concepts, svo
from veriframe.operators.joins import broadcast_if_small

BUCKETS = 64
#: Times that an upsert begins again because another writer was faster.
ATTEMPTS = 5


class Conflict(RuntimeError):
    """Another writer has named the version."""


def _edges(chunks: DataFrame) -> DataFrame:
    return svo.extract_relations(chunks).join(chunks.select("chunk_id", "document_id"), "chunk_id")


#: Each sink from chunks with their concepts; every row keeps its document.
SINKS = {
    "chunks": lambda chunks: chunks,
    "index": lambda chunks: chunking.token_index(chunks).join(chunks.select("chunk_id", "document_id"), "chunk_id"),
    "vectors": chunking.embed_chunks,
    "concept_edges": lambda chunks: concepts.chunk_concepts(chunks).join(chunks.select("chunk_id", "document_id"), "chunk_id"),
    "relations": _edges,
}


class BucketedStore:
    """Tables SINKS under ``path``, each in ``buckets`` folders by a hash of the document.

    ``data/<part>/<table>/bucket=<n>`` are immutable. A version is one small file ``versions/<number>`` that names the live parts of each bucket, for all
    tables alike, so that a document's rows change everywhere at once. The file is created only if it isn't there: of two writers that saw the same
    version one gets a Conflict, and begins again. Replacing a document rewrites its bucket and no other.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        before = self.manifest()
        self.buckets = before["buckets"] if before["version"] else buckets

    def _file(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._file("versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> dict:
        """{version, buckets, parts}: of each bucket the parts that it consists of; the last version by default."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": 0, "parts": {}}
        fs, at = self._file(f"versions/{known[-1] if version is None else version:08d}")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, seen: dict, parts: dict[str, list[str]]) -> int:
        """Name the version after ``seen``; a Conflict if another writer has."""
        version = seen["version"] + 1
        fs, at = self._file(f"versions/{version:08d}")
        try:
            stream = fs.create(at, False)
        except Py4JJavaError as e:
            if fs.exists(at):
                raise Conflict(f"version {version} of {self.path} is taken") from e
            raise
        try:
            stream.write(bytearray(json.dumps({"version": version, "buckets": self.buckets, "parts": parts}).encode()))
        finally:
            stream.close()
        return version

    def bucket(self, document_id: str | Column = "document_id") -> Column:
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")

    def read(self, table: str = "chunks", buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """A table of the last version, or of an older one; with ``buckets``, only these folders are opened."""
        parts = self.manifest(version)["parts"]
        wanted = [(b, p) for b, ps in parts.items() for p in ps if buckets is None or int(b) in buckets]
        if not wanted:
            if not parts:
                raise ValueError(f"{self.path} holds nothing yet")
            b, p = next((b, ps[0]) for b, ps in parts.items())
            return self.spark.read.parquet(self._folder(p, table, b)).limit(0)
        return self.spark.read.parquet(*(self._folder(p, table, b) for b, p in wanted))

    def _folder(self, part: str, table: str, bucket: int | str) -> str:
        """A bucket without a row of a table has an empty file there."""
        return f"{self.path}/data/{part}/{table}/bucket={bucket}"

    def chunks(self) -> DataFrame:
        return self.read("chunks")

    def get_chunks(self, ids: DataFrame) -> DataFrame:
        """The chunks of some ids (chunk_id), from the buckets of their documents alone."""
        asked = ids.select("chunk_id").distinct()
        document = F.regexp_replace("chunk_id", r"-\d+$", "")
        wanted = [r[0] for r in asked.select(self.bucket(document)).distinct().collect()]  # at most one a bucket
        return self.read("chunks", wanted).join(broadcast_if_small(asked), "chunk_id")

    def upsert(self, chunks: DataFrame) -> list[int]:
        """Insert or replace whole documents by their chunks (document_id, chunk_id, text, provides, depends_on, ...). The buckets written.

        Buckets of which no document is replaced get one more part; the others are written again, without the replaced documents' rows.
        """
        last = chunks.groupBy("chunk_id").agg(F.max_by(F.struct(*chunks.columns), "text").alias("row")).select("row.*")
        ids = last.select("document_id").distinct()
        for attempt in range(ATTEMPTS):
            seen = self.manifest()
            try:
                return self._upserted(seen, last, ids)
            except Conflict:
                if attempt + 1 == ATTEMPTS:
                    raise
        return []

    def _upserted(self, seen: dict, new: DataFrame, ids: DataFrame) -> list[int]:
        touched = sorted(r[0] for r in ids.select(self.bucket()).distinct().collect())  # at most one a bucket
        parts = {b: list(p) for b, p in seen["parts"].items()}
        old = [b for b in touched if str(b) in parts]
        again = []
        if old:
            few = broadcast_if_small(ids)
            before = self.read("chunks", old)
            again = sorted(r[0] for r in before.join(few, "document_id", "left_semi").select(self.bucket()).distinct().collect())
            if again:
                kept = self.read("chunks", again).join(few, "document_id", "left_anti")
                new = new.unionByName(kept, allowMissingColumns=True)
        part = self._write(new, touched)
        for b in touched:
            parts[str(b)] = [part] if b in again else [*parts.get(str(b), []), part]
        self.commit(seen, parts)
        return touched

    def _write(self, chunks: DataFrame, buckets: list[int]) -> str:
        """All sinks of ``chunks`` as a new part; a large bucket is written by several tasks."""
        part = f"{uuid.uuid4().hex[:12]}"
        chunks.withColumn("bucket", self.bucket()).repartitionByRange("bucket", "chunk_id").write.partitionBy("bucket").parquet(f"{self.path}/data/{part}/chunks")
        stored = self.spark.read.schema(chunks.schema).parquet(*(self._folder(part, "chunks", b) for b in buckets if self._exists(part, "chunks", b)))
        for table, sink in SINKS.items():
            if table != "chunks":
                rows = sink(stored)
                rows.withColumn("bucket", self.bucket()).repartitionByRange("bucket", "document_id").write.partitionBy("bucket").parquet(f"{self.path}/data/{part}/{table}")
                for b in buckets:
                    if not self._exists(part, table, b):
                        rows.limit(0).coalesce(1).write.parquet(self._folder(part, table, b))
        return part

    def _exists(self, part: str, table: str, bucket: int) -> bool:
        fs, at = self._file(f"data/{part}/{table}/bucket={bucket}")
        return fs.exists(at)

    def compact(self, most_parts: int = 4) -> list[int]:
        """Write buckets of more than ``most_parts`` parts as one part. The buckets written."""
        seen = self.manifest()
        many = sorted(int(b) for b, p in seen["parts"].items() if len(p) > most_parts)
        if many:
            part = self._write(self.read("chunks", many), many)
            self.commit(seen, seen["parts"] | {str(b): [part] for b in many})
        return many

    def expire(self, keep: int = 2) -> int:
        """Delete all versions but the last ``keep``, and parts that none of these names. How many parts went.

        Parts of a writer that hasn't named its version yet would go, too: expire when nobody writes.
        """
        known = self.versions()
        live = {p for v in known[-keep:] for ps in self.manifest(v)["parts"].values() for p in ps}
        for v in known[:-keep]:
            fs, at = self._file(f"versions/{v:08d}")
            fs.delete(at, False)
        fs, at = self._file("data")
        dead = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in live] if fs.exists(at) else []
        for p in dead:
            fs.delete(p, True)
        return len(dead)
