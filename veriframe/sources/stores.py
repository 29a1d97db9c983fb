"""Stores and sinks: chunks, inverted index, vectors, graph, training examples. All are folders of Parquet or JSON lines."""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.operators import chunking, concepts, svo, verdict
from veriframe.functions.stemming import english_tokens
from veriframe.operators.joins import broadcast_if_small
from veriframe.operators.text_index import TextIndex

#: Segments of the search index of at most SMALL_SEGMENT chunks are merged when there are MANY_SEGMENTS.
SMALL_SEGMENT, MANY_SEGMENTS = 10_000, 8

METADATA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("provides", T.ArrayType(T.StringType())),
        T.StructField("depends_on", T.ArrayType(T.StringType())),
        T.StructField("graph_summary", T.StringType()),
    ]
)


def parse_metadata(column: str = "metadata") -> Column:
    """Chunk metadata from JSON text; malformed text and missing fields give empty values."""
    empty = F.array().cast("array<string>")
    m = F.from_json(column, METADATA, {"mode": "PERMISSIVE"})
    hint = m["graph_summary"]  # a string, or the JSON text of an array of strings
    lines = F.when(F.substring(F.ltrim(hint), 1, 1) == "[", F.from_json(hint, "array<string>")).otherwise(F.array(hint))
    return F.struct(m["source"].alias("source"), m["word_count"].alias("word_count"), F.coalesce(m["provides"], empty).alias("provides"), F.coalesce(m["depends_on"], empty).alias("depends_on"), verdict.graph_lines(lines, "array").alias("graph_summary"))


class ChunkStore:
    """Chunks in Parquet folders under one path, and a list of versions, each naming the folders it consists of.

    Chunks that are all new are appended as one more folder; only if some are replaced is a version written whole. A
    version is named when its write has completed, so readers see whole versions. Folders of older versions stay, so running
    readers aren't disturbed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folders(self) -> list[str]:
        """The folders of the last version; none if nothing has been stored."""
        try:
            names = self.spark.read.schema("version int, folders array<string>").json(f"{self.path}/versions")
        except AnalysisException:
            return []
        last = names.agg(F.max_by("folders", "version").alias("folders")).first()
        return last["folders"] or []

    def chunks(self) -> DataFrame:
        """All chunks; only the columns that a query uses are read."""
        folders = self.folders()
        if not folders:
            raise ValueError(f"{self.path} holds no chunks yet")
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders))

    def chunk_ids(self) -> DataFrame:
        return self.chunks().select("chunk_id")

    def get_chunks(self, ids: DataFrame) -> DataFrame:
        """The chunks of some ids (column chunk_id); ids that aren't there give no row, and few ids shuffle nothing."""
        return self.chunks().join(broadcast_if_small(ids.select("chunk_id").distinct()), "chunk_id")

    def upsert(self, rows: DataFrame) -> tuple[DataFrame, bool]:
        """Insert or replace whole documents, so that none keeps chunks it no longer has; of several new rows with one chunk_id one stays.

        Returns the new chunks if they were only appended, else all chunks; and whether they were only appended.
        """
        last = rows.groupBy("chunk_id").agg(F.max_by(F.struct(*rows.columns), "text").alias("row"))
        new = last.select("row.*")
        before = self.folders()
        folder = f"part-{len(before):06d}-{uuid.uuid4().hex[:8]}"
        new.write.parquet(f"{self.path}/{folder}")
        new = self.spark.read.schema(new.schema).parquet(f"{self.path}/{folder}")
        ids = new.select("document_id").distinct()
        appended = not before or self.chunks().select("document_id").join(broadcast_if_small(ids), "document_id", "left_semi").isEmpty()
        if appended:
            self._name([*before, folder])
            return new, True
        whole = f"{folder}-whole"
        old = self.chunks().join(broadcast_if_small(ids), "document_id", "left_anti")
        old.unionByName(new, allowMissingColumns=True).write.parquet(f"{self.path}/{whole}")
        self._name([whole])
        return self.chunks(), False

    def _name(self, folders: list[str]) -> None:
        """Make these folders the next version: one row in the list of versions."""
        try:
            count = self.spark.read.text(f"{self.path}/versions").count()
        except AnalysisException:
            count = 0
        self.spark.createDataFrame([(count + 1, folders)], "version int, folders array<string>").coalesce(1).write.mode("append").json(f"{self.path}/versions")


def ingest(documents: DataFrame, path: str, rules: tuple[concepts.Rule, ...] = concepts.RULES, id_col: str = "document_id", text_col: str = "raw_text") -> DataFrame:
    """Chunk documents, derive all that retrieval needs, and write every sink under ``path``. Returns counts per document.

    Sinks: chunks (by upsert), index (token postings), search (the index that searches read), vectors, concept_edges, entity_edges, mentions. New documents cost what
    they hold; documents ingested again have all sinks written anew.
    """
    spark = documents.sparkSession
    store = ChunkStore(spark, f"{path}/chunks")
    fresh = concepts.extract_concepts(chunking.chunk_documents(documents, id_col, text_col), rules)
    chunks, appended = store.upsert(fresh.withColumn("source", F.lit("document")))
    write_sinks(chunks, path, appended)
    found = svo.extract_relations(chunks).groupBy("chunk_id").agg(F.count("*").alias("n"))
    ids = documents.select(F.col(id_col).cast("string").alias("document_id")).distinct()
    own = chunks.join(ids, "document_id", "left_semi").join(found, "chunk_id", "left")
    return own.groupBy("document_id").agg(F.lit("success").alias("status"), F.count("*").alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("svos"))


def write_sinks(chunks: DataFrame, path: str, append: bool = False) -> None:
    """The sinks of ``chunks``, added to what is there or in its place; entity edges that are there aren't added again."""
    spark, relations = chunks.sparkSession, svo.extract_relations(chunks)
    edges = svo.entity_edges(relations)
    if append:
        try:
            edges = edges.join(spark.read.schema(edges.schema).parquet(f"{path}/entity_edges"), edges.columns, "left_anti")
        except AnalysisException:  # the first documents
            pass
    sinks = {
        "index": chunking.token_index(chunks),
        "vectors": chunking.embed_chunks(chunks),
        "concept_edges": concepts.chunk_concepts(chunks),
        "entity_edges": edges,
        "mentions": svo.mentions(relations),
    }
    for name, df in sinks.items():
        df.write.mode("append" if append else "overwrite").parquet(f"{path}/{name}")
    index = TextIndex(spark, f"{path}/search")
    (index if append else index.clear()).add(chunks).merge(SMALL_SEGMENT, MANY_SEGMENTS)


#: The mapping of an index of chunks.
INDEX_MAPPING = {"mappings": {"properties": {"document_id": {"type": "keyword"}, "text": {"type": "text", "analyzer": "english"}, "metadata": {"type": "object", "dynamic": True}}}}


def create_index(spark: SparkSession, path: str, shards: int = 1, replicas: int = 0) -> bool:
    """Write the settings of a chunk index under ``path`` unless there are some; whether they were written."""
    try:
        spark.read.text(f"{path}/settings").take(1)
        return False
    except AnalysisException:
        body = json.dumps({"settings": {"number_of_shards": shards, "number_of_replicas": replicas}} | INDEX_MAPPING)
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{path}/settings")
        return True


def bulk_index(chunks: DataFrame, path: str) -> dict[str, int]:
    """Index actions of chunks as JSON lines, and the English postings beside them: {success, failed}. A fault fails all, and isn't raised."""
    count = chunks.count()
    try:
        create_index(chunks.sparkSession, path)
        source = F.struct("document_id", "text", F.struct("word_count").alias("metadata"))
        chunks.select(F.lit("svo_chunks").alias("_index"), F.col("chunk_id").alias("_id"), source.alias("_source")).write.mode("append").json(f"{path}/actions")
        chunking.tokenised(chunks, english_tokens).write.mode("append").parquet(f"{path}/terms")
    except Exception as e:
        logging.getLogger(__name__).error("bulk indexing failed: %s", e)
        return {"success": 0, "failed": count}
    return {"success": count, "failed": 0}


class Recorder:
    """A stand-in for an outside store: remembers what it is given."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def write(self, df: DataFrame, most: int = 10_000) -> int:
        """Keep up to ``most`` rows, for tests; the number of rows kept."""
        taken = [r.asDict(recursive=True) for r in df.limit(most).collect()]
        self.rows += taken
        return len(taken)


def graph_schema(edges: DataFrame, mentions: DataFrame) -> dict[str, bool]:
    """Whether the graph's tables keep its constraints: every edge and every mention once, no missing end."""

    def kept(df: DataFrame) -> bool:
        whole = F.count_if(F.concat(*(F.col(c).cast("string") for c in df.columns)).isNull()) == 0
        return df.agg(((F.count("*") == F.count_distinct(F.struct(*df.columns))) & whole).alias("ok")).first()["ok"]

    return {"edges": kept(edges), "mentions": kept(mentions)}


def append_json_lines(rows: DataFrame, path: str) -> None:
    """Append rows as JSON, one object a line."""
    rows.write.mode("append").json(path)
