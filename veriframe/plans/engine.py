"""The engine's public entry points, over a folder of stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.operators import concepts, export, routing, verdict
from veriframe.operators.fuzzy import expanded
from veriframe.operators.text_index import TextIndex
from veriframe.plans import verify
from veriframe.sources.health import LOCAL, check
from veriframe.sources.settings import Settings
from veriframe.sources.stores import ChunkStore, append_json_lines, ingest


class VerificationEngine:
    """Verify, adjudicate and export claims against the documents ingested under ``path``.

    Claims are rows (assertion_id, subject, relation, object[, polarity, rule_type]), queries rows (query_id, query). ``judge`` may
    replace the heuristic judge: a function from gated verdicts to verdicts with the judge's columns.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, rules: tuple[concepts.Rule, ...] = concepts.RULES, judge: Callable[[DataFrame], DataFrame] = verdict.judge):
        self.spark, self.path, self.settings, self.rules, self.judge_with = spark, path.rstrip("/"), settings or Settings(), rules, judge
        self.store = ChunkStore(spark, f"{self.path}/chunks")

    @classmethod
    def from_settings(cls, spark: SparkSession, settings: Settings) -> "VerificationEngine":
        return cls(spark, settings.store_path, settings)

    def ingest(self, documents: DataFrame, id_col: str = "document_id", text_col: str = "raw_text") -> DataFrame:
        """(document_id, status, chunks, svos)."""
        return ingest(documents, self.path, self.rules, id_col, text_col)

    def corpus(self, documents: DataFrame | None = None) -> verify.Corpus:
        """The stored chunks with their index; with ``documents`` (column document_id) only theirs, without it."""
        chunks = self.store.chunks()
        if documents is not None:
            chunks = chunks.join(documents.select("document_id").distinct(), "document_id", "left_semi")
            return verify.Corpus(chunks, self.rules)
        index = TextIndex(self.spark, f"{self.path}/search")
        return verify.Corpus(chunks, self.rules, index if index.exists() else None)

    def search(self, queries: DataFrame, top_k: int = 10, score: str = "bm25", fuzzy: bool = False) -> DataFrame:
        """(query_id, chunk_id, score, rank) from the stored index; ``fuzzy`` also finds terms within one or two edits."""
        return TextIndex(self.spark, f"{self.path}/search").search(queries, top_k, score, expanded if fuzzy else None)

    def route(self, queries: DataFrame) -> DataFrame:
        return routing.route(queries)

    def verify(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return verify.verify(queries, self.corpus(), top_k)

    def verify_with_ontology(self, queries: DataFrame, top_k: int = 10, assertions: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        return verify.verify_with_ontology(queries, self.corpus(), assertions, top_k)

    def adjudicate(self, claims: DataFrame, top_k: int = 5, documents: DataFrame | None = None) -> DataFrame:
        return verdict.final_columns(verify.adjudicate(claims, self.corpus(documents), top_k, self.judge_with))

    def validate_batch(self, documents: DataFrame, claims: DataFrame, top_k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Ingest, then adjudicate all claims: (ingestion counts, verdicts, summary)."""
        counts = self.ingest(documents)
        verdicts = self.adjudicate(claims, top_k)
        return counts, verdicts, verdict.summary(verdicts)

    def export_examples(self, claims: DataFrame, target: str, document_id: str = "unknown_document", top_k: int = 5) -> DataFrame:
        """Append training examples as JSON lines; documents are ingested once, before, not once per claim."""
        examples = export.training_examples(self.adjudicate(claims, top_k), document_id)
        append_json_lines(examples, target)
        return examples

    def backend_status(self) -> dict:
        return {"mode": self.settings.backend_mode, "store": self.path, **{n: getattr(self.settings, n).enabled for n in ("elasticsearch", "milvus", "neo4j")}}

    def health(self, pings: dict[str, Callable[[], object] | None] | None = None):
        """A report; outside backends are probed by the functions given, a missing or None one counts as disabled."""
        every = {"elasticsearch": None, "milvus": None, "neo4j": None} | (pings or {})
        return check({LOCAL: lambda: self.spark.range(1).select(F.lit(1)).collect(), **every})
