"""Engines by settings: which components they use, what stands in for those that can't be had, and a pool of them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from veriframe.operators import concepts, models, svo, verdict
from veriframe.operators.models import Loader
from veriframe.plans.engine import VerificationEngine
from veriframe.sources.settings import Settings

#: What an engine of the pool can be asked for.
EMBEDDING_MODELS = ("simple", "transformer")
SVO_EXTRACTORS = ("mock", "transformer")
BACKENDS = ("elasticsearch", "milvus", "neo4j")


class NoEngine(RuntimeError):
    """No engine of the pool can serve a request."""


def _works(loader: Loader | None) -> bool:
    """Whether a model can be loaded here; a fault counts as no, and is logged."""
    try:
        return loader is not None and loader() is not None
    except Exception as e:
        logging.getLogger(__name__).warning("a model can't be loaded, its heuristic stands in: %s", e)
        return False


def judge_of(settings: Settings, loaders: Mapping[str, Loader]) -> Callable[[DataFrame], DataFrame]:
    """The judge: "few_shot_judge" or "nli_judge" of ``loaders`` if settings enable one and it loads, else the heuristic."""
    if settings.enable_lm_judge:
        for name, build in (("few_shot_judge", models.few_shot_judge), ("nli_judge", models.nli_judge)):
            if _works(loaders.get(name)):
                return partial(build, loader=loaders[name])
    return verdict.judge


def concepts_of(chunks: DataFrame, settings: Settings, loaders: Mapping[str, Loader], rules: tuple[concepts.Rule, ...] = concepts.RULES) -> DataFrame:
    """``chunks`` with provides and depends_on by the extractor that settings name; missing arrays are empty, rules stand in for a model that fails."""
    if settings.concept_extractor_name == "transformer" and _works(loaders.get("concepts")):
        return models.generated_concepts(chunks, loaders["concepts"])
    if settings.concept_extractor_name == "json" and _works(loaders.get("concepts")):
        return models.concepts_from_json(chunks, loaders["concepts"], partial(concepts.extract_concepts, rules=rules))
    return concepts.extract_concepts(chunks, rules)


def relations_of(chunks: DataFrame, settings: Settings, loaders: Mapping[str, Loader]) -> DataFrame:
    """Relations of chunks by the extractor that settings name; rules stand in for a model that fails."""
    if settings.svo_extractor_name == "transformer" and _works(loaders.get("relations")):
        return svo.parse_relations(models.generated_relations(chunks, loaders["relations"]))
    return svo.extract_relations(chunks)


def create_engine(spark: SparkSession, settings: Settings, loaders: Mapping[str, Loader] | None = None, pings: Mapping[str, Callable[[], object]] | None = None) -> VerificationEngine:
    """An engine with the components that settings name. Where production backends are required, one has to be enabled, and each enabled
    one that ``pings`` can probe has to answer; else the engine's own tables serve."""
    if settings.require_production_backends:
        enabled = [b for b in BACKENDS if getattr(settings, b).enabled]
        if not enabled:
            raise RuntimeError("production backends are required, but none is enabled")
        for name in enabled:
            if pings and name in pings:
                try:
                    pings[name]()
                except Exception as e:
                    raise RuntimeError(f"the required backend {name} does not answer: {e}") from e
    return VerificationEngine(spark, settings.store_path, settings, judge=judge_of(settings, loaders or {}))


class EnginePool:
    """An engine for every pair of embedding model and relation extractor; pairs that can't be built are left out."""

    def __init__(self, spark: SparkSession, settings: Settings, build: Callable[[SparkSession, Settings], VerificationEngine] = create_engine):
        self.default = settings.embedding_model_name, settings.svo_extractor_name
        self.engines: dict[tuple[str, str], VerificationEngine] = {}
        for embedding in EMBEDDING_MODELS:
            for extractor in SVO_EXTRACTORS:
                try:
                    self.engines[embedding, extractor] = build(spark, replace(settings, embedding_model_name=embedding, svo_extractor_name=extractor))
                except Exception:
                    logging.getLogger(__name__).exception("no engine for %s and %s", embedding, extractor)

    def resolve(self, embedding: str | None = None, extractor: str | None = None) -> VerificationEngine:
        """The engine asked for; what isn't asked for is the default, and the default engine stands in for one that isn't there."""
        found = self.engines.get((embedding or self.default[0], extractor or self.default[1])) or self.engines.get(self.default)
        if found is None:
            raise NoEngine("the pool holds no engine")
        return found

    def diagnostics(self) -> list[dict]:
        """What each engine of the pool is made of, and what its store holds."""
        return [{"embedding": e, "extractor": x, "default": (e, x) == self.default, "judge": getattr(engine.judge_with, "__name__", "model"), **engine.backend_status()} for (e, x), engine in self.engines.items()]

    def clear(self) -> None:
        self.engines.clear()
