"""Settings: defaults, JSON, environment."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

MODES = ("demo", "production", "auto")


@dataclass
class Backend:
    """An optional outside store; this engine keeps its own tables and only carries these settings."""

    enabled: bool = False
    host: str = "localhost"
    port: int = 0
    name: str = ""
    user: str = ""
    password: str = ""
    dimension: int = 0


@dataclass
class Settings:
    backend_mode: str = "demo"
    use_production_backends: bool = False
    require_production_backends: bool = False
    store_path: str = "svo_data.db"
    elasticsearch: Backend = field(default_factory=lambda: Backend(port=9200, name="svo_chunks"))
    milvus: Backend = field(default_factory=lambda: Backend(port=19530, name="svo_embeddings", dimension=384))
    neo4j: Backend = field(default_factory=lambda: Backend(host="bolt://localhost:7687", user="neo4j", password="password"))
    embedding_model_name: str = "simple"
    svo_extractor_name: str = "mock"
    concept_extractor_name: str = "mock"
    concept_extractor_model_name: str | None = None
    validator_name: str = "minimal"
    evidence_span_classifier_name: str = "heuristic"
    evidence_span_classifier_model_name: str | None = None
    enable_lm_judge: bool = False
    judge_model_name: str | None = None
    enable_lm_classifier: bool = False
    classifier_model_name: str | None = None
    verbose: bool = False
    log_backend_usage: bool = False

    def __post_init__(self) -> None:
        if self.backend_mode not in MODES:
            raise ValueError(f"backend_mode must be one of {MODES}")

    def to_json(self, redact: bool = False) -> str:
        """``redact`` hides passwords, for showing."""
        d = asdict(self)
        for v in d.values():
            if redact and isinstance(v, dict) and v.get("password"):
                v["password"] = "***"
        return json.dumps(d, indent=2)

    @classmethod
    def from_json(cls, text: str) -> "Settings":
        d = json.loads(text)
        stores = {f.name for f in fields(cls) if f.name in ("elasticsearch", "milvus", "neo4j")}
        return cls(**{k: Backend(**v) if k in stores else v for k, v in d.items()})

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_json())

    @classmethod
    def load(cls, path: str) -> "Settings":
        return cls.from_json(Path(path).read_text())

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> "Settings":
        """ENVIRONMENT says which variable sets what; the mode is ``auto`` unless set."""
        env = os.environ if env is None else env
        out = cls(backend_mode="auto")
        for variable, path in ENVIRONMENT.items():
            if variable in env:
                target, _, name = path.rpartition(".")
                owner = getattr(out, target) if target else out
                old, raw = getattr(owner, name), env[variable]
                setattr(owner, name, raw.lower() == "true" if isinstance(old, bool) else int(raw) if isinstance(old, int) else raw)
        out.backend_mode = out.backend_mode.lower()
        out.__post_init__()
        return out


#: Environment variables and the settings they set.
ENVIRONMENT = {
    "ONTO_BACKEND_MODE": "backend_mode",
    "ONTO_USE_PRODUCTION_BACKENDS": "use_production_backends",
    "ONTO_REQUIRE_PRODUCTION_BACKENDS": "require_production_backends",
    "ONTO_SQLITE_PATH": "store_path",
    "ONTO_ES_ENABLED": "elasticsearch.enabled",
    "ONTO_ES_HOST": "elasticsearch.host",
    "ONTO_ES_PORT": "elasticsearch.port",
    "ONTO_ES_INDEX": "elasticsearch.name",
    "ONTO_MILVUS_ENABLED": "milvus.enabled",
    "ONTO_MILVUS_HOST": "milvus.host",
    "ONTO_MILVUS_PORT": "milvus.port",
    "ONTO_MILVUS_COLLECTION": "milvus.name",
    "ONTO_MILVUS_DIM": "milvus.dimension",
    "ONTO_NEO4J_ENABLED": "neo4j.enabled",
    "ONTO_NEO4J_URI": "neo4j.host",
    "ONTO_NEO4J_USER": "neo4j.user",
    "ONTO_NEO4J_PASSWORD": "neo4j.password",
    "ONTO_EMBEDDING_MODEL": "embedding_model_name",
    "ONTO_SVO_EXTRACTOR": "svo_extractor_name",
    "ONTO_CONCEPT_EXTRACTOR": "concept_extractor_name",
    "ONTO_CONCEPT_EXTRACTOR_MODEL": "concept_extractor_model_name",
    "ONTO_VALIDATOR": "validator_name",
    "ONTO_EVIDENCE_SPAN_CLASSIFIER": "evidence_span_classifier_name",
    "ONTO_EVIDENCE_SPAN_CLASSIFIER_MODEL": "evidence_span_classifier_model_name",
    "ONTO_ENABLE_LM_JUDGE": "enable_lm_judge",
    "ONTO_JUDGE_MODEL": "judge_model_name",
    "ONTO_ENABLE_LM_CLASSIFIER": "enable_lm_classifier",
    "ONTO_CLASSIFIER_MODEL": "classifier_model_name",
    "ONTO_VERBOSE": "verbose",
    "ONTO_LOG_BACKEND_USAGE": "log_backend_usage",
}
