"""Health probes and reports of the stores, on the driver."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

LOCAL = "store"


@dataclass
class Status:
    name: str
    is_healthy: bool
    latency_ms: float = 0.0
    error: str | None = None
    enabled: bool = True
    timestamp: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())


def probe(name: str, ping: Callable[[], object] | None) -> Status:
    """Time one ping; None means that the backend isn't enabled."""
    if ping is None:
        return Status(name, False, error="Disabled in configuration", enabled=False)
    began = time.perf_counter()
    try:
        ping()
    except Exception as e:  # whatever a backend raises is its state
        return Status(name, False, (time.perf_counter() - began) * 1000, str(e))
    return Status(name, True, (time.perf_counter() - began) * 1000)


@dataclass
class Report:
    backends: dict[str, Status]

    @property
    def overall(self) -> str:
        """HEALTHY with the local store and any enabled backend, DEGRADED with the store alone, else FAILED."""
        if not self.backends[LOCAL].is_healthy:
            return "FAILED"
        return "HEALTHY" if any(s.is_healthy for n, s in self.backends.items() if n != LOCAL and s.enabled) else "DEGRADED"

    @property
    def recommendation(self) -> str:
        return {
            "HEALTHY": "All enabled backends are operational.",
            "DEGRADED": "No production backend is available; the local store is used.",
            "FAILED": "The local store is unavailable; nothing can be verified.",
        }[self.overall]

    def to_json(self) -> str:
        return json.dumps({"overall_status": self.overall, "recommendation": self.recommendation, "backends": {n: asdict(s) for n, s in self.backends.items()}}, indent=2)

    def to_markdown(self) -> str:
        rows = [f"| {n} | {'ok' if s.is_healthy else 'down' if s.enabled else 'disabled'} | {s.latency_ms:.2f} | {s.error or ''} |" for n, s in self.backends.items()]
        return "\n".join([f"# Health: {self.overall}", "", self.recommendation, "", "| backend | state | ms | error |", "|-|-|-|-|", *rows, ""])


def check(pings: dict[str, Callable[[], object] | None]) -> Report:
    """``pings`` has one entry named LOCAL and one for each other backend."""
    return Report({name: probe(name, ping) for name, ping in pings.items()})
