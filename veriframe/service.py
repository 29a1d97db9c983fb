"""A thin HTTP service over the engine, on the standard library."""

from __future__ import annotations

import json
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from veriframe.operators import verdict
from veriframe.plans.claims import with_defaults
from veriframe.plans.engine import VerificationEngine

CLAIM = "assertion_id string, subject string, relation string, object string, polarity string, rule_type string"
HEALTH_SECONDS = 30


class BadRequest(ValueError):
    """What a caller sent can't be processed."""


def validate(engine: VerificationEngine, body: dict) -> dict:
    """Ingest a text and adjudicate its triples: {document_id, ingestion_status, chunks_ingested, svos_extracted, verdicts, summary, backend_status}."""
    text, triples = body.get("text"), body.get("triples") or []
    if not isinstance(text, str) or not text.strip():
        raise BadRequest("text is empty")
    if not all(isinstance(t, dict) and all(isinstance(t.get(k), str) for k in ("subject", "relation", "object")) for t in triples):
        raise BadRequest("a triple needs subject, relation and object")
    spark = engine.spark
    document_id = body.get("document_id") or f"doc_{uuid.uuid4().hex[:12]}"
    rows = [(t.get("assertion_id") or f"t{k}", t["subject"], t["relation"], t["object"], t.get("polarity"), t.get("rule_type")) for k, t in enumerate(triples)]
    counts = engine.ingest(spark.createDataFrame([(document_id, text)], "document_id string, raw_text string")).first()
    verdicts = engine.adjudicate(with_defaults(spark.createDataFrame(rows, CLAIM)), int(body.get("top_k") or 5))
    order = {r[0]: k for k, r in enumerate(rows)}
    listed = sorted((r.asDict(recursive=True) for r in verdicts.collect()), key=lambda v: order[v["assertion_id"]])  # a request's few triples
    total = verdict.summary(verdicts).first().asDict()
    return {
        "document_id": document_id,
        "ingestion_status": counts.status,
        "chunks_ingested": counts.chunks,
        "svos_extracted": counts.svos,
        "verdicts": [v | {"evidence": [_entry(e) for e in v["evidence"]], "counter_evidence": [_entry(e) for e in v["counter_evidence"]]} for v in listed],
        "summary": total,
        "backend_status": engine.backend_status(),
    }


def _entry(e: dict) -> dict:
    matched = {k: e[f"matched_{k}"] for k in ("subject", "relation", "object")}
    return {"chunk_id": e["chunk_id"], "text": e["text"], "source": "fusion", "confidence": e["confidence"], "match_type": e["support_type"], "matched": matched}


def handler(engine: VerificationEngine) -> type[BaseHTTPRequestHandler]:
    seen: dict = {}

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/config":
                self.reply(200, json.loads(engine.settings.to_json(redact=True)))
            elif self.path == "/health":
                if time.monotonic() - seen.get("at", -1e9) > HEALTH_SECONDS:
                    seen.update(at=time.monotonic(), report=json.loads(engine.health().to_json()))
                self.reply(200, seen["report"])
            else:
                self.reply(404, {"error": "not found"})

        def do_POST(self) -> None:
            if self.path != "/validate":
                return self.reply(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                if not isinstance(body, dict):
                    raise BadRequest("the body must be an object")
                self.reply(200, validate(engine, body))
            except json.JSONDecodeError as e:
                self.reply(422, {"error": str(e)})
            except BadRequest as e:
                self.reply(400, {"error": str(e)})
            except Exception as e:
                self.reply(500, {"error": f"{type(e).__name__}: {e}"[:500]})

        def log_message(self, *_) -> None:
            """Requests aren't logged."""

    return Handler


def serve(engine: VerificationEngine, port: int = 8000) -> None:
    ThreadingHTTPServer(("127.0.0.1", port), handler(engine)).serve_forever()
