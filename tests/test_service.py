import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest

from veriframe.__main__ import main
from veriframe.plans.engine import VerificationEngine
from veriframe.service import handler


@pytest.fixture()
def url(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(VerificationEngine(spark, str(tmp_path / "s"))))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def ask(url, body=None):
    data = body if isinstance(body, bytes) else json.dumps(body).encode() if body is not None else None
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data)) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_http(url):
    body = {"document_id": "d", "text": "Aspirin treats headache.", "triples": [{"subject": "Aspirin", "relation": "treats", "object": "headache"}, {"subject": "", "relation": "x", "object": "y"}]}
    status, got = ask(f"{url}/validate", body)
    assert status == 200 and got["chunks_ingested"] == 1 and got["summary"]["total_triples"] == len(got["verdicts"]) == 2
    assert got["verdicts"][0]["label"] == "supported" and got["verdicts"][0]["evidence"][0]["matched"] == {"subject": True, "relation": True, "object": True}
    assert ask(f"{url}/validate", {"text": " ", "triples": []})[0] == 400
    assert ask(f"{url}/validate", b"{")[0] == 422
    assert ask(f"{url}/config")[1]["neo4j"]["password"] == "***"
    assert ask(f"{url}/health")[1]["overall_status"] == "DEGRADED"
    assert ask(f"{url}/none")[0] == 404


def test_command_line(spark, tmp_path, capsys):
    store = ["--store", str(tmp_path / "s")]
    assert main([*store, "validate", "--text", "Aspirin treats headache.", "Aspirin|treats|headache"], spark) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["supported"] == 1
    assert main([*store, "export", "--output", str(tmp_path / "e"), "Aspirin|treats|headache|must_not_hold"], spark) == 0
    assert capsys.readouterr().out.strip() == "1"
    assert main([*store, "demo"], spark) == 0 and json.loads(capsys.readouterr().out)[0]["rank"] == 1
    assert main([*store, "health", "--markdown"], spark) == 0
