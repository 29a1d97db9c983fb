"""Command line: ``python -m veriframe validate|export|demo|health|serve``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from veriframe.plans.claims import with_defaults
from veriframe.plans.engine import VerificationEngine
from veriframe.service import serve, validate
from veriframe.sources import assertions
from veriframe.sources.settings import Settings

DEMO = "Aspirin treats headache. The drug is also used to reduce fever and inflammation."


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="veriframe", description=__doc__)
    top.add_argument("--store", help="folder of the stores")
    top.add_argument("--config", help="settings as a JSON file; else from the environment")
    sub = top.add_subparsers(dest="command", required=True)
    for name, help_text in (("validate", "verdicts of triples"), ("export", "training examples of assertions"), ("demo", "a short document and a query")):
        p = sub.add_parser(name, help=help_text)
        p.add_argument("--document-id", default="document")
        p.add_argument("--text", default=DEMO if name == "demo" else None)
        p.add_argument("--file")
        p.add_argument("--top-k", type=int, default=5)
        p.add_argument("claims", nargs="*" if name == "demo" else "+", help="subject|relation|object")
        p.add_argument("--output", default="training_examples")
    p = sub.add_parser("health", help="state of the stores")
    p.add_argument("--markdown", action="store_true")
    p = sub.add_parser("serve", help="HTTP: POST /validate, GET /health, GET /config")
    p.add_argument("--port", type=int, default=8000)
    args = top.parse_args(argv)

    settings = Settings.load(args.config) if args.config else Settings.from_environment()
    spark = spark or SparkSession.builder.appName("veriframe").getOrCreate()
    engine = VerificationEngine(spark, args.store or settings.store_path, settings)
    if args.command == "health":
        report = engine.health()
        print(report.to_markdown() if args.markdown else report.to_json())
        return int(report.overall == "FAILED")
    if args.command == "serve":
        serve(engine, args.port)
        return 0
    text = Path(args.file).read_text() if args.file else args.text
    if args.command == "validate":
        triples = [r.asDict() for r in assertions.parse_triples(spark, args.claims).collect()]
        print(json.dumps(validate(engine, {"document_id": args.document_id, "text": text or "", "triples": triples, "top_k": args.top_k}), indent=2))
        return 0
    if text:
        engine.ingest(spark.createDataFrame([(args.document_id, text)], "document_id string, raw_text string"))
    if args.command == "export":
        claims = with_defaults(assertions.parse_assertions(spark, args.claims))
        print(engine.export_examples(claims, args.output, args.document_id, args.top_k).count())
        return 0
    asked = spark.createDataFrame([("q", " ".join(args.claims) or "What treats headache?")], "query_id string, query string")
    print(json.dumps([r.asDict() for r in engine.verify(asked, args.top_k).orderBy("rank").collect()], indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
