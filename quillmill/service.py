"""The review over HTTP: the report, the manifest, and decisions that are applied. A thin layer over :mod:`quillmill.runs`."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession

from quillmill import runs
from quillmill.operators import provenance
from quillmill.sources import sinks, tables
from quillmill.sources.shared import scratch


def answer(spark: SparkSession, output: str, method: str, path: str, body: bytes = b"") -> tuple[int, str, str]:
    """Status, kind and content of a request."""
    kind = "application/json"
    if method == "GET" and path in ("/", "/summary.html"):
        if not tables.exists(spark, f"{output}/review/log"):
            return 404, kind, "{}"
        log = runs.review.numbered(tables.review_log(spark, f"{output}/review/log"), "file", "original_text", "context")
        return 200, "text/html; charset=utf-8", sinks.summary_html(output, log, provenance.file_table(tables.manifest_files(spark, output)))
    if method == "GET" and path == "/status":
        return 200, kind, json.dumps({"server": True, "output_dir": output})
    if method == "GET" and path == "/provenance":
        if not tables.exists(spark, f"{output}/manifest/summary"):
            return 404, kind, "{}"
        return 200, kind, spark.read.json(f"{output}/manifest/summary").toJSON().first() or "{}"
    if method == "POST" and path == "/apply":
        sent = json.loads(body or b"{}")
        columns = tables.DECISIONS.split(", ")
        rows = [[d.get(c.split(" ")[0]) for c in columns] for d in sent.get("decisions", [])]
        place = scratch(spark, "decisions")
        sinks.write_csv(spark.createDataFrame(rows, tables.DECISIONS), place)
        return 200, kind, runs.apply_decisions(spark, output, place, (sent.get("reviewer") or "").strip()).toJSON().first()
    return 404, kind, json.dumps({"error": "not found"})


def serve(spark: SparkSession, output: str, port: int = 8765) -> None:
    class Handler(BaseHTTPRequestHandler):
        def run(self) -> None:
            try:
                length = int(self.headers.get("Content-Length") or 0)
                code, kind, content = answer(spark, output, self.command, self.path, self.rfile.read(length))
            except Exception as error:  # the client sees what went wrong
                code, kind, content = 500, "application/json", json.dumps({"error": str(error)})
            data = content.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = run

    HTTPServer(("127.0.0.1", port), Handler).serve_forever()
