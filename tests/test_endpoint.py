"""The endpoint labeller against a server of our own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from terrane.operators import labels
from terrane.sources import endpoint


@pytest.fixture
def server():
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status, value):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(value).encode())

        def do_GET(self):
            self._send(200, {"data": [{"id": "small"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(body)
            if body["model"] == "tiny":
                return self._send(400, {"error": "context length exceeded"})
            nodes = json.loads(body["messages"][0]["content"].split("Узлы:\n")[1])
            answer = {n["id"]: {"label": n["label"].upper(), "summary": "да", "group_id": None} for n in nodes}
            if len(calls) == 1:
                answer.popitem()  # the first reply leaves one out, so its window is asked again
            self._send(200, {"choices": [{"message": {"content": "```json\n" + json.dumps({"labels": answer}) + "\n```"}}]})

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", calls
    s.shutdown()


def test_labels_come_from_the_endpoint(spark, server):
    url, calls = server
    settings = {"base_url": url, "model": "small", "palette": [{"type": "t", "label": "T", "description": "d"}]}
    cols = "report STRING, id STRING, parent_id STRING, ord INT, depth INT, path STRING, kind STRING, label STRING, layer STRING, file STRING, start_line INT, end_line INT, symbol STRING, summary STRING, coverage_ids ARRAY<STRING>, group_id STRING"
    row = lambda k, i: ("r", i, None, k, 0, f"{k:08d}", "action", i, "flow", "f", k, k, None, None, [i], None)
    out = labels.label(spark.createDataFrame([row(1, "a"), row(2, "b"), row(300, "c")], cols), endpoint.labeller(settings))
    assert {r["id"]: (r["label"], r["summary"]) for r in out.collect()} == {"a": ("A", "да"), "b": ("B", "да"), "c": ("C", "да")}
    assert len(calls) == 3 and endpoint.models(url) == ["small"]
    with pytest.raises(endpoint.EndpointError, match="larger than the model"):
        endpoint.complete(url, "tiny", [{"role": "user", "content": "x"}])


def test_objects_in_replies():
    assert endpoint.object_in('{"a": 1}') == {"a": 1}
    assert endpoint.object_in('so: {"a": 1} done') == {"a": 1}
    assert endpoint.object_in("none") == {} and endpoint.object_in("} {") == {}
