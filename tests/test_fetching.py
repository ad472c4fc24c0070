"""Fetching from a local server that fails in several ways."""

from __future__ import annotations

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from eventweave.operators import providers
from eventweave.sources import fetching, files


@pytest.fixture
def server():
    seen, times = Counter(), []

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            seen[self.path] += 1
            times.append(time.monotonic())
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status = 404 if self.path == "/none" else 503 if self.path == "/down" or (self.path == "/flaky" and seen[self.path] < 3) else 200
            if self.path == "/cut":
                self.connection.close()
                return
            self.send_response(status)
            self.send_header("Content-Type", "image/png")
            self.end_headers()
            self.wfile.write(b"got " + self.path.encode() + body)

        do_GET = do_POST = answer

        def log_message(self, *_):
            pass

    own = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", seen, times
    own.shutdown()


def test_answers_retries_and_errors_are_rows(spark, server):
    root, seen, _ = server
    urls = [f"{root}/a", f" {root}/a ", f"{root}/flaky", f"{root}/none", f"{root}/down", f"{root}/cut", "http://127.0.0.1:1/x", "no url", None, " "]
    out = fetching.fetch(spark.createDataFrame([(u,) for u in urls], "ref string"), "ref", wait=0.01, per_second=1000.0)
    got = {r.reference.removeprefix(root): r for r in out.collect()}
    assert set(got) == {"/a", "/flaky", "/none", "/down", "/cut", "http://127.0.0.1:1/x", "no url"}
    assert (bytes(got["/a"].content), got["/a"].mime, got["/a"].status, got["/a"].tries, got["/a"].error) == (b"got /a", "image/png", 200, 1, None)
    assert (got["/flaky"].status, got["/flaky"].tries, got["/flaky"].error) == (200, 3, None)
    assert (got["/none"].content, got["/none"].status, got["/none"].tries, got["/none"].error) == (None, 404, 1, "status 404")
    assert (got["/down"].status, got["/down"].tries, got["/down"].error) == (503, 3, "status 503")
    assert got["/cut"].status is None and got["/cut"].tries == 3 and got["/cut"].error
    assert "refused" in got["http://127.0.0.1:1/x"].error.lower() and got["no url"].host == "" and got["no url"].error
    assert seen["/a"] == 1 and seen["/none"] == 1 and seen["/down"] == 3


def test_bodies_are_posted_and_images_read(spark, server):
    root, _, _ = server
    rows = spark.createDataFrame([(f"{root}/q", '{"n": 1}'), (f"{root}/q", '{"n": 2}'), (f"{root}/q", None)], "url string, ask string")
    out = fetching.fetch(rows, "url", "ask", per_second=1000.0)
    assert sorted(bytes(r.content) for r in out.collect()) == [b"got /q", b'got /q{"n": 1}', b'got /q{"n": 2}']
    images = files.with_image_bytes(spark.createDataFrame([(f"{root}/i",), ("data:image/gif;base64,AAAA",)], "ref string"), "ref", fetched=fetching.fetch(spark.createDataFrame([(f"{root}/i",)], "ref string"), "ref"))
    assert {r.mime: bytes(r.content) for r in images.collect()} == {"image/png": b"got /i", "image/gif": b"\x00\x00\x00"}


def test_a_host_gets_no_more_than_its_rate(spark, server):
    root, seen, times = server
    rows = spark.createDataFrame([(f"{root}/{i}",) for i in range(24)], "ref string")
    assert fetching.fetch(rows, "ref", per_second=20.0, lanes=2).where("error is null").count() == 24
    assert len(seen) == 24 and max(sum(t <= u < t + 1 for u in times) for t in times) <= 22


def test_a_service_that_fails_is_asked_again_and_its_error_kept(spark):
    def post(values):
        if values["q"] == "bad":
            raise OSError("down")
        return values["q"].upper()

    rows = providers.ask(spark.createDataFrame([("a",), ("bad",)], "q string"), post, ["q"], tries=2, error="why")
    assert sorted(map(tuple, rows.collect())) == [("a", "A", None), ("bad", None, "OSError: down")]
    assert providers.ask(rows.select("q"), None, ["q"], error="why").columns == ["q", "response", "why"]
