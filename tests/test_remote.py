"""Files on a web server of this machine: ranges, refusals and repeated attempts."""

import gzip
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from helixframe.sources import remote

LINES = [b"x" * (i * 37 % 101) for i in range(400)]
TEXT = b"\n".join(LINES)
FILES = {"/a": TEXT, "/b": TEXT + b"\n", "/z.gz": gzip.compress(TEXT[:5000]) + gzip.compress(TEXT[5000:]), "/empty": b"", "/crlf": b"p\r\nq\r\n", "/whole": b"abc"}
FAILURES = {}


class Server(BaseHTTPRequestHandler):
    def do_HEAD(self):
        self.answer(False)

    def do_GET(self):
        self.answer(True)

    def answer(self, body):
        if FAILURES.get(self.path, 0):
            FAILURES[self.path] -= 1
            return self.send_error(503)
        if self.path not in FILES:
            return self.send_error(404)
        data, status = FILES[self.path], 200
        if (asked := self.headers["Range"]) and self.path != "/whole":
            start, end = map(int, asked.removeprefix("bytes=").split("-"))
            if start >= len(data):
                return self.send_error(416)
            data, status = data[start : end + 1], 206
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        if body:
            self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_ranges(base):
    assert remote.content_length(base + "/a") == len(TEXT)
    assert remote.fetch_range(base + "/a", 3, 50) == TEXT[3:50]
    assert remote.fetch_range(base + "/a", len(TEXT) - 5, len(TEXT) + 5) == TEXT[-5:]
    for path, says in [("/whole", "206"), ("/missing", "404")]:
        with pytest.raises(ValueError, match=says):
            remote.fetch_range(base + path, 0, 2)
    with pytest.raises(ValueError, match="no bytes"):
        remote.fetch_range(base + "/a", len(TEXT), len(TEXT) + 1)


def test_attempts(base):
    FAILURES["/b"] = 2
    assert remote.fetch_range(base + "/b", 0, 9) == TEXT[:9]
    FAILURES["/b"] = 3
    with pytest.raises(ValueError, match="503"):
        remote.fetch_range(base + "/b", 0, 9)
    assert FAILURES["/b"] == 0


@pytest.mark.parametrize("chunk", [1, 7, 64, 5000, 10**6])
def test_lines_of_ranges(base, chunk, monkeypatch):
    """Whatever the ranges, each line comes once."""
    monkeypatch.setattr(remote, "fetch_range", lambda url, start, end: FILES[url][start:end])
    monkeypatch.setattr(remote, "STEP", 50)
    monkeypatch.setattr(remote, "REST", 3)
    for path in ("/a", "/b"):
        size = len(FILES[path])
        got = [x for at in range(0, size, chunk) for x in remote.range_lines(path, at, min(at + chunk, size), size)]
        assert got == LINES
    assert list(remote.range_lines("/z.gz", 0, len(FILES["/z.gz"]), len(FILES["/z.gz"]), True)) == LINES
    with pytest.raises(ValueError, match="cut off"):
        list(remote.range_lines("/z.gz", 0, 60, 60, True))


def test_http_lines(spark, base):
    urls = spark.createDataFrame([(base + p,) for p in ("/a", "/b", "/a", "/z.gz", "/empty", "/crlf")] + [(None,)], "url string")
    got = {}
    for r in remote.http_lines(urls, chunk=900).collect():
        got.setdefault(r.url.removeprefix(base), []).append(r.value)
    want = sorted(x.decode() for x in LINES)
    assert {p: sorted(v) for p, v in got.items()} == {"/a": want, "/b": want, "/z.gz": want, "/crlf": ["p", "q"]}
    with pytest.raises(Exception, match="206"):
        remote.http_lines(urls.limit(0).unionAll(spark.createDataFrame([(base + "/whole",)], "url string"))).collect()
