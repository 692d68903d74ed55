from __future__ import annotations

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

import pytest
from pyspark.sql import functions as F

from lawloom.errors import CorpusError
from lawloom.plans.compile import compile_sources
from lawloom.sources.fetch import SERVICE, fetch_laws
from lawloom.sources.law_xml import adapt_laws

LAW = """<Law Era="Reiwa" Year="2" Num="1" Lang="ja" LawType="Act" PromulgateMonth="1" PromulgateDay="2"><LawNum>試験第一号</LawNum><LawBody><LawTitle>試験 {0}</LawTitle>
<MainProvision><Article Num="1"><ArticleTitle>第一条</ArticleTitle><Paragraph Num="1"><ParagraphNum/><ParagraphSentence><Sentence>本文 {0}</Sentence></ParagraphSentence></Paragraph></Article></MainProvision></LawBody></Law>"""


@pytest.fixture
def service():
    """A law service: ids in 7 are busy once, in 8 always, in 9 unknown, in 6 no law, in 5 break the connection once."""
    asked: list[tuple[str, float]] = []
    times: Counter = Counter()
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            parts = urlsplit(self.path)
            law, day = unquote(parts.path.rsplit("/", 1)[1]), parse_qs(parts.query).get("asof", [""])[0]
            with lock:
                times[law, day] += 1
                nth = times[law, day]
                asked.append((law, time.monotonic()))
            status, body = 200, LAW.format(law + day).encode()
            if law[-1] == "8" or (law[-1] == "7" and nth == 1):
                status, body = 503, b"busy"
            elif law[-1] == "9":
                status, body = 404, b"<error_info><code>404001</code></error_info>"
            elif law[-1] == "6":
                body = b"<x/>"
            elif law[-1] == "5" and nth == 1:
                self.close_connection = True
                return
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    class Server(ThreadingHTTPServer):
        request_queue_size = 128
        daemon_threads = True

    server = Server(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()
    server.server_close()


def test_a_thousand_laws(spark, service):
    """Every law once, failures listed with their codes and attempts, nothing fetched again by later actions."""
    url, asked = service
    ids = spark.range(1000).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("law_id"), F.lit(1).alias("attempts"))
    got = fetch_laws(ids.union(ids), per_second=4000, retries=2, pause=0.001, service=url)
    assert got.files.count() == got.receipts.count() == 700
    told = {r.law_id: (r.attempts, r.diagnostic) for r in got.failures.collect()}
    expected = {"6": (1, "EGOV_FETCH_XML"), "8": (3, "EGOV_FETCH_HTTP_503"), "9": (1, "EGOV_FETCH_HTTP_404:404001")}
    assert told == {f"L{i}": expected[str(i)[-1]] for i in range(1000) if str(i)[-1] in expected}
    requests = Counter(law for law, _ in asked)
    assert requests == {f"L{i}": {"5": 2, "7": 2, "8": 3}.get(str(i)[-1], 1) for i in range(1000)}
    bodies = {r.file: bytes(r.content).decode() for r in got.files.collect()}
    assert all(bodies[k] == LAW.format(k) for k in bodies) and len(bodies) == 700


def test_rate(spark, service):
    """No second sees more requests than were asked for, and one more a task."""
    url, asked = service
    fetch_laws(spark.range(0, 1200, 10).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("law_id")), tasks=3, per_second=60, service=url)
    at = sorted(t for _, t in asked)
    assert len(at) == 120 and max(sum(a <= t < a + 1 for t in at) for a in at) <= 63


def test_days_bad_ids_and_compiling(spark, service):
    url, asked = service
    rows = [("A1", "2024-01-01"), ("A1", "2025-01-01"), (" A1 ", None), ("A1", None), (None, None), ("  ", None), ("B/1", "2024-13-01"), ("B/1", None)]
    got = fetch_laws(spark.createDataFrame(rows, "law_id string, as_of string"), tasks=2, per_second=1000, service=url)
    failures = sorted((r.file, r.law_id or "", r.attempts, r.diagnostic) for r in got.failures.collect())
    assert failures == [("", "", 0, "EGOV_FETCH_LAW_ID"), ("", "", 0, "EGOV_FETCH_LAW_ID"), ("B/1@2024-13-01", "B/1", 0, "EGOV_FETCH_AS_OF")]
    assert sorted(r.file for r in got.files.collect()) == ["A1", "A1@2024-01-01", "A1@2025-01-01", "B/1"]
    public = got.receipts.withColumn("source_url", F.replace(F.col("source_url"), F.lit(url), F.lit(SERVICE)))
    compiled = compile_sources(adapt_laws(got.files, got.law_ids), acquisition=public, converted_at="2026-01-01T00:00:00Z")
    told = {r.file: json.loads(r.manifest)["acquisition"] for r in compiled.manifest.collect()}
    assert {k: (v["requested_law_id"], v["as_of"]) for k, v in told.items()} == {"A1": ("A1", None), "A1@2024-01-01": ("A1", "2024-01-01"), "A1@2025-01-01": ("A1", "2025-01-01"), "B/1": ("B/1", None)}
    empty = fetch_laws(spark.createDataFrame([], "law_id string"), service=url)
    assert empty.files.count() == empty.failures.count() == 0
    with pytest.raises(CorpusError, match="EGOV_FETCH_OPTIONS"):
        fetch_laws(got.law_ids, per_second=0, service=url)
