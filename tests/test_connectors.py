"""Network data sources against sockets of the test, observations, manifests, custom elements."""

import socket
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from flowframe import observability
from flowframe.operators import media, segment
from flowframe.plans.builder import Pipeline
from flowframe.plans.registry import element
from flowframe.sources import generators, network
from flowframe.streaming import operators as streaming


def free_port() -> int:
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_tcp(spark):
    network.register(spark)
    got, server = [], socket.create_server(("127.0.0.1", 0))
    port = server.getsockname()[1]

    def serve():
        c, _ = server.accept()
        c.sendall(b"0123456789")
        c.close()
        c, _ = server.accept()
        while data := c.recv(100):
            got.append(data)

    t = threading.Thread(target=serve, daemon=True)
    t.start()
    rows = spark.read.format("tcp").option("port", port).option("chunk", 4).load().collect()
    assert [bytes(r["payload"]) for r in sorted(rows)] == [b"0123", b"4567", b"89"]
    generators.data_source(spark, b"abcdef", 3).select("sequence", "payload").coalesce(1).write.format("tcp").option("port", port).mode("append").save()
    t.join(10)
    assert b"".join(got) == b"abcdef"
    server.close()


def test_udp(spark):
    network.register(spark)
    port = free_port()

    def send():
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for _ in range(100):
                s.sendto(b"datagram", ("127.0.0.1", port))
                time.sleep(0.1)

    threading.Thread(target=send, daemon=True).start()
    rows = spark.read.format("udp").option("port", port).option("count", 3).load().collect()
    assert [bytes(r["payload"]) for r in rows] == [b"datagram"] * 3


def test_http(spark):
    network.register(spark)
    posted = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"body of the answer")

        def do_PUT(self):
            posted.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    rows = spark.read.format("http").option("url", url).option("chunk", 7).load().collect()
    assert b"".join(bytes(r["payload"]) for r in sorted(rows)) == b"body of the answer"
    generators.data_source(spark, b"xxyy", 2).select("sequence", "payload").write.format("http").option("url", url).option("method", "PUT").mode("append").save()
    assert sorted(posted) == [b"xx", b"yy"]
    server.shutdown()


def test_observations(spark, sf):
    df, seen = observability.counted(generators.null_source(spark, 10, 8), "nulls")
    assert df.count() == 10 and seen.get["n_bytes"] == 80
    log = observability.ProgressLog()
    spark.streams.addListener(log)
    kind = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{sf}/events*.parquet")
    assert streaming.run_once(stream.select("event_id")).count() == 1000
    for _ in range(50):
        if log.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(log)
    assert sum(b["rows"] for b in log.batches) == 1000


def test_manifest_and_parameter_sets():
    text = segment.dash_manifest([{"segment": 3, "duration": 6_000_000_000}, {"segment": 4, "duration": 5_500_000_000}])
    assert 'startNumber="3"' in text and '<S t="6000" d="5500"/>' in text and "PT11.500S" in text
    found = media.parameter_sets(b"\0\0\0\1\x67abc\0\0\1\x68d\0\0\1\x65frame")
    assert found == {"sps": [b"\x67abc"], "pps": [b"\x68d"]}


def test_custom_element(spark):
    @element("doubled")
    def doubled(df):
        return df.withColumn("payload", F.concat("payload", "payload"))

    row = Pipeline.parse("nullsource count=3 size=5 ! doubled ! count").run(spark).first()
    assert row["n_bytes"] == 30
