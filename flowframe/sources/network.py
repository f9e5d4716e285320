"""Network sources and sinks as Spark data sources: TCP and UDP sockets, HTTP.

Register them with :func:`register`; then ``spark.read.format("tcp").option("port", 9000).load()`` gives buffers
(``sequence``, ``payload``) and ``df.write.format("tcp")`` sends payloads. A read is one task: it ends when the
other side closes, or after ``count`` buffers or ``timeout`` seconds. For unbounded input use Kafka.
"""

from __future__ import annotations

import socket
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "sequence bigint, payload binary"


@dataclass
class Sent(WriterCommitMessage):
    buffers: int


def _address(options) -> tuple[str, int]:
    return options.get("host", "127.0.0.1"), int(options["port"])


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = options
        self.most = int(options.get("count", 1 << 62))
        self.timeout = float(options.get("timeout", 10))
        self.chunk = int(options.get("chunk", 65536))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, data in enumerate(self.buffers()):
            yield (i, bytes(data))
            if i + 1 >= self.most:
                return


class TcpReader(_Reader):
    def buffers(self) -> Iterator[bytes]:
        """Chunks of a connection that is made (``mode`` connect) or waited for (``listen``)."""
        if self.options.get("mode", "connect") == "listen":
            with socket.create_server(_address(self.options)) as server:
                server.settimeout(self.timeout)
                found, _ = server.accept()
        else:
            found = socket.create_connection(_address(self.options), self.timeout)
        with found, found.makefile("rb") as stream:
            while data := stream.read(self.chunk):
                yield data


class UdpReader(_Reader):
    def buffers(self) -> Iterator[bytes]:
        """Datagrams that come to a port, or to a multicast ``group``."""
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            s.bind(_address(self.options))
            if group := self.options.get("group"):
                s.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, socket.inet_aton(group) + socket.inet_aton("0.0.0.0"))
            s.settimeout(self.timeout)
            while True:
                try:
                    yield s.recv(65535)
                except TimeoutError:
                    return


class HttpReader(_Reader):
    def buffers(self) -> Iterator[bytes]:
        """The body of a GET in chunks."""
        with urllib.request.urlopen(self.options["url"], timeout=self.timeout) as answer:
            while data := answer.read(self.chunk):
                yield data


class _Writer(DataSourceWriter):
    def __init__(self, options) -> None:
        self.options = options

    def write(self, rows) -> WriterCommitMessage:
        n = 0
        send, close = self.open()
        try:
            for row in rows:
                send(bytes(row["payload"]))
                n += 1
        finally:
            close()
        return Sent(n)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


class TcpWriter(_Writer):
    def open(self):
        s = socket.create_connection(_address(self.options))
        return s.sendall, s.close


class UdpWriter(_Writer):
    def open(self):
        s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        if ttl := self.options.get("ttl"):
            s.setsockopt(socket.IPPROTO_IP, socket.IP_MULTICAST_TTL, int(ttl))
        to = _address(self.options)
        return lambda data: s.sendto(data, to), s.close


class HttpWriter(_Writer):
    def open(self):
        """A request for each payload, by ``method`` POST, PUT or PATCH."""

        def send(data: bytes) -> None:
            request = urllib.request.Request(self.options["url"], data, method=self.options.get("method", "POST"))
            urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 10))).close()

        return send, lambda: None


def _source(title: str, reader: type, writer: type) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return reader(self.options)

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return writer(self.options)

    return Source


def register(spark: SparkSession) -> None:
    """Make the formats ``tcp``, ``udp`` and ``http`` known to the session."""
    from flowframe import runtime

    runtime.ship(spark)
    for title, reader, writer in (("tcp", TcpReader, TcpWriter), ("udp", UdpReader, UdpWriter), ("http", HttpReader, HttpWriter)):
        spark.dataSource.register(_source(title, reader, writer))
