"""Data source "chrony": asks a time server and gives a row (command, asked_at, raw) for each request, in batch or stream.

A stream's batch that is run again after a restart asks its requests again: it has as many rows, with the answers of then (asked_at).
"""

from __future__ import annotations

import socket
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.chrony import request

SCHEMA = "command STRING, asked_at BIGINT, raw BINARY"


def ask(packet: bytes, host: str | None, port: int, path: str | None, timeout: float) -> bytes:
    """One request and its reply, over UDP or a local datagram socket."""
    family = socket.AF_UNIX if path else socket.AF_INET6 if ":" in (host or "") else socket.AF_INET
    with socket.socket(family, socket.SOCK_DGRAM) as s:
        s.settimeout(timeout)
        if path:
            s.bind("")  # an address of its own, so the server can reply
            s.connect(path)
        else:
            s.connect((host, port))
        s.send(packet)
        return s.recv(1024)


class _Asking:
    def __init__(self, options: dict):
        self.host, self.port = options.get("host", "127.0.0.1"), int(options.get("port", 323))
        self.path, self.timeout = options.get("path"), float(options.get("timeout", 5))
        self.commands = [c.strip() for c in options.get("command", "tracking").split(",")]
        self.index, self.address = int(options.get("index", 0)), options.get("address")

    def rows(self, start: int):
        for i, command in enumerate(self.commands):
            packet = request(command, start + i + 1, self.index, self.address)
            yield command, time.time_ns(), ask(packet, self.host, self.port, self.path, self.timeout)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.asking = _Asking(options)

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from self.asking.rows(0)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.asking = _Asking(options)

    def initialOffset(self):
        return {"n": 0}

    def read(self, start: dict):
        return iter(list(self.asking.rows(start["n"]))), {"n": start["n"] + len(self.asking.commands)}

    def readBetweenOffsets(self, start: dict, end: dict):
        # a batch that was read and not committed: the server's past answers are gone, so the same requests are asked again
        for n in range(start["n"], end["n"], max(1, len(self.asking.commands))):
            yield from self.asking.rows(n)


class ChronySource(DataSource):
    """Options: host, port or path; command (comma-separated), index, address, timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "chrony"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)


def register(spark) -> None:
    spark.dataSource.register(ChronySource)
