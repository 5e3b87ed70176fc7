"""WebSocket feeds as a replayable stream: ``spark.readStream.format("websocket")``.

A feed cannot be asked twice for a message.  The reader therefore keeps a connection for each URL beside the
driver and writes what arrives into segments of a spool folder *before* it names an offset; batches read the
segments, so that a batch that is run again, or a query that is started again from its checkpoint, sees the same
messages under the same positions.  Segments are dropped once their batch is committed.

A connection that breaks, or that answers no ping, is made anew after min(60, 2^k) seconds; k starts again once
a connection has held for 120 seconds.  A reader that is stopped says so to the server and takes what is still
on its way.  If the process is killed, messages since the last segment (``flush_ms``) are lost, as a feed has no
memory of its own; nothing is ever doubled.

Options: ``url`` (one or more, parted by blanks, each a connection of its own), ``spool`` (a folder that driver
and executors share: a path or a URI of a file system that Arrow knows; one for each query), ``flush_ms`` (1000),
``flush_rows`` (10000), ``partition_rows`` (100000), ``ping_every`` (20), ``ping_wait`` (10), ``backoff`` (1) and
``backoff_most`` (60) and ``healthy_after`` (120) in seconds.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import os
import signal
import socket
import ssl
import struct
import threading
import time
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fixed by the protocol (RFC 6455).
ACCEPT = b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
CONTINUED, TEXT, BINARY, CLOSE, PING, PONG = 0x0, 0x1, 0x2, 0x8, 0x9, 0xA
#: Seconds in which a server is given the chance to finish after this side has said that it closes.
LAST = 5.0
KINDS = pa.schema([("connection", pa.int32()), ("position", pa.int64()), ("recv_time", pa.timestamp("us", tz="UTC")), ("value", pa.string())])


class Channel:
    """One connection: texts in, pings answered; a peer that is silent for long is asked for a sign of life."""

    def __init__(self, url: str, ping_every: float = 20, ping_wait: float = 10):
        to = urllib.parse.urlsplit(url)
        port = to.port or (443 if to.scheme == "wss" else 80)
        self.ping_every, self.ping_wait, self.held, self.deadline, self.sending = ping_every, ping_wait, bytearray(), None, threading.Lock()
        self.socket = socket.create_connection((to.hostname, port), timeout=ping_wait)
        try:
            if to.scheme == "wss":
                self.socket = ssl.create_default_context().wrap_socket(self.socket, server_hostname=to.hostname)
            self._greet(to, port)
        except BaseException:
            self.socket.close()
            raise

    def _greet(self, to: urllib.parse.SplitResult, port: int) -> None:
        key = base64.b64encode(os.urandom(16))
        target = (to.path or "/") + (f"?{to.query}" if to.query else "")
        head = [f"GET {target} HTTP/1.1", f"Host: {to.hostname}:{port}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key.decode()}", "Sec-WebSocket-Version: 13", "", ""]
        self.socket.sendall("\r\n".join(head).encode())
        while b"\r\n\r\n" not in self.held:
            self._receive()
        told, _, rest = bytes(self.held).partition(b"\r\n\r\n")
        self.held = bytearray(rest)
        lines = told.decode("latin-1").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if lines[0].split()[1:2] != ["101"] or fields.get("sec-websocket-accept") != base64.b64encode(hashlib.sha1(key + ACCEPT).digest()).decode():
            raise ConnectionError(f"no WebSocket: {lines[0]}")

    def _receive(self) -> None:
        part = self.socket.recv(1 << 16)
        if not part:
            raise ConnectionError("the server has gone")
        self.held += part

    def _take(self, n: int) -> bytes:
        while len(self.held) < n:
            self.socket.settimeout(self.ping_every if self.deadline is None else max(0.01, self.deadline - time.monotonic()))
            try:
                self._receive()
                self.deadline = None
            except TimeoutError:
                if self.deadline is not None:
                    raise ConnectionError("no answer to a ping") from None
                self.deadline = time.monotonic() + self.ping_wait
                self.send(PING)
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def send(self, kind: int, body: bytes = b"") -> None:
        mask = os.urandom(4)
        n = len(body)
        size = bytes([0x80 | n]) if n < 126 else struct.pack("!BH", 0x80 | 126, n) if n < 1 << 16 else struct.pack("!BQ", 0x80 | 127, n)
        with self.sending:
            self.socket.sendall(bytes([0x80 | kind]) + size + mask + bytes(b ^ mask[k % 4] for k, b in enumerate(body)))

    def frame(self) -> tuple[bool, int, bytes]:
        first, second = self._take(2)
        n = second & 0x7F
        n = struct.unpack("!H", self._take(2))[0] if n == 126 else struct.unpack("!Q", self._take(8))[0] if n == 127 else n
        mask = self._take(4) if second & 0x80 else None
        body = self._take(n)
        return bool(first & 0x80), first & 0x0F, bytes(b ^ mask[k % 4] for k, b in enumerate(body)) if mask else body

    def texts(self) -> Iterator[str]:
        """Messages until the server closes; ConnectionError if it is lost."""
        parts: list[bytes] = []
        while True:
            last, kind, body = self.frame()
            if kind == PING:
                with contextlib.suppress(OSError):  # what has come before the loss is still read
                    self.send(PONG, body)
            elif kind == CLOSE:
                with contextlib.suppress(OSError):
                    self.send(CLOSE, body[:2])
                self.socket.close()
                return
            elif kind in (CONTINUED, TEXT, BINARY):
                parts.append(body)
                if last:
                    yield b"".join(parts).decode("utf-8", "replace")
                    parts = []

    def say_close(self) -> None:
        """Asks the server to finish; what it has sent until then still comes out of ``texts``."""
        self.deadline = time.monotonic() + LAST
        self.send(CLOSE, struct.pack("!H", 1000))


class Backoff:
    """Seconds until the next attempt: min(most, base * 2^k) for the k-th loss in a row; a connection that held long starts anew."""

    def __init__(self, base: float = 1, most: float = 60, healthy: float = 120):
        self.base, self.most, self.healthy, self.losses, self.since = base, most, healthy, 0, None

    def connected(self, now: float | None = None) -> None:
        self.since = time.monotonic() if now is None else now

    def lost(self, now: float | None = None) -> float:
        if self.since is not None and (time.monotonic() if now is None else now) - self.since >= self.healthy:
            self.losses = 0
        self.since = None
        self.losses += 1
        return min(self.most, self.base * 2 ** min(self.losses - 1, 60))


@dataclass
class Segment(InputPartition):
    """Positions [low, high) of a connection, in the file of [start, end)."""

    connection: int
    start: int
    end: int
    low: int
    high: int


class Spool:
    """Segments of one connection: written whole under their final name, never changed."""

    def __init__(self, folder: str, connection: int):
        self.connection = connection
        self.files, root = pa.fs.FileSystem.from_uri(folder)
        self.root = f"{root.rstrip('/')}/{connection}"

    def name(self, start: int, end: int) -> str:
        return f"{self.root}/{start:020d}-{end:020d}.arrow"

    def segments(self) -> list[tuple[int, int]]:
        found = self.files.get_file_info(pa.fs.FileSelector(self.root, allow_not_found=True))
        names = [f.base_name.removesuffix(".arrow") for f in found if f.base_name.endswith(".arrow")]
        return sorted(tuple(map(int, n.split("-"))) for n in names)

    def write(self, start: int, rows: list[tuple[datetime, str]]) -> int:
        end = start + len(rows)
        columns = [pa.array([self.connection] * len(rows), pa.int32()), pa.array(range(start, end), pa.int64()), pa.array([r[0] for r in rows], KINDS.field("recv_time").type), pa.array([r[1] for r in rows])]
        self.files.create_dir(self.root, recursive=True)
        fresh = f"{self.root}/.{start}-{os.getpid()}"
        with self.files.open_output_stream(fresh) as out, pa.ipc.new_file(out, KINDS) as made:
            made.write_table(pa.Table.from_arrays(columns, schema=KINDS))
        self.files.move(fresh, self.name(start, end))
        return end

    def read(self, part: Segment) -> pa.Table:
        with self.files.open_input_file(self.name(part.start, part.end)) as f:
            return pa.ipc.open_file(f).read_all().slice(part.low - part.start, part.high - part.low)

    def cut(self, low: int, high: int, rows: int) -> list[Segment]:
        """The parts of the segments that hold [low, high), each with ``rows`` messages at most."""
        out, at = [], low
        for start, end in self.segments():
            while start <= at < min(end, high):
                to = min(end, high, at + rows)
                out.append(Segment(self.connection, start, end, at, to))
                at = to
        if at < high:
            raise RuntimeError(f"the spool {self.root} has lost the messages from {at} to {high}")
        return out

    def drop(self, until: int) -> None:
        """Segments before ``until`` go; the last one stays, since it tells the next position."""
        for start, end in self.segments()[:-1]:
            if end <= until:
                self.files.delete_file(self.name(start, end))


class Receiver(threading.Thread):
    """Keeps a connection and spools what it says."""

    def __init__(self, url: str, spool: Spool, options: dict):
        super().__init__(daemon=True, name=f"websocket-{spool.connection}")
        number = lambda k, v: float(options.get(k, v))
        self.url, self.spool, self.pings = url, spool, (number("ping_every", 20), number("ping_wait", 10))
        self.backoff = Backoff(number("backoff", 1), number("backoff_most", 60), number("healthy_after", 120))
        self.every, self.rows = number("flush_ms", 1000) / 1000, int(number("flush_rows", 10_000))
        self.held, self.writing, self.channel, self.stopping = [], threading.Lock(), None, threading.Event()
        self.next = max((end for _, end in spool.segments()), default=0)
        self.written = time.monotonic()

    def run(self) -> None:
        while not self.stopping.is_set():
            try:
                self.channel = Channel(self.url, *self.pings)
                self.backoff.connected()
                if self.stopping.is_set():
                    self.channel.say_close()
                for text in self.channel.texts():
                    self.held.append((datetime.now(UTC), text))
                    if len(self.held) >= self.rows or time.monotonic() - self.written >= self.every:
                        self.flush()
            except OSError:  # lost, refused, timed out, or a spool that cannot be written just now
                pass
            finally:
                if self.channel is not None:
                    self.channel.socket.close()
            self.stopping.wait(self.backoff.lost())

    def flush(self) -> int:
        """Writes what has come; the position after the last message that is safe."""
        with self.writing:
            n = len(self.held)
            if n:
                self.next = self.spool.write(self.next, self.held[:n])
                del self.held[:n]  # only once it is safe
            self.written = time.monotonic()
            return self.next

    def stop(self) -> None:
        self.stopping.set()
        if self.channel is not None:
            with contextlib.suppress(OSError):  # already gone
                self.channel.say_close()
        self.join(LAST + 1)
        self.flush()


class SocketReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.urls = dict(options), options["url"].split()
        self.running: list[Receiver] = []

    def _spool(self, connection: int) -> Spool:
        return Spool(self.options["spool"], connection)

    def _receivers(self) -> list[Receiver]:
        if not self.running:
            self.running = [Receiver(url, self._spool(k), self.options) for k, url in enumerate(self.urls)]
            for r in self.running:
                r.start()
            if threading.current_thread() is threading.main_thread():
                signal.signal(signal.SIGTERM, self._end)
        return self.running

    def _end(self, *_) -> None:
        if self.running:  # else the reader is stopping just now, which may take a moment
            self.stop()
            os._exit(0)

    def initialOffset(self) -> dict:
        return {str(k): min((start for start, _ in self._spool(k).segments()), default=0) for k in range(len(self.urls))}

    def latestOffset(self) -> dict:
        return {str(k): r.flush() for k, r in enumerate(self._receivers())}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        rows = int(self.options.get("partition_rows", 100_000))
        return [part for k, high in end.items() for part in self._spool(int(k)).cut(start.get(k, 0), high, rows)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        yield from self._spool(partition.connection).read(partition).to_batches()

    def commit(self, end: dict) -> None:
        for k, until in end.items():
            self._spool(int(k)).drop(until)

    def stop(self) -> None:
        running, self.running = self.running, []
        for r in running:
            r.stop()


class SocketStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "websocket"

    def schema(self) -> str:
        return "connection int, position long, recv_time timestamp, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SocketReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SocketStream)
