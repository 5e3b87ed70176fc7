"""The WebSocket source against a local server that drops its connections."""

import base64
import contextlib
import hashlib
import json
import socket
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import websocket
from tidemark.streaming import capture


class Server:
    """Sends numbered envelopes, over to the next connection where the last one ended; drops each after ``each`` of them."""

    def __init__(self, total, each=10**9, gap=0.0, pongs=True):
        self.total, self.each, self.gap, self.pongs = total, each, gap, pongs
        self.sent, self.connections, self.answers, self.lock = 0, 0, 0, threading.Lock()
        self.socket = socket.create_server(("127.0.0.1", 0))
        self.url = f"ws://127.0.0.1:{self.socket.getsockname()[1]}/stream?streams=btcusdt@aggTrade"
        threading.Thread(target=self.run, daemon=True).start()

    def run(self):
        while True:
            try:
                peer, _ = self.socket.accept()
            except OSError:
                return
            try:
                self.serve(peer)
            except OSError:
                pass
            peer.close()

    @staticmethod
    def frame(kind, body, last=True):
        n = len(body)
        size = bytes([n]) if n < 126 else struct.pack("!BH", 126, n) if n < 1 << 16 else struct.pack("!BQ", 127, n)
        return bytes([(0x80 if last else 0) | kind]) + size + body

    def serve(self, peer):
        head = b""
        while b"\r\n\r\n" not in head:
            head += peer.recv(4096)
        key = next(x.split(b": ")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"sec-websocket-key"))
        accept = base64.b64encode(hashlib.sha1(key + websocket.ACCEPT).digest())
        peer.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n")
        self.connections += 1
        closing = threading.Event()

        def listen():
            try:
                while got := peer.recv(4096):
                    if got[0] & 0x0F == 8:
                        closing.set()
                    if got[0] & 0x0F == 9 and self.pongs:
                        with self.lock:
                            self.answers += 1
                            peer.sendall(self.frame(10, b""))
            except OSError:
                pass

        listener = threading.Thread(target=listen, daemon=True)
        listener.start()
        for k in range(self.each):
            if closing.is_set() or self.sent >= self.total:
                break
            told = json.dumps({"stream": "btcusdt@aggTrade", "data": {"a": self.sent, "p": "1.5", "q": "2", "m": self.sent % 2 == 0, "T": 1700000000000 + self.sent, "E": 1700000000000, "pad": "é" * (self.sent % 300)}}).encode()
            with self.lock:
                if k % 3 == 0:
                    peer.sendall(self.frame(1, told[:7], last=False) + self.frame(9, b"hi") + self.frame(0, told[7:]))
                else:
                    peer.sendall(self.frame(1, told))
            self.sent += 1
            time.sleep(self.gap)
        if self.sent >= self.total:
            closing.wait(30)
        if closing.is_set():
            with self.lock:
                peer.sendall(self.frame(8, struct.pack("!H", 1000)))
        with contextlib.suppress(OSError):
            peer.shutdown(socket.SHUT_WR)
        listener.join(1)


def wait_for(true, seconds=60):
    until = time.time() + seconds
    while not true():
        assert time.time() < until, "it took too long"
        time.sleep(0.1)


def test_no_message_lost_or_doubled(spark, tmp_path):
    websocket.register(spark)
    server = Server(400, each=37, gap=0.004)
    options = {"url": server.url, "spool": str(tmp_path / "spool"), "flush_ms": 50, "backoff": 0.02, "partition_rows": 20}

    def start():
        raw = spark.readStream.format("websocket").options(**options).load()
        return capture.sink_raw(raw, str(tmp_path / "out"), str(tmp_path / "check"), host="here", every="200 milliseconds")

    def stored():
        try:
            return spark.read.parquet(str(tmp_path / "out")).count()
        except Exception:
            return 0

    query = start()
    wait_for(lambda: stored() > 60)
    query.stop()
    kept = stored()
    assert kept < 400
    query = start()  # from the checkpoint
    wait_for(lambda: stored() >= 400)
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 400 and server.connections > 5
    ids = rows.select(F.col("data")["a"].cast("int").alias("a"), "position", "kind", "symbol", "host").collect()
    assert sorted(r["a"] for r in ids) == list(range(400))
    assert all(r["a"] == r["position"] for r in ids)
    assert {(r["kind"], r["symbol"], r["host"]) for r in ids} == {("aggTrade", "BTCUSDT", "here")}
    assert len(websocket.Spool(options["spool"], 0).segments()) < 40  # committed segments have gone


def test_batches_are_read_again_as_they_were(tmp_path):
    server = Server(50, each=7, gap=0.001)
    options = {"url": f"{server.url} {server.url}", "spool": f"file://{tmp_path}/spool", "flush_ms": 0, "backoff": 0.01}
    reader = websocket.SocketReader(options)
    first = reader.initialOffset()
    assert first == {"0": 0, "1": 0}
    wait_for(lambda: sum(reader.latestOffset().values()) == 50)
    end = reader.latestOffset()
    read = lambda: [r for p in reader.partitions(first, end) for b in reader.read(p) for r in b.to_pylist()]
    once = read()
    reader.stop()
    again = websocket.SocketReader(options)
    assert again.latestOffset() == end and read() == once
    assert sorted(json.loads(r["value"])["data"]["a"] for r in once) == list(range(50))
    again.commit(end)
    assert again.latestOffset() == end  # the last segment tells the position
    again.stop()
    with pytest.raises(RuntimeError):
        again.partitions(first, {"0": end["0"] + 5, "1": 0})


def test_a_dead_server_is_left():
    server = Server(3, pongs=False)
    channel = websocket.Channel(server.url, ping_every=0.2, ping_wait=0.2)
    with pytest.raises(ConnectionError):
        list(channel.texts())
    alive = Server(3)
    channel = websocket.Channel(alive.url, ping_every=0.1, ping_wait=5)
    out = channel.texts()
    assert [json.loads(next(out))["data"]["a"] for _ in range(3)] == [0, 1, 2]
    threading.Timer(0.7, channel.say_close).start()
    assert list(out) == [] and alive.answers >= 2


def test_no_websocket_and_nobody_there():
    plain = socket.create_server(("127.0.0.1", 0))

    def answer():
        peer, _ = plain.accept()
        peer.recv(4096)
        peer.sendall(b"HTTP/1.1 404 Not Found\r\n\r\n")
        peer.close()

    threading.Thread(target=answer, daemon=True).start()
    with pytest.raises(ConnectionError):
        websocket.Channel(f"ws://127.0.0.1:{plain.getsockname()[1]}")
    plain.close()


def test_backoff():
    wait = websocket.Backoff()
    assert [wait.lost(0) for _ in range(8)] == [1, 2, 4, 8, 16, 32, 60, 60]
    wait.connected(0)
    assert wait.lost(119) == 60
    wait.connected(200)
    assert wait.lost(320) == 1
