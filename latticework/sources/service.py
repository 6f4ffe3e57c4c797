"""The network face of an engine: JSON lines over TCP, and the connection limit over HTTP and signals.

A connection takes one slot of the limiter, logs in with its first line, and then gets one reply line for
each command. Permissions are those at login. Commands that change the catalogue or the users take turns;
all others run side by side as Spark jobs of one session.
"""

from __future__ import annotations

import json
import logging
import signal
import socketserver
import threading
from collections.abc import Callable
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from latticework.operators import auth
from latticework.operators.management import STEP, Limiter
from latticework.plans.engine import Engine

log = logging.getLogger(__name__)

#: The management port lies this far above the port of the commands.
MANAGEMENT_OFFSET = 1000
LONGEST_LINE = 64 << 20


class Commands(socketserver.ThreadingTCPServer):
    """Serves an engine's commands."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, engine: Engine, limiter: Limiter, host: str = "127.0.0.1", port: int = 0) -> None:
        self.engine, self.limiter = engine, limiter
        super().__init__((host, port), Connection)

    def process_request(self, request, client_address) -> None:
        if self.limiter.acquire():
            super().process_request(request, client_address)
            return
        full = f"Server at maximum capacity ({self.limiter.most} connections). Please try again later."
        try:
            request.sendall(error(full))
        except OSError:
            log.info("a refused client had gone")
        self.shutdown_request(request)

    def process_request_thread(self, request, client_address) -> None:
        try:
            super().process_request_thread(request, client_address)
        finally:
            self.limiter.release()


def line_of(reply: dict) -> bytes:
    return json.dumps(reply).encode() + b"\n"


def error(message: str) -> bytes:
    return line_of({"status": "ERROR", "message": message})


class Connection(socketserver.StreamRequestHandler):
    server: Commands

    def login(self) -> auth.User | None:
        try:
            given = json.loads(self.rfile.readline(LONGEST_LINE))
            name, password = str(given["username"]), str(given["password"])
        except (ValueError, KeyError, TypeError):
            self.wfile.write(error("invalid login format"))
            return None
        try:
            user = self.server.engine.users.authenticate(name, password)
        except auth.AuthError as e:
            self.wfile.write(error(str(e)))
            return None
        self.wfile.write(line_of({"status": "OK", "user": {"username": user.username, "role": user.role, "permissions": user.permissions}}))
        return replace(user, permissions=dict(user.permissions))

    def handle(self) -> None:
        try:
            user = self.login()
            while user and (line := self.rfile.readline(LONGEST_LINE)):
                self.wfile.write(self.server.engine.reply(line.decode("utf-8", "replace"), user, text=True).encode() + b"\n")
        except ConnectionError:
            log.info("a client went away")


class Management(ThreadingHTTPServer):
    """Serves /health, /stats, /limit, /limit/increase and /limit/decrease. A new limit goes to `saved`."""

    def __init__(self, limiter: Limiter, host: str = "127.0.0.1", port: int = 0, saved: Callable[[Limiter], None] = lambda _: None) -> None:
        self.limiter, self.saved = limiter, saved
        super().__init__((host, port), Page)


class Page(BaseHTTPRequestHandler):
    server: Management

    def say(self, code: int, body: dict) -> None:
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def number(self, name: str) -> int | None:
        """The number of that name in the body; None if the body is no JSON object of the kind."""
        try:
            found = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            x = found.get(name, 0)
        except (ValueError, AttributeError):
            return None
        return x if isinstance(x, int) and not isinstance(x, bool) else None

    def change(self, change: Callable[[], None], more: Callable[[int], dict]) -> None:
        limiter, old = self.server.limiter, self.server.limiter.most
        try:
            change()
        except ValueError as e:
            self.say(400, {"status": "failed", "error": str(e), "current_limit": old, "active_connections": limiter.active})
            return
        self.server.saved(limiter)
        self.say(200, {"status": "success", "new_limit": limiter.most, **more(old)})

    def do_GET(self) -> None:
        limiter = self.server.limiter
        match self.path:
            case "/health":
                self.say(200, {"status": "healthy", "service": "latticework"})
            case "/stats":
                self.say(200, limiter.figures())
            case "/limit":
                self.say(200, {"current_limit": limiter.most, "active_connections": limiter.active})
            case _:
                self.other()

    def do_PUT(self) -> None:
        if self.path != "/limit":
            return self.other()
        limit = self.number("limit")
        if limit is None:
            return self.say(400, {"status": "failed", "error": "Invalid JSON"})
        return self.change(lambda: self.server.limiter.update(limit), lambda _: {"message": f"Connection limit updated to {limit}"})

    def do_POST(self) -> None:
        step = {"/limit/increase": ("increase", self.server.limiter.increase), "/limit/decrease": ("decrease", self.server.limiter.decrease)}.get(self.path)
        if step is None:
            return self.other()
        word, move = step
        by = self.number("amount")
        by = STEP if by is None else by
        limiter = self.server.limiter
        return self.change(lambda: move(by), lambda old: {"old_limit": old, f"{word}_amount": by, "message": f"Connection limit {word}d from {old} to {limiter.most}"})

    def other(self) -> None:
        known = self.path in ("/health", "/stats", "/limit", "/limit/increase", "/limit/decrease")
        self.say(405 if known else 404, {"error": "Method not allowed" if known else "not found"})

    def log_message(self, format: str, *args) -> None:
        log.debug(format, *args)


def on_signals(limiter: Limiter, saved: Callable[[Limiter], None] = lambda _: None) -> None:
    """SIGUSR1 raises the limit by a step, SIGUSR2 lowers it; what the limiter refuses changes nothing."""

    def move(change: Callable[[], None]) -> None:
        try:
            change()
            saved(limiter)
        except ValueError as e:
            log.warning("limit stays at %d: %s", limiter.most, e)

    signal.signal(signal.SIGUSR1, lambda *_: move(limiter.increase))
    signal.signal(signal.SIGUSR2, lambda *_: move(limiter.decrease))


def monitor(limiter: Limiter, stop: threading.Event, every: float = 30.0) -> None:
    """Logs the use of the slots until stopped; above four fifths as a warning."""
    while not stop.wait(every):
        log.log(logging.WARNING if limiter.warning() else logging.INFO, "connections: %d of %d", limiter.active, limiter.most)


def start(engine: Engine, limiter: Limiter, host: str = "127.0.0.1", port: int = 9090, management: int | None = None, saved: Callable[[Limiter], None] = lambda _: None) -> tuple[Commands, Management, threading.Event]:
    """Both servers, each with its thread, and the event that ends the monitor."""
    commands = Commands(engine, limiter, host, port)
    pages = Management(limiter, host, commands.server_address[1] + MANAGEMENT_OFFSET if management is None else management, saved)
    stop = threading.Event()
    for work in (commands.serve_forever, pages.serve_forever, lambda: monitor(limiter, stop)):
        threading.Thread(target=work, daemon=True).start()
    return commands, pages, stop
