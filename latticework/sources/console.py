"""Lines of a command console as commands, the client that sends them, and the entry point of the server.

    python -m latticework.sources.console serve ROOT --admin-password ... [--port 9090] [--limit 1000]
    python -m latticework.sources.console connect --username ... --password ... [--port 9090]
"""

from __future__ import annotations

import argparse
import json
import socket
import sys


class Refused(ValueError):
    pass


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise Refused(message)


def permissions(text: str) -> dict[str, str]:
    """space=read,other=write"""
    return dict(x.split("=", 1) for x in text.split(",") if "=" in x)


def grammar() -> Parser:
    top = Parser(prog="", add_help=False)
    verbs = top.add_subparsers(dest="verb", required=True, parser_class=Parser)

    def verb(name: str, *words: str) -> Parser:
        p = verbs.add_parser(name, add_help=False, prefix_chars="~")  # values may begin with a minus
        for w in words:
            p.add_argument(w)
        return p

    for name, words in (("use", ("space",)), ("delete-space", ("data",)), ("list-spaces", ()), ("put", ("key", "value")), ("get", ("key",)), ("delete", ("key",)),
                        ("insert-vector", ("key", "value")), ("get-vector", ("key",)), ("get-user", ("data",)), ("delete-user", ("username",)), ("update-user-password", ("username", "password")),
                        ("update-user-role", ("username", "role"))):
        verb(name, *words)
    verb("search-topk", "value").add_argument("dimension", type=int)
    verb("range-search", "value").add_argument("radius", type=float)
    verb("update-user-permissions", "username").add_argument("permissions", type=permissions)
    user = verb("create-user", "username", "password")
    user.add_argument("role", nargs="?", default="user")
    user.add_argument("permissions", nargs="?", type=permissions, default={})
    space = verbs.add_parser("create-space", add_help=False)
    space.add_argument("space")
    space.add_argument("--engine", dest="engine_type", default="key-value")
    space.add_argument("--dimension", type=int, default=0)
    space.add_argument("--index-type", default="Flat")
    space.add_argument("--metric", default="L2")
    space.add_argument("--enable-wal", action="store_true", default=None)
    space.add_argument("--disable-wal", dest="enable_wal", action="store_false")
    return top


GRAMMAR = grammar()
USER_VERBS = ("create-user", "update-user-password", "update-user-role", "update-user-permissions")
#: Verbs that work in the space in use.
IN_SPACE = ("put", "get", "delete", "insert-vector", "search-topk", "get-vector", "range-search")


def command(line: str, space: str = "") -> dict:
    """The command of a line; words are divided by white space, so values have none."""
    words = line.split()
    found = vars(GRAMMAR.parse_args([w.lower() if i == 0 else w for i, w in enumerate(words)]))
    verb = found.pop("verb")
    out = {"type": "USE_SPACE" if verb == "use" else "LIST_SPACES" if verb == "list-spaces" else verb.upper().replace("-", "_")}
    if verb in USER_VERBS:
        return out | {"new_user": found}
    if verb == "delete-user":
        return out | {"delete_user": found}
    if verb == "create-space":
        if found["engine_type"] == "vector" and found["dimension"] <= 0:
            raise Refused("a vector space needs --dimension N")
        if found["enable_wal"] is None:
            found["enable_wal"] = found["engine_type"] == "key-value"
    if verb in IN_SPACE:
        if not space:
            raise Refused("no space in use; say: use NAME")
        out["space"] = space
    return out | found


class Client:
    """A connection that is logged in."""

    def __init__(self, host: str, port: int, username: str, password: str) -> None:
        self.socket = socket.create_connection((host, port))
        self.lines = self.socket.makefile("rwb")
        self.space = ""
        self.user = self.ask({"username": username, "password": password})
        if self.user["status"] != "OK":
            self.close()
            raise PermissionError(self.user["message"])

    def ask(self, message: dict) -> dict:
        try:
            self.lines.write(json.dumps(message).encode() + b"\n")
            self.lines.flush()
        except BrokenPipeError:
            pass  # the server may have said why before it closed
        line = self.lines.readline()
        if not line:
            raise ConnectionError("the server closed the connection")
        return json.loads(line)

    def run(self, line: str) -> dict:
        """The reply to a console line; `use NAME` sets the space of the lines after it."""
        q = command(line, self.space)
        reply = self.ask(q)
        if q["type"] == "USE_SPACE" and reply["status"] == "OK":
            self.space = q["space"]
        return reply

    def close(self) -> None:
        self.lines.close()
        self.socket.close()


def connect(args: argparse.Namespace) -> None:
    client = Client(args.host, args.port, args.username, args.password)
    for line in sys.stdin:
        if line.strip() in ("quit", "exit"):
            break
        if line.strip():
            try:
                reply = client.run(line)
                print(reply.get("value", reply.get("message")) if reply["status"] == "OK" else f"ERROR: {reply['message']}", flush=True)
            except Refused as e:
                print(f"ERROR: {e}", flush=True)
    client.close()


def serve(args: argparse.Namespace) -> None:
    from pyspark.sql import SparkSession

    from latticework.operators.management import Limiter
    from latticework.plans.engine import Engine
    from latticework.sources import service

    spark = SparkSession.builder.appName("latticework").getOrCreate()
    where = f"{args.root.rstrip('/')}/limit"
    limiter = Limiter.load(spark, where, args.limit)
    save = lambda x: x.save(spark, where)
    service.on_signals(limiter, save)
    engine = Engine(spark, args.root, args.admin_password, probes=args.probes)
    commands, _, stop = service.start(engine, limiter, args.host, args.port, saved=save)
    print(f"listening on {commands.server_address}", flush=True)
    try:
        while not stop.wait(3600):
            pass
    except KeyboardInterrupt:
        stop.set()
        commands.shutdown()
    finally:
        engine.close()


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="latticework", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = top.add_subparsers(required=True)
    for name, work, options in (("serve", serve, ("--admin-password",)), ("connect", connect, ("--username", "--password"))):
        p = verbs.add_parser(name)
        p.set_defaults(work=work)
        p.add_argument("--host", default="127.0.0.1")
        p.add_argument("--port", type=int, default=9090)
        for o in options:
            p.add_argument(o, required=True)
        if name == "serve":
            p.add_argument("root")
            p.add_argument("--limit", type=int, default=1000, help="where no limit is saved")
            p.add_argument("--probes", type=int, help="lists that a search of an index space reads; without, searches are exact")
    args = top.parse_args(argv)
    args.work(args)


if __name__ == "__main__":
    main()
