import json
import os
import signal
import socket
import threading
import urllib.error
import urllib.request

import pytest

from latticework.operators.management import Limiter
from latticework.plans.engine import Engine
from latticework.sources import console, service


@pytest.fixture
def running(spark, tmp_path):
    saved = []
    engine, limiter = Engine(spark, str(tmp_path), "secret"), Limiter(3)
    commands, pages, stop = service.start(engine, limiter, port=0, management=0, saved=lambda x: saved.append(x.most))
    yield commands, pages, limiter, saved
    stop.set()
    for server in (commands, pages):
        server.shutdown()
        server.server_close()


def client(commands, username="admin", password="secret"):
    return console.Client("127.0.0.1", commands.server_address[1], username, password)


def http(pages, method, path, body=None):
    data = body if isinstance(body, bytes) else None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(f"http://127.0.0.1:{pages.server_address[1]}{path}", data, method=method)
    try:
        with urllib.request.urlopen(request, timeout=20) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_console_session(running):
    commands, _, limiter, _ = running
    c = client(commands)
    run = lambda line: c.run(line)
    assert c.user["user"] == {"username": "admin", "role": "admin", "permissions": {}} and limiter.active == 1
    assert run("create-space kv")["message"] == "SPACE_CREATED"
    assert run("CREATE-SPACE v --engine vector --dimension 2")["message"] == "SPACE_CREATED"
    assert json.loads(run("list-spaces")["message"]) == {"status": "OK", "spaces": ["kv", "v"]}
    with pytest.raises(console.Refused):
        run("put a 1")
    assert run("use nothing")["message"] == "space does not exist"
    run("use kv")
    assert run("put a 1")["message"] == "OK" and run("get a")["value"] == "1" and run("delete a")["message"] == "DELETED"
    assert run("get a") == {"status": "ERROR", "message": "key not found"}
    run("use v")
    for line in ("insert-vector 1 1,0", "insert-vector 10 -1,0", "insert-vector 9 -1,0", "insert-vector -3 0,5"):
        assert run(line)["message"] == "VECTOR_INSERTED"
    assert run("search-topk -1,0 2")["message"] == '[{"id": 9, "distance": 0.000000}, {"id": 10, "distance": 0.000000}]'
    assert [h["id"] for h in json.loads(run("range-search 0,0 2")["message"])] == [1, 9, 10]
    assert run("range-search 90,0 1")["message"] == "[]"
    assert run("get-vector -3")["message"] == "0.000000,5.000000"
    assert run("create-user ann pw user kv=read")["message"] == "USER_CREATED"
    other = client(commands, "ann", "pw")
    other.run("use kv")
    assert other.run("put a 1")["status"] == "ERROR" and other.run("get a")["message"] == "key not found"
    assert run("update-user-permissions ann kv=write,v=read")["status"] == "OK"
    assert other.run("put a 1")["status"] == "ERROR"  # permissions are those at login
    other.close()
    again = client(commands, "ann", "pw")
    again.run("use kv")
    assert again.run("put a 1")["message"] == "OK"
    again.close()
    assert run("delete-user ann")["message"] == "USER_DELETED"
    assert json.loads(c.ask(["no", "command"]).get("message", "null") and '"error"') == "error"
    c.close()


def test_logins_that_fail(running):
    commands, _, _, _ = running
    for user, said in (("admin", "invalid password"), ("nobody", "user not found")):
        with pytest.raises(PermissionError, match=said):
            client(commands, user, "wrong")
    with socket.create_connection(("127.0.0.1", commands.server_address[1])) as s, s.makefile("rwb") as f:
        f.write(b"no json\n")
        f.flush()
        assert json.loads(f.readline())["message"] == "invalid login format"


def test_capacity_and_release(running):
    commands, pages, limiter, _ = running
    held = [client(commands) for _ in range(3)]
    with pytest.raises(PermissionError, match=r"maximum capacity \(3 connections\)"):
        client(commands)
    assert http(pages, "PUT", "/limit", {"limit": 2})[0] == 400 and http(pages, "PUT", "/limit", {"limit": 4})[0] == 200
    held.append(client(commands))
    for c in held:
        c.close()
    done = threading.Event()
    for _ in range(100):
        if limiter.active == 0:
            break
        done.wait(0.05)
    assert limiter.active == 0


def test_management_pages(running):
    _, pages, limiter, saved = running
    assert http(pages, "GET", "/health")[1]["status"] == "healthy"
    assert http(pages, "GET", "/stats")[1] == {"active_connections": 0, "max_connections": 3, "usage_percentage": 0, "available_slots": 3}
    assert http(pages, "POST", "/limit/increase", b"not json")[1] | {"message": ""} == {"status": "success", "old_limit": 3, "new_limit": 103, "increase_amount": 100, "message": ""}
    assert http(pages, "POST", "/limit/decrease", {"amount": 3})[1]["new_limit"] == 100
    assert http(pages, "POST", "/limit/decrease", {"amount": 100})[0] == 400 and limiter.most == 100
    assert http(pages, "PUT", "/limit", {"limit": 7})[1]["new_limit"] == 7 and http(pages, "PUT", "/limit", b"[]")[0] == 400
    assert http(pages, "GET", "/limit")[1] == {"current_limit": 7, "active_connections": 0}
    assert http(pages, "GET", "/limit/increase")[0] == 405 and http(pages, "POST", "/health")[0] == 405 and http(pages, "GET", "/x")[0] == 404
    assert saved == [103, 100, 7]


def test_signals():
    before = [signal.getsignal(s) for s in (signal.SIGUSR1, signal.SIGUSR2)]
    limiter = Limiter(150)
    try:
        service.on_signals(limiter)
        os.kill(os.getpid(), signal.SIGUSR1)
        assert limiter.most == 250
        for want in (150, 50, 50):  # the last would leave less than nothing
            os.kill(os.getpid(), signal.SIGUSR2)
            assert limiter.most == want
    finally:
        for s, h in zip((signal.SIGUSR1, signal.SIGUSR2), before, strict=True):
            signal.signal(s, h)


def test_console_grammar():
    assert console.command("create-space v --engine vector --dimension 8 --metric L1 --index-type IVF32") == {"type": "CREATE_SPACE", "space": "v", "engine_type": "vector", "dimension": 8, "index_type": "IVF32", "metric": "L1", "enable_wal": False}
    assert console.command("create-space k")["enable_wal"] is True and console.command("create-space k --disable-wal")["enable_wal"] is False
    assert console.command("put k -v", "s") == {"type": "PUT", "space": "s", "key": "k", "value": "-v"}
    for bad in ("", "nothing", "put k", "search-topk 1,2 x", "create-space v --engine vector"):
        with pytest.raises(console.Refused):
            console.command(bad, "s")
