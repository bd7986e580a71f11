import io
import json

from lamina.plans.server import LONGEST, Server
from lamina.plans.tools import RESOURCES, TOOLS, Engine


def test_frames(spark, tmp_path):
    server = Server(Engine(spark, str(tmp_path / "data")))
    call = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    frames = [
        call(1, "initialize"), "", call(2, "tools/list"), call(3, "resources/list"), call(4, "tools/call", name="remember", arguments={"content": "x y"}),
        call(5, "tools/call", name="recall", arguments={"query": "x y", "limit": 500}), call(6, "resources/read", uri="memory://stats?x=1"), call(7, "nothing"),
        "{broken", json.dumps({"jsonrpc": "2.0", "method": "ping"}), call(8, "tools/call", name="absent"), call(9, "resources/read", uri="memory://context"), "x" * (LONGEST + 1),
        json.dumps([1]),
    ]
    out = io.StringIO()
    server.serve(io.StringIO("\n".join(frames) + "\n"), out)
    replies = {}
    errors = []
    for line in out.getvalue().splitlines():
        r = json.loads(line)
        replies[r["id"]] = r
        errors += [r["error"]["code"]] if r["id"] is None else []
    assert len(replies[2]["result"]["tools"]) == len(TOOLS) == 13
    schema = next(t for t in replies[2]["result"]["tools"] if t["name"] == "remember")["inputSchema"]
    assert schema["required"] == ["content"] and schema["properties"]["type"] == {"type": "string"} and "kind" not in schema["properties"]
    assert len(replies[3]["result"]["resources"]) == len(RESOURCES) == 5
    assert "id" in json.loads(replies[4]["result"]["content"][0]["text"])
    assert replies[5]["error"]["code"] == -32602
    assert json.loads(replies[6]["result"]["contents"][0]["text"])["memories"]["semantic"] == 1
    assert replies[7]["error"]["code"] == -32601 and replies[8]["error"]["code"] == -32601
    assert errors == [-32700, -32600, -32600]
    assert json.loads(replies[9]["result"]["contents"][0]["text"])["max_tokens"] == 4000
    kinds = [r["kind"] for r in Engine(spark, str(tmp_path / "data")).events().orderBy("created_at").collect()]
    assert kinds[0] == "session_start" and kinds[-1] == "session_end"


def test_an_endless_line_is_not_held(monkeypatch):
    from lamina.plans import server

    monkeypatch.setattr(server, "LONGEST", 10)
    frames = list(Server._frames(io.StringIO("a" * 10 + "\n" + "b" * 11 + "\n" + "c" * 5000 + "\nd\n" + "e" * 12)))
    assert [(line.strip()[:3], whole) for line, whole in frames] == [("aaa", True), ("bbb", False), ("ccc", False), ("d", True), ("eee", False)]
    assert max(len(line) for line, _ in frames) == 11


def test_command_line(spark, tmp_path, capsys):
    from lamina import cli

    data = str(tmp_path / "data")
    assert cli.main(["--data", data, "init"]) == 0
    assert cli.main(["--data", data, "stats"]) == 0
    assert json.loads(capsys.readouterr().out)["memories"]["semantic"] == 0
    assert cli.main(["--data", data, "export", "--format", "ndjson"]) == 0
    assert cli.main(["--data", data, "inspect", "none"]) == 1
    assert cli.main(["--data", data, "backup", str(tmp_path / "b.tgz")]) == 0
    assert cli.main(["--data", data, "restore", str(tmp_path / "b.tgz"), "--force"]) == 0
    assert cli.main(["--data", data, "stop"]) == 0
