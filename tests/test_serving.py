import json
import threading
import urllib.error
import urllib.request

import pytest

from graphwright import serving
from graphwright.engine import Engine


@pytest.fixture(scope="module")
def engine(spark):
    nodes = spark.createDataFrame([("r", i, "function", n, n, "a.py", "python", 1, 2, None, None) for i, n in (("1", "main"), ("2", "helper"), ("3", "other"))], "repo string, id string, kind string, name string, qualified_name string, file string, language string, start_line int, end_line int, doc string, signature string")
    edges = spark.createDataFrame([("1", "2", "calls", "extracted"), ("3", "2", "calls", "inferred")], "src string, dst string, kind string, confidence string")
    return Engine(nodes, edges)


def test_service(engine):
    s = serving.Service(engine, rows=1)
    found = s.call("callers", {"name": "helper"})
    assert found["more"] and len(found["rows"]) == 1 and "confidence" in found["columns"]
    assert s.call("definition", {"name": "main"})["rows"][0]["id"] == "1"
    answers = [json.loads(x) for x in s.lines(['{"jsonrpc": "2.0", "id": 1, "method": "initialize"}', '{"jsonrpc": "2.0", "method": "notifications/initialized"}', '{"jsonrpc": "2.0", "id": 2, "method": "tools/list"}',
        '{"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "callees", "arguments": {"name": "main"}}}', '{"id": 4, "method": "tools/call", "params": {"name": "callees", "arguments": {"nome": "x"}}}',
        '{"id": 5, "method": "tools/call", "params": {"name": "rm"}}', '{"id": 6, "method": "nope"}', "{"])]
    assert [a["id"] for a in answers] == [1, 2, 3, 4, 5, 6, None]
    assert {t["name"] for t in answers[1]["result"]["tools"]} == set(serving.VERBS)
    assert json.loads(answers[2]["result"]["content"][0]["text"])["rows"][0]["id"] == "2"
    assert answers[3]["result"]["isError"] and all("error" in a for a in answers[4:])


def test_http(engine):
    server = serving.server(engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        get = lambda path, body=None: json.load(urllib.request.urlopen(urllib.request.Request(base + path, body and json.dumps(body).encode()), timeout=60))
        assert {r["id"] for r in get("/callers?name=helper")["rows"]} == {"1", "3"}
        assert [r["id"] for r in get("/search", {"query": "MAIN", "limit": 5})["rows"]] == ["1"]
        assert len(get("/")["verbs"]) == len(serving.VERBS)
        assert get("/rpc", {"id": 1, "method": "ping"})["result"] == {}
        for path, status in (("/nothing", 404), ("/callers?nome=x", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path)
            assert e.value.code == status
    finally:
        server.shutdown()
