import json
import subprocess

import pytest
from pyspark.sql import functions as F

from graphwright.operators import resolve, tables
from graphwright.plans import cypher, extract_queries, source_queries  # noqa: F401  register their queries
from graphwright.plans import queries as core
from graphwright.sources import code, dialects, files, history, manifests, records, schemas, sqltext
from graphwright.streaming import incremental

REPO = {
    "py/main.py": "from util import shared\n\n# NOTE: entry\ndef go():\n    return shared()\n\nclass Box:\n    def open(self):\n        return go()\n",
    "py/util.py": "def shared():\n    return 1\n",
    "rust/app.rs": "use crate::lib::helper;\n// runs\nfn run() {\n    helper();\n}\n",
    "rust/lib.rs": "pub fn helper() {}\n",
    "node_modules/x.js": "function no() {}\n",
    "key.pem": "secret",
    "skip/me.py": "x = 1\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, body in REPO.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return tmp_path


def test_discover(spark, tree):
    got = files.discover(spark, str(tree), patterns=["skip/"]).collect()
    assert {(r.path, r.language) for r in got} == {("py/main.py", "python"), ("py/util.py", "python"), ("rust/app.rs", "rust"), ("rust/lib.rs", "rust")}
    with_secret = files.discover(spark, str(tree), record_sensitive=True).filter("path = 'key.pem'").first()
    assert with_secret.content is None and len(with_secret.hash) == 64


def test_end_to_end(spark, tree):
    found = files.discover(spark, str(tree), patterns=["skip/"]).select("path", "language", F.col("content").cast("string").alias("text"))
    facts = code.facts(found).cache()
    nodes, edges, pending = code.graph_of(facts, "sample")
    names = {(r.kind, r.qualified_name) for r in nodes.collect()}
    assert {("function", "go"), ("class", "Box"), ("method", "Box::open"), ("function", "run"), ("function", "helper"), ("file", "py/main.py")} <= names
    assert nodes.filter("kind = 'comment'").count() == 1
    none = spark.createDataFrame([], "file string, name string, target_file string")
    links = resolve.resolve_names(pending, nodes, none, none.drop("name"))
    label = {r.id: r.name for r in nodes.collect()}
    assert {(label[r.anchor], label[r.target]) for r in links.collect()} == {("go", "shared"), ("run", "helper")}
    inside = {(label[r.src], label[r.dst]) for r in edges.filter("kind = 'calls'").collect()}
    assert inside == {("open", "go")}
    assert {(label[r.src], label[r.dst]) for r in edges.filter("kind = 'contains'").collect()} >= {("Box", "open"), ("main.py", "go")}


def test_registered_extractor(spark):
    code.register("toy", lambda path, text: [{"fact": "def", "kind": "function", "name": w, "start_line": 1, "end_line": 1} for w in text.split()])
    try:
        df = spark.createDataFrame([("a.toy", "toy", "one two")], "path string, language string, text string")
        assert {r.name for r in code.facts(df).collect()} == {"one", "two"}
    finally:
        code.EXTRACTORS.clear()


def test_facts_are_extracted_once(spark, tmp_path):
    """However often a graph reads them; and a file's facts stay together with those of others in a batch."""
    seen = str(tmp_path / "seen")

    def toy(path, text):
        with open(seen, "a") as f:
            f.write(path + "\n")
        return [{"fact": "def", "kind": "function", "name": text, "start_line": 1, "end_line": 2}, {"fact": "call", "name": "x", "start_line": 2}]

    code.register("toy", toy)
    try:
        df = spark.range(40).selectExpr("concat('f', id, '.toy') as path", "'toy' as language", "concat('n', id) as text")
        nodes, edges, pending = code.graph_of(code.facts(df), "r")
        assert nodes.count() == 80 and edges.count() == 40
        calls = pending.join(nodes.selectExpr("id as anchor", "name as caller"), "anchor").select("anchor_file", "caller").collect()
        assert {(r.anchor_file, r.caller) for r in calls} == {(f"f{i}.toy", f"n{i}") for i in range(40)}
    finally:
        code.EXTRACTORS.clear()
    with open(seen) as f:
        assert sorted(f.read().split()) == sorted(f"f{i}.toy" for i in range(40))


@pytest.mark.parametrize("name", ["g11_containment", "x1_callers_by_language", "x1_calls_by_span"])
def test_extracted_tables_are_not_broadcast(spark, name):
    """A few keys make many files: the size of the table with the keys says nothing about what is extracted."""
    plan = core.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def found(language, text, fact="endpoint"):
    return {(f["method"], f["path"], f["name"]) for d in dialects.DIALECTS.values() for f in d(language, text) if f["fact"] == fact}


def test_routes():
    axum = 'fn api() -> Router { Router::new().route("/users/:id", get(show).post(save)) }\nfn app() -> Router { Router::new().nest("/v1", api()) }\n'
    assert found("rust", axum) == {("GET", "/v1/users/:id", "show"), ("POST", "/v1/users/:id", "save")}
    assert found("rust", '#[utoipa::path(get, path = "/ping")]\nasync fn ping() {}\n') == {("GET", "/ping", "ping")}
    assert found("rust", 'let r = warp::path("a").and(warp::path("b")).and(warp::post()).and_then(h);') == {("POST", "/a/b", "h")}
    spring = '@RestController\n@RequestMapping("/api")\npublic class C {\n  @GetMapping("/x")\n  public String x() { return ""; }\n  @RequestMapping(value = "/y", method = RequestMethod.POST)\n  public String y() { return ""; }\n}\n'
    assert found("java", spring) == {("GET", "/api/x", "x"), ("POST", "/api/y", "y")}
    assert found("go", 'r.GET("/p/:id", handlers.Show)\n') == {("GET", "/p/:id", "Show")}
    flask = 'bp = Blueprint("b", __name__, url_prefix="/b")\n@bp.route("/x", methods=["GET", "POST"])\ndef x():\n    pass\napp.register_blueprint(bp, url_prefix="/v1")\napp.add_url_rule("/z", view_func=z)\n'
    assert found("python", flask) == {("GET", "/v1/b/x", "x"), ("POST", "/v1/b/x", "x"), ("GET", "/z", "z")}
    asp = '[Route("api/[controller]")]\npublic class UsersController {\n  [HttpGet("{id}")]\n  public User Get(int id) { }\n}\napp.MapPost("/m", Make);\n'
    assert found("csharp", asp) == {("GET", "/api/Users/{id}", "Get"), ("POST", "/m", "Make")}
    express = "const r = express.Router();\nr.get('/a', show);\napp.use('/base', r);\n"
    assert found("javascript", express) == {("GET", "/base/a", "show")}


def test_clients():
    js = 'const BASE = "/api";\nfetch(BASE + "/users/" + id, { method: "POST" });\nconst http = axios.create();\nhttp.delete(`/x/${id}`);\n'
    assert {(m, p) for m, p, _ in found("typescript", js, "client_call")} == {("POST", "/api/users/${dyn}"), ("DELETE", "/x/${id}")}
    assert {(m, p) for m, p, _ in found("rust", 'client.get("https://h/u").send();', "client_call")} == {("GET", "https://h/u")}
    assert {(m, p) for m, p, _ in found("go", 'http.Get("/u")\nhttp.NewRequest("PUT", "/w", nil)', "client_call")} == {("GET", "/u"), ("PUT", "/w")}
    assert {(m, p) for m, p, _ in found("python", 'requests.post(f"/u/{x}")\n@app.get("/no")\n', "client_call")} == {("POST", "/u/{x}")}
    assert {(m, p) for m, p, _ in found("kotlin", '@GET("users")\nfun users()', "client_call")} == {("GET", "/users")}
    assert {p for _, p, _ in found("javascript", "socket.emit('new_msg', x); socket.on('connect', f)", "ws_send")} == {"event:new_msg"}
    assert {p for _, p, _ in found("javascript", "gql`query Q { user(id: 1) { name } }`", "graphql_client")} == {"Query.user"}
    assert {p for _, p, _ in found("rust", "impl Greeter for S { async fn say_hello(&self, r: Request<A>) -> Result<Response<B>, Status> {} }", "grpc_server")} == {"Greeter/say_hello"}


def test_entities_and_queries():
    java = '@Entity\n@Table(name = "user_accounts")\npublic class UserAccount { }\ninterface Repo extends JpaRepository<UserAccount, Long> { UserAccount findByName(String n); }'
    facts = [f for d in dialects.DIALECTS.values() for f in d("java", java)]
    assert ("entity", "UserAccount", "user_accounts") in {(f["fact"], f["name"], f["target"]) for f in facts}
    assert ("db_read", "UserAccount") in {(f["fact"], f["target"]) for f in facts}
    alchemy = 'class User(Base):\n    __tablename__ = "users"\n    id = Column(Integer)\n    mail = mapped_column("email", String)\n'
    facts = {(f["fact"], f["name"], f["target"]) for d in dialects.DIALECTS.values() for f in d("python", alchemy)}
    assert facts == {("entity", "User", "users"), ("column", "id", "users"), ("column", "email", "users")}
    sql = {(f["fact"], f["target"]) for d in dialects.DIALECTS.values() for f in d("rust", 'sqlx::query!("INSERT INTO a SELECT * FROM b")')}
    assert sql == {("db_write", "a"), ("db_read", "b")}


ACCESS = [
    ("UPDATE ONLY users u SET a = (SELECT max(b) FROM t2) FROM t3, t4 WHERE 1", [("write", "users"), ("read", "t2"), ("read", "t3"), ("read", "t4")]),
    ("UPDATE a, b SET a.x = b.x", [("write", "a"), ("read", "b")]),
    ("DELETE FROM a USING b, c WHERE a.x IN (SELECT x FROM d)", [("write", "a"), ("read", "b"), ("read", "c"), ("read", "d")]),
    ("WITH a AS (SELECT * FROM t1), b (x) AS NOT MATERIALIZED (SELECT * FROM a JOIN t2 USING (id)) INSERT INTO t3 (c) SELECT * FROM b, a, t4", [("read", "t1"), ("read", "t2"), ("write", "t3"), ("read", "t4")]),
    ("WITH gone AS (DELETE FROM old RETURNING *) INSERT INTO log SELECT * FROM gone", [("write", "old"), ("write", "log")]),
    ("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = s.a WHEN NOT MATCHED THEN INSERT (a) VALUES (s.a)", [("write", "t"), ("read", "s")]),
    ("SELECT extract(year FROM ts), x IS DISTINCT FROM y, substring(a FROM 2) FROM logs l CROSS JOIN LATERAL (SELECT 1 FROM z) q, unnest(arr) u", [("read", "logs"), ("read", "z")]),
    ("CREATE TABLE n AS SELECT * FROM m", [("read", "m")]),
    ("(SELECT a FROM b) UNION ALL (SELECT c FROM d)", [("read", "b"), ("read", "d")]),
    ("INSERT INTO x VALUES (1) ON CONFLICT DO UPDATE SET y = 2", [("write", "x")]),
    ("SELECT * FROM a FOR UPDATE", [("read", "a")]),
    ("", []),
]


@pytest.mark.parametrize(("sql", "want"), ACCESS)
def test_sql_access(sql, want):
    assert sqltext.access(sql) == want


def test_sql():
    ddl = 'CREATE TABLE public."Users" (id INT PRIMARY KEY, org_id INT REFERENCES orgs(id), note TEXT DEFAULT \'a,b\', CONSTRAINT c UNIQUE (id)); -- x\nCREATE VIEW v AS SELECT * FROM public.users JOIN orgs ON true;'
    users, view = sqltext.tables(ddl)
    assert users["name"] == "public.users" and [c["name"] for c in users["columns"]] == ["id", "org_id", "note"] and users["refers"] == ["orgs"]
    assert view["kind"] == "view" and view["refers"] == ["orgs", "public.users"]
    assert sqltext.access("DELETE FROM a WHERE id IN (SELECT id FROM b); UPDATE ONLY c SET x = 'from d'") == [("write", "a"), ("read", "b"), ("write", "c")]
    assert sqltext.access("SELECT * FROM WHERE x") == []
    assert set(sqltext.cypher_labels("MATCH (a:Person)-[:KNOWS]->(b) CREATE (c:Event)")) == {("read", "Person"), ("read", "KNOWS"), ("write", "Event")}


def test_schemas(spark):
    openapi = json.dumps({"openapi": "3.0", "paths": {"/u/{id}": {"get": {}, "post": {}}, "/r": {"$ref": "x"}}})
    rows = [("openapi.json", openapi), ("swagger.yaml", "swagger: '2.0'\nbasePath: /v1\npaths:\n  /ping:\n    get:\n      summary: x\n"), ("a.proto", "package p;\nservice S {\n  rpc Do (A) returns (B);\n}\nmessage A {}\n"), ("s.graphql", "schema { query: Root }\ntype Root { user(id: ID!): User }\ntype Mutation { save: User }"), ("broken.graphql", "type"), ("openapi.yaml", "{not")]
    got = {(r.protocol, r.method, r.operation) for r in schemas.schema_operations(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("rest", "GET", "/u/{id}"), ("rest", "POST", "/u/{id}"), ("rest", "GET", "/ping"), ("grpc", None, "p.S/Do"), ("graphql", None, "Query.user"), ("graphql", None, "Mutation.save")}
    meta = {"sources": [{"tables": [{"table": {"schema": "public", "name": "u"}, "configuration": {"custom_root_fields": {"select": "users"}}}]}], "rest_endpoints": [{"url": "x", "methods": ["GET"]}]}
    ops = schemas.tracked_tables(json.dumps(meta))
    assert len(ops) == 8 and ("graphql", None, "Query.users") in ops and ("rest", "GET", "/api/rest/x") in ops


def test_schema_yaml_without_a_reader(monkeypatch):
    """The small reader of YAML: nested lists of mappings, flow values, quotes, comments."""
    monkeypatch.setattr(schemas, "_yaml", schemas.block_yaml)
    tables_ = "- table: posts\n- table: { name: tags, schema: public }  # bare\n  configuration:\n    custom_name: 'label'\n"
    assert {o for _, _, o in schemas.tracked_tables(tables_)} >= {"Query.posts", "Mutation.insert_label", "Subscription.label", "Query.label_by_pk"}
    meta = "version: 3\nsources:\n  - name: default\n    tables:\n      - table:\n          name: users\n          schema: public\nrest_endpoints:\n  - url: get_user\n    methods: [GET, POST]\nactions:\n- name: make\n  definition:\n    handler: \"{{BASE}}/m\"\nremote_schemas:\n  - name: pay\n"
    ops = schemas.tracked_tables(meta)
    assert len(ops) == 12 and {("rest", "POST", "/api/rest/get_user"), ("rest", "POST", "/m"), ("graphql", None, "Mutation.make"), ("graphql", None, "RemoteSchema.pay")} <= set(ops)
    spec = "paths:\n  /users:\n    get: {}\n    POST:\n      summary: 'a: b'\n  \"/users/{id}\":\n    parameters: []\n    delete: {}\n"
    assert schemas.openapi(spec) == [("rest", "GET", "/users"), ("rest", "POST", "/users"), ("rest", "DELETE", "/users/{id}")]
    assert [schemas.handler_path(x) for x in ("http://h:3000/x/y", "{{B}}/c", "/a", "none", "http://h")] == ["/x/y", "/c", "/a", None, None]
    with pytest.raises(ValueError, match="not a mapping"):
        schemas.block_yaml("plain text")


def test_manifests(spark):
    rows = [
        ("Cargo.toml", '[package]\nname = "a"\nkeywords = ["X", "y"]\ndescription = "d"\n[dependencies]\nserde = "1"\nb = { path = "b" }\nz = { package = "real", git = "u" }\n'),
        ("b/Cargo.toml", '[package]\nname = "b"\n'),
        ("package.json", '{"name": "n", "dependencies": {"react": "1"}}'),
        ("go.mod", "module m\nrequire (\n\tx.example/y v1.0.0\n\tz v2 // indirect\n)\n"),
        ("pyproject.toml", '[project]\nname = "p"\ndependencies = ["Numpy>=1"]\n'),
        ("x/App.csproj", '<Project><ItemGroup><PackageReference Include="N" Version="1"/><ProjectReference Include="..\\Lib\\Lib.csproj"/></ItemGroup></Project>'),
        ("bad/package.json", "{"),
    ]
    m = manifests.manifests(spark.createDataFrame(rows, "path string, text string"))
    assert {(r.ecosystem, r.name) for r in manifests.packages(m).collect()} == {("cargo", "a"), ("cargo", "b"), ("npm", "n"), ("go", "m"), ("python", "p"), ("dotnet", "App")}
    deps = {(r.ecosystem, r.name) for r in manifests.external_dependencies(m).collect()}
    assert {("cargo", "serde"), ("cargo", "real"), ("npm", "react"), ("python", "numpy"), ("dotnet", "N"), ("dotnet", "Lib")} <= deps and ("cargo", "b") not in deps
    d = manifests.digest(m).first()
    assert d.description == "d" and d.keywords == ["x", "y"]


def test_log(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=N", "-c", "user.email=n@x", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    for i in range(3):
        (tmp_path / f"f{i}").write_text("x\n" * (i + 1))
        git("add", ".")
        git("commit", "-qm", f"c{i}", "-m", "Co-authored-by: A <a@x>")
    spark.dataSource.register(history.GitLog)
    log = history.parse_log(spark.read.format("gitlog").option("repos", f"r={tmp_path}").load()).orderBy("ordinal").collect()
    assert [(r.subject, r.files, r.ordinal) for r in log] == [("c0", ["f0"], 1), ("c1", ["f1"], 2), ("c2", ["f2"], 3)]
    assert log[0].coauthors == ["A <a@x>"]
    later = history.parse_log(spark.read.format("gitlog").option("repos", f"r={tmp_path}").option("heads", f"r={log[1].hash}").load())
    assert [r.subject for r in later.collect()] == ["c2"]
    rewritten = spark.read.format("gitlog").option("repos", f"r={tmp_path}").option("heads", f"r={'0' * 40}").load()
    assert history.parse_log(rewritten).count() == 3
    (tmp_path / "f2").write_text("x\ny\nx\nz\n")
    (tmp_path / "f0").unlink()
    diff = history.parse_diff(git("diff", "--unified=0"))
    assert diff == [{"file": "f0", "deleted": True, "ranges": [{"start": 1, "end": 1}]}, {"file": "f2", "deleted": False, "ranges": [{"start": 2, "end": 2}, {"start": 4, "end": 4}]}]


def test_symbol_history(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "N")
    f = tmp_path / "a.py"
    for i, text in enumerate(["def f():\n    return 1\n", "def f():\n    return 2\n", "def f():\n    return 2\nx = 1\n"]):
        f.write_text(text)
        run("add", "-A")
        run("commit", "-q", "-m", f"c{i}", "--date", f"2020-01-0{i + 1}T00:00:00Z")
    run("checkout", "-q", "-b", "side", "HEAD~1")
    f.write_text("def f():\n    return 2\ndef g(): return f()\n")
    run("commit", "-q", "-am", "on side")
    run("checkout", "-q", "main")
    rows = history.symbol_history(spark, str(tmp_path), "a.py", "f(", "1,2").collect()
    assert sorted(r.subject for r in rows) == ["c0", "c1", "on side"]
    assert {r.subject: (r.in_head, r.branches) for r in rows}["on side"] == (False, ["side"])
    assert len(history.symbol_history(spark, str(tmp_path), "a.py", "f(").collect()) == 2


def test_config_layers():
    low = "a = 1\n[t]\nx = 1\ny = 1\n[[links]]\nn = 1\n"
    assert records.merged_config([low, "a = 2\n[t]\nx = 3\n[[links]]\nn = 2\n[[links]]\nn = 3\n", ""]) == {"a": 2, "t": {"x": 3, "y": 1}, "links": [{"n": 1}, {"n": 2}, {"n": 3}]}
    assert records.merged_config([]) == {}


def test_table_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_table(spark, path) is None
    for n in range(4):
        tables.write_table(spark.range(n), path)
        seen = tables.read_table(spark, path)
        assert seen.count() == n
    with pytest.raises(Exception, match="boom"):
        tables.write_table(spark.range(3).select(F.raise_error(F.lit("boom")).alias("id")), path)
    assert tables.read_table(spark, path).count() == 3
    assert sum(x.name.startswith("v-") for x in tmp_path.joinpath("t").iterdir()) == 3  # this one, the one before, and the failed one
    tables.write_table(spark.range(1), path)
    assert sum(x.name.startswith("v-") for x in tmp_path.joinpath("t").iterdir()) == 2


def test_upsert_writes_the_touched_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame([*x], "id string, v int")
    have = lambda: {tuple(r) for r in tables.read_table(spark, path).collect()}
    tables.write_table(rows(("a", 1), ("b", 1), ("c", 1)), path)
    tables.upsert_table(rows(("b", 2), ("b", 3)), path, ["id"], F.col("v"))
    assert have() == {("a", 1), ("b", 3), ("c", 1)}
    before = tables.current_folders(spark, path)
    tables.upsert_table(rows(("c", 5), ("d", 1)), path, ["id"], F.col("v"))
    after = tables.current_folders(spark, path)
    assert have() == {("a", 1), ("b", 3), ("c", 5), ("d", 1)}
    assert sum(after.get(k) == v for k, v in before.items()) == 2 and len(after) == 4
    fresh = str(tmp_path / "new")
    tables.upsert_table(rows(("a", 1)), fresh, ["id"])
    tables.upsert_table(rows(("a", 2)), fresh, ["id"])
    assert [tuple(r) for r in tables.read_table(spark, fresh).collect()] == [("a", 2)]


def test_nested_ignore_files(spark):
    rows = [(".gitignore", "*.log\n!keep.log\n/top/\n"), ("a.log", ""), ("keep.log", ""), ("sub/b.log", ""), ("sub/.aiignore", "secret*\n!b.log\n# c\n"), ("sub/secret.py", ""), ("secret.py", ""), ("top/x.py", ""), ("sub/top/y.py", "")]
    df = spark.createDataFrame([(p, t.encode()) for p, t in rows], "path string, content binary")
    got = {r.path for r in files.select_files(df).collect()}
    assert got == {".gitignore", "keep.log", "sub/b.log", "sub/.aiignore", "secret.py", "sub/top/y.py"}
    assert "keep.log" not in {r.path for r in files.select_files(df.filter("path <> '.gitignore'"), patterns=["*.log"]).collect()}


def test_watermarks(spark):
    log = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("s", 1, "c")], "repo string, ordinal int, hash string")
    heads = spark.createDataFrame([("r", "a"), ("s", "gone")], "repo string, head string")
    assert {r.hash for r in incremental.new_commits(log, heads).collect()} == {"b", "c"}
    assert {tuple(r) for r in incremental.saved_heads(log).collect()} == {("r", "b"), ("s", "c")}


def test_journal(spark):
    lines = spark.createDataFrame([('{"key": "a", "v": 1}', 1), ('{"key": "a", "v": 2}', 2), ('{"key": "b", "v"', 3)], "value string, ordinal int")
    assert [tuple(r) for r in incremental.replay_journal(lines, "key string, v int").collect()] == [("a", 2)]


def test_stream_upsert_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int").write.parquet(src)
    for n in range(2):
        stream = spark.readStream.schema("id string, v int").parquet(src)
        incremental.upsert_stream(spark, stream, out, ["id"], str(tmp_path / f"cp{n}"), "v").awaitTermination()
    spark.createDataFrame([("b", 5)], "id string, v int").write.mode("append").parquet(src)
    incremental.upsert_stream(spark, spark.readStream.schema("id string, v int").parquet(src), out, ["id"], str(tmp_path / "cp1"), "v").awaitTermination()
    assert {tuple(r) for r in tables.read_table(spark, out).collect()} == {("a", 1), ("b", 5)}


def test_update_graph(spark):
    n = spark.createDataFrame([("1", "a.py"), ("2", "b.py"), ("3", "c.py")], "id string, file string")
    e = spark.createDataFrame([("1", "2", "calls", "extracted"), ("3", "1", "calls", "extracted")], "src string, dst string, kind string, confidence string")
    old = spark.createDataFrame([("a.py", "x"), ("b.py", "x"), ("c.py", "x")], "path string, hash string")
    now = spark.createDataFrame([("a.py", "x"), ("b.py", "y")], "path string, hash string")
    nodes, edges, files_ = incremental.update_graph(n, e, old, now, spark.createDataFrame([("2", "b.py")], n.schema), spark.createDataFrame([("2", "1", "calls", "inferred")], e.schema))
    assert {r.id for r in nodes.collect()} == {"1", "2"} and {(r.src, r.dst) for r in edges.collect()} == {("2", "1")}
    assert incremental.nothing_to_do(now, now, "r1", "r1") and not incremental.nothing_to_do(old, now, "r1", "r1")


def test_records(spark, tmp_path):
    p = tmp_path / "w.json"
    p.write_text(json.dumps({"data": [{"range": {"date": "2024-01-01"}, "grand_total": {"total_seconds": 60}, "projects": [{"name": "a", "total_seconds": 60.0}]}]}))
    assert {tuple(r) for r in records.tracked_time(spark, str(p)).collect()} == {("2024-01-01", "projects", "a", 60), ("2024-01-01", "total", "total", 60)}
    q = tmp_path / "e.json"
    q.write_text('{"node_id": "a", "space": "s", "model": "m", "dim": 2, "vector": [1, 2]}\n{"node_id": "b", "space": "s", "model": "m", "dim": 1, "vector": [1]}\n')
    with pytest.raises(Exception, match="different lengths"):
        records.read_embeddings(spark, str(q)).collect()
    assert records.readme_paragraph("# T\n\n[![x](y)](z)\n\nA [tool](u) for\nthings.\n\nMore.") == "A tool for things."


GRAPH_NODES = [("1", "function", "a", "x.py"), ("2", "function", "b", "x.py"), ("3", "class", "c", "y.py"), ("4", "function", "d", "y.py")]
GRAPH_EDGES = [("1", "2", "calls"), ("2", "4", "calls"), ("4", "3", "extends")]


@pytest.mark.parametrize(
    "query, rows",
    [
        ("MATCH (a:Function)-[r:calls]->(b) RETURN a.name AS x, b.name AS y ORDER BY x", [("a", "b"), ("b", "d")]),
        ("MATCH (a {name: 'a'})-[:calls*1..3]->(b) RETURN b.name AS n ORDER BY n", [("b",), ("d",)]),
        ("MATCH (a)<-[:calls]-(b) WHERE b.name = $x RETURN a.id AS i", [("2",)]),
        ("MATCH (a) WHERE a.name CONTAINS 'a' OR a.file STARTS WITH 'y' RETURN a.name AS n ORDER BY n DESC LIMIT 2", [("d",), ("c",)]),
        ("MATCH (a) RETURN a.kind AS k, count(*) AS n ORDER BY n DESC, k", [("function", 3), ("class", 1)]),
        ("MATCH (a:Function) OPTIONAL MATCH (a)-[:extends]->(b:Class) RETURN a.name AS n, b.name AS c ORDER BY n", [("a", None), ("b", None), ("d", "c")]),
        ("MATCH (a), (b) WHERE a.file = b.file AND a.id <> b.id RETURN count(a) AS n", [(4,)]),
        ("MATCH (a) WHERE a.id IN ['1', '3'] RETURN DISTINCT a.file AS f ORDER BY f", [("x.py",), ("y.py",)]),
        ("MATCH (a) WHERE NOT lower(a.name) ENDS WITH 'a' RETURN a.name AS n ORDER BY n SKIP 1 LIMIT 1", [("c",)]),
    ],
)
def test_cypher(spark, query, rows):
    n = spark.createDataFrame(GRAPH_NODES, "id string, kind string, name string, file string").withColumn("qualified_name", F.col("name"))
    e = spark.createDataFrame(GRAPH_EDGES, "src string, dst string, kind string").withColumn("confidence", F.lit("extracted"))
    assert [tuple(r) for r in cypher.run(n, e, query, {"x": "a"}).collect()] == rows


@pytest.mark.parametrize("query", ["RETURN 1", "MATCH (a)-[*]->(b) RETURN a", "MATCH (a) RETURN a.name; DROP", "MATCH (a) WHERE a.x = $none RETURN a"])
def test_cypher_outside_subset(query):
    with pytest.raises(cypher.CypherError):
        cypher.translate(query)
