import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphwright.operators import api, atlas, impact, resolve, tables, traverse
from graphwright.operators.graph import Graph, changed_symbols, innermost, preceding

RANK = {"extracted": 2, "inferred": 1}


def queue_impact(edges, seeds, ways, depth, floor):
    """Impact by a queue, one node at a time."""
    best = {s: (0, 2, ()) for s in seeds}
    todo = deque(sorted(set(seeds)))
    while todo:
        at = todo.popleft()
        d, conf, path = best[at]
        if d == depth:
            continue
        steps = sorted({(s if way == "in" else t, k, c) for s, t, k, c in edges for kind, way in ways if k == kind and (t if way == "in" else s) == at})
        for to, kind, c in steps:
            r = min(conf, RANK[c])
            if to in seeds or r < floor:
                continue
            if to not in best:
                best[to] = (d + 1, r, (*path, kind))
                todo.append(to)
            elif (best[to][0], -best[to][1]) > (d + 1, -r):
                best[to] = (d + 1, r, (*path, kind))
    return {n: x for n, x in best.items() if n not in seeds}


@pytest.mark.parametrize("seed", range(4))
def test_impact_equals_queue(spark, seed):
    rnd = random.Random(seed)
    kinds = ["calls", "references", "invokes", "handles"]
    edges = sorted({(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}", rnd.choice(kinds)) for _ in range(40)})
    edges = [(*e, rnd.choice(["extracted", "inferred"])) for e in edges]
    seeds = {f"n{rnd.randrange(14)}" for _ in range(2)}
    floor = ["inferred", "extracted"][seed % 2]
    df = spark.createDataFrame(edges, "src string, dst string, kind string, confidence string")
    got = traverse.impact(df, spark.createDataFrame([(s,) for s in seeds], "id string"), traverse.CROSS_BOUNDARY, 4, floor).collect()
    want = queue_impact(edges, seeds, traverse.rules(traverse.CROSS_BOUNDARY), 4, RANK[floor])
    assert {r.id: (r.distance, RANK[r.min_confidence], tuple(r.path)) for r in got} == want


def test_unknown_edge_set():
    with pytest.raises(ValueError):
        traverse.rules(["nothing"])


def test_reachable_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string").withColumn("kind", F.lit("calls"))
    got = traverse.reachable(e, spark.createDataFrame([("a",)], "id string"), "calls", True, 2).collect()
    assert {(r.id, r.distance) for r in got} == {("b", 1), ("c", 2)}


def test_levels(spark):
    rows = spark.createDataFrame([(0, 0, 0), (3, 0, 0), (12, 0, 0), (3, 1, 0), (60, 0, 0), (60, 0, 2)], "t int, a int, c int")
    names = [r[0] for r in rows.select(impact.level_name(impact.level(F.col("t"), F.col("a"), F.col("c")))).collect()]
    assert names == ["none", "low", "medium", "high", "high", "critical"]


@pytest.mark.parametrize(
    "kind, file, name, wanted",
    [("function", "src/tests/x.rs", "f", "test"), ("endpoint", "tests/x.py", "f", "test"), ("endpoint", "a.py", "f", "api"), ("function", "a.rs", "x::main", "entrypoint"), ("struct", "a.rs", "main", "internal"), ("method", "a/b.spec.ts", "f", "test"), ("function", "latest/x.rs", "f", "internal"), ("function", "a.rs", "tests::f", "test")],
)
def test_classes(spark, kind, file, name, wanted):
    row = spark.createDataFrame([(kind, file, name)], "k string, f string, q string")
    assert row.select(impact.classify(F.col("k"), F.col("f"), F.col("q"))).first()[0] == wanted


def nodes(spark, rows):
    full = [(i, k, n, q, f, s, e) for i, k, n, q, f, s, e in rows]
    df = spark.createDataFrame(full, "id string, kind string, name string, qualified_name string, file string, start_line int, end_line int")
    return df.withColumns({"repo": F.lit("r"), "language": F.lit(None).cast("string"), "doc": F.lit(None).cast("string"), "signature": F.lit(None).cast("string")})


NODES = [("1", "function", "parse", "p::parse", "src/a.rs", 1, 9), ("2", "method", "parse_all", "p::P::parse_all", "src/a.rs", 3, 5), ("3", "function", "go", "go", "src/b.rs", 1, 4), ("4", "module", "parse", "parse", "", None, None)]


def test_search_and_lookup(spark):
    e = spark.createDataFrame([("1", "2", "calls", "inferred"), ("1", "2", "calls", "extracted"), ("3", "1", "calls", "extracted")], "src string, dst string, kind string, confidence string")
    g = Graph(nodes(spark, NODES), e)
    assert [r.id for r in g.search("PARSE").collect()] == ["1", "2"]
    assert g.search("PARSE", case_sensitive=True).count() == 0
    assert [r.id for r in g.find_by_name("p::parse").collect()] == ["1"]
    assert [(r.id, r.confidence) for r in g.around("parse", None, True).collect()] == [("2", "extracted")]
    assert g.export([], None)[0].count() == 0
    assert g.subgraph(g.nodes.filter("id in ('1', '2')"))[1].count() == 2


def test_span_joins(spark):
    n = nodes(spark, NODES)
    spans = n.filter("start_line is not null").selectExpr("file", "id", "start_line as start", "end_line as end")
    sites = spark.createDataFrame([("src/a.rs", 4), ("src/a.rs", 8), ("src/a.rs", 20), ("src/b.rs", 1)], "file string, at int").withColumn("site", F.col("at"))
    assert {(r.file, r.site, r.id) for r in innermost(sites, spans).collect()} == {("src/a.rs", 4, "2"), ("src/a.rs", 8, "1"), ("src/b.rs", 1, "3")}
    assert {(r.site, r.id) for r in preceding(sites, spans).filter("file = 'src/a.rs'").collect()} == {("4", "2"), ("8", "2"), ("20", "2")}
    changes = spark.createDataFrame([("src/a.rs", False, [(8, 8)]), ("src/b.rs", True, []), ("src/c.rs", False, [(1, 2)])], "file string, deleted boolean, ranges array<struct<start:int,end:int>>")
    assert {(r.file, r.id, r.outcome) for r in changed_symbols(changes, n).collect()} == {("src/a.rs", "1", "seed"), ("src/b.rs", None, "removed"), ("src/c.rs", None, "unresolved")}


def ops(spark, rows):
    return spark.createDataFrame(rows, "node_id string, repo string, kind string, protocol string, method string, path string")


def test_matching(spark):
    o = ops(spark, [("e1", "a", "endpoint", "rest", "GET", "/api/users/{id}"), ("e2", "a", "endpoint", "rest", "GET", "/users/{id}"), ("c1", "b", "client_call", "rest", "GET", "/users/7"), ("c2", "b", "client_call", "rest", "GET", "/api/users/7"), ("c3", "b", "client_call", "rest", "POST", "/users/7"), ("c4", "b", "client_call", "rest", "GET", "/${dyn}")])
    exact = {(r.src, r.dst, r.confidence) for r in api.invokes(o, gateways=["/api"]).collect()}
    assert exact == {("c1", "e2", "extracted"), ("c2", "e1", "extracted")}
    only = {(r.src, r.dst, r.confidence) for r in api.invokes(o.filter("node_id <> 'e2'"), gateways=["/api"]).collect()}
    assert only == {("c1", "e1", "inferred"), ("c2", "e1", "extracted")}
    calls = api.invokes(o)
    edges = spark.createDataFrame([("f", "c3", "calls", "extracted")], "src string, dst string, kind string, confidence string")
    assert {(r.node_id, r.caller, r.reason) for r in api.unmatched_clients(o, calls, edges).collect()} == {("c3", "f", "no endpoint"), ("c4", None, "dynamic path")}
    assert {(r.client, r.endpoint) for r in api.web_links(o).collect()} == {("c1", "e2"), ("c2", "e1")}


def test_drift(spark):
    o = ops(spark, [("e1", "a", "endpoint", "rest", "GET", "/x"), ("e2", "a", "endpoint", "rest", "GET", "/y"), ("s1", "a", "schema_op", "rest", "GET", "/x"), ("s2", "a", "schema_op", "rest", "GET", "/z")])
    assert {(r.node_id, r.drift) for r in api.drift(o, api.exposes(o)).collect()} == {("e2", "undocumented"), ("s2", "unimplemented")}
    bare = o.filter("kind = 'endpoint'")
    assert api.drift(bare, api.exposes(bare)).count() == 0
    assert api.drift(bare, api.exposes(bare), require_schema=False).count() == 2


def test_imports(spark):
    imports = spark.createDataFrame([("src/a/x.ts", "./y", "typescript"), ("src/a/x.ts", "../z", "typescript"), ("src/a/x.ts", "../../../q", "typescript"), ("src/a/x.ts", "react", "typescript"), ("m.py", "pkg.mod", "python"), ("M.java", "com.foo.*", "java"), ("a.go", "fmt", "go")], "importer string, raw string, language string")
    files = spark.createDataFrame([("src/a/y.tsx",), ("src/z/index.js",), ("lib/pkg/mod.py",)], "path string")
    got = {(r.raw, r.target, r.way) for r in resolve.resolve_imports(imports, files).collect()}
    assert got == {("./y", "src/a/y.tsx", "exact"), ("../z", "src/z/index.js", "exact"), ("pkg.mod", "lib/pkg/mod.py", "suffix")}


def test_entities_and_constants(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, ["c"]), (5, [])], "entry int, keys array<string>")
    assert {(r.entry, r.entity) for r in resolve.same_entity(rows).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    c = spark.createDataFrame([("f", "A", None, "g", "B"), ("g", "B", "/b", None, None), ("f", "C", None, None, "B"), ("f", "L", None, "f", "L")], "file string, name string, value string, ref_file string, ref_name string")
    assert {(r.name, r.value) for r in resolve.resolve_constants(c).collect()} == {("A", "/b"), ("B", "/b"), ("C", "/b")}


def test_gate(spark):
    commits = spark.createDataFrame([("1", "pub", "me@x", 1), ("2", "priv", "me@x", 2), ("3", "prop", "me@x", 3), ("4", "gone", "me@x", 4), ("5", "pub", "you@x", 5)], "node_id string, repo string, author_email string, committed_at long")
    repos = spark.createDataFrame([("pub", "public"), ("priv", "private"), ("prop", "proprietary")], "repo string, visibility string")
    local = atlas.gated(commits, repos, me=["me@x"])
    assert [r.node_id for r in atlas.shown(local).collect()] == ["2", "1"]
    assert tuple(atlas.gate_counts(local).first()) == (2, 2, 1)
    assert [r.node_id for r in atlas.shown(atlas.gated(commits, repos, public_only=True)).collect()] == ["5", "1"]
    assert atlas.shown(atlas.gated(commits, repos, include_restricted=True)).count() == 5


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "id string, v int")
    assert {tuple(r) for r in tables.upsert(old, new, ["id"], F.col("v")).collect()} == {("a", 1), ("b", 3), ("c", 1)}
    path = str(tmp_path / "t")
    tables.write_table(old, path)
    tables.write_table(tables.upsert(tables.read_table(spark, path), new, ["id"], F.col("v")), path)
    assert tables.read_table(spark, path).count() == 3
    e = spark.createDataFrame([], "space string, model string, node_id string, vector array<float>")
    two = spark.createDataFrame([(1, "n", [1.0, 2.0]), (2, "n", [3.0, 4.0]), (3, "m", [0.0, 1.0])], "ordinal int, node_id string, vector array<float>")
    kept = tables.replace_namespace(e, "s", "m", two)
    assert {(r.node_id, tuple(r.vector)) for r in kept.collect()} == {("n", (1.0, 2.0)), ("m", (0.0, 1.0))}
    bad = two.unionByName(spark.createDataFrame([(4, "o", [1.0])], two.schema))
    with pytest.raises(Exception, match="different lengths"):
        tables.replace_namespace(e, "s", "m", bad).collect()
    assert tables.same_rows(old, old.select("*")) and not tables.same_rows(old, new)


def test_graph_page(spark):
    nodes = spark.createDataFrame([("1", "</script>", "function", "a"), ("2", "b", "function", "a")], "id string, name string, kind string, file string")
    edges = spark.createDataFrame([("1", "2", "calls", "extracted")], "src string, dst string, kind string, confidence string")
    page = tables.graph_html(tables.graph_elements(nodes, edges), "a <b>")
    assert page.count("</script>") == 2 and "<title>a &lt;b&gt;</title>" in page
    data = json.loads(page.split('type="application/json">')[1].split("</script>")[0].replace("<\\/", "</"))
    assert {x["data"].get("name") for x in data} == {"</script>", "b", None} and len(data) == 3


def test_yaml_rows(spark):
    rows = spark.createDataFrame([("yes", 'a "b"\nc', 1, [1, 2]), (None, "plain text", None, None)], "s string, t string, n int, l array<int>")
    got = [r.yaml for r in tables.as_yaml(rows).collect()]
    assert got == ['- l: [1,2]\n  n: 1\n  s: "yes"\n  t: "a \\"b\\"\\nc"', "- l: null\n  n: null\n  s: null\n  t: plain text"]


def test_staleness(spark):
    rows = spark.createDataFrame([("a", "a", False, True), ("a", "b", True, True), ("a", None, False, True), (None, "b", False, True), ("a", "a", True, True)], "indexed_head string, head string, dirty boolean, schema_ok boolean")
    assert [r.state for r in atlas.staleness(rows).collect()] == ["fresh", "stale", "unknown", "stale", "stale"]


def test_engine_verbs(spark):
    from graphwright.engine import GATE_EXIT, Engine

    n = nodes(spark, [*NODES, ("e1", "endpoint", "GET /x", "/x", "api.yaml", 1, 1)])
    e = spark.createDataFrame([("3", "1", "calls", "extracted"), ("1", "e1", "handles", "extracted")], "src string, dst string, kind string, confidence string")
    o = ops(spark, [("e1", "r", "endpoint", "rest", "GET", "/x"), ("c1", "r", "client_call", "rest", "GET", "/x")])
    repos = spark.createDataFrame([("r", "public")], "repo string, visibility string")
    commits = spark.createDataFrame([("k1", "r", "a@x", 5, "Add parser"), ("k2", "r", "a@x", 6, "Fix vector search")], "node_id string, repo string, author_email string, committed_at long, subject string")
    touched = spark.createDataFrame([("k1", "src/parse/a.rs"), ("k2", "src/vec/b.rs")], "node_id string, path string")
    g = Engine(n, e, o, repos, commits, touched)
    assert {r.id for r in g.callers("parse").collect()} == {"3"}
    items = g.impact("parse")
    assert {(r.id, r["class"]) for r in items.collect()} == {("3", "internal"), ("e1", "api")}
    assert g.gate(items) == GATE_EXIT
    assert [r.handler for r in g.serves("/x").collect()] == ["p::parse"]
    assert g.who_calls("/x").count() == 1 and g.clients(unmatched=True).count() == 0
    assert [r.node_id for r in g.timeline().collect()] == ["k2", "k1"]
    assert [r.id for r in g.similar_commits("parser parse", 1, 64).collect()] == ["k1"]
    assert g.cypher("MATCH (a)-[:calls]->(b) RETURN a.id AS x").first().x == "3"
    assert g.reachable("parse").first().id == "3"
    assert g.view(n.select("id")).count() == 7
