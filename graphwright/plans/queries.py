"""Queries of the graph engine over the test graph, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import dates, hashing, text, vectors
from graphwright.operators import api, atlas, impact, resolve, tables, traverse
from graphwright.operators.graph import EXPORTABLE_KINDS, OUTLINE_KINDS, Graph, changed_symbols, innermost, preceding
from graphwright.plans import sqltext as Q
from graphwright.plans.testgraph import Tables, with_views

_found: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        n = name or f.__name__
        _found[n] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _sql[n] = with_views(sql)
        return f

    return register


def graph(t: Tables, data: bool = False) -> Graph:
    edges = t.edges.unionByName(t.data_edges) if data else t.edges
    return Graph(t.nodes, edges, t.operations)


# lookups and filters
@query("SELECT id, kind, name, file FROM nodes WHERE id = 'sym:42'")
def f1_get(t):
    return graph(t).get("sym:42").select("id", "kind", "name", "file")


@query("SELECT id, kind, name, file FROM nodes WHERE name = 'main' OR qualified_name = 'main' ORDER BY id LIMIT 200")
def f2_find_by_name(t):
    return graph(t).find_by_name("main").select("id", "kind", "name", "file")


@query("SELECT id, kind, start_line FROM nodes WHERE file = 'src/building/m3.rs'")
def f3_nodes_in_file(t):
    return graph(t).in_file("src/building/m3.rs").select("id", "kind", "start_line")


@query("""
  SELECT id, name, score FROM (
    SELECT id, name, CASE WHEN contains(lower(name), 'auto') THEN 3 WHEN contains(lower(qualified_name), 'auto') THEN 2 WHEN contains(lower(coalesce(doc, '')), 'auto') OR contains(lower(file), 'auto') THEN 1 ELSE 0 END AS a,
           CASE WHEN contains(lower(name), 'm1') THEN 3 WHEN contains(lower(qualified_name), 'm1') THEN 2 WHEN contains(lower(coalesce(doc, '')), 'm1') OR contains(lower(file), 'm1') THEN 1 ELSE 0 END AS b, a + b AS score
    FROM nodes WHERE NOT (kind = 'module' AND file = '')) WHERE a > 0 AND b > 0
  ORDER BY score DESC, strlen(name), name, id LIMIT 50""")
def f4_search(t):
    return graph(t).search("Auto m1").select("id", "name", "score")


@query("SELECT e.src, e.dst, e.kind FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.kind IN ('function', 'endpoint') AND b.kind IN ('function', 'endpoint') AND e.kind IN ('calls', 'handles')")
def f5_export_kinds(t):
    return graph(t).export(["function", "endpoint"], ["calls", "handles"])[1].select("src", "dst", "kind")


@query("WITH p AS (SELECT id FROM nodes WHERE kind IN ('function', 'method', 'struct') ORDER BY id LIMIT 700) SELECT src, dst, kind, confidence FROM edges WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p)")
def f6_view_trim(t):
    return graph(t).export(["function", "method", "struct"], None, 700)[1]


@query("SELECT protocol, kind, count(*) AS n FROM operations WHERE protocol = 'rest' GROUP BY ALL")
def f7_protocol(t):
    ops = t.operations
    return api.of_kind(ops, "endpoint", "rest").unionByName(api.of_kind(ops, "client_call", "rest")).unionByName(api.of_kind(ops, "schema_op", "rest")).groupBy("protocol", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT node_id, method, path FROM operations WHERE {Q.signature('path')} = '/www/en/{{}}' AND method = 'GET'")
def f8_path_match(t):
    return api.operations_matching(t.operations, "/www/en/:id", "GET").select("node_id", "method", "path")


@query(f"SELECT file, start_line, kind, name, signature, id FROM nodes WHERE kind IN ({', '.join(repr(k) for k in OUTLINE_KINDS)}) AND starts_with(file, 'src/machinery/')")
def f9_outline(t):
    return graph(t).outline("src/machinery").select("file", "start_line", "kind", "name", "signature", "id")


@query("SELECT node_id, hash, committed_at FROM commits WHERE committed_at BETWEEN 883612800 AND 915148799")
def f10_time_window(t):
    return atlas.in_range(t.commits, 883612800, 915148799).select("node_id", "hash", "committed_at")


@query("SELECT day, name, seconds FROM waka WHERE dimension = 'click' AND day BETWEEN '2024-01-05' AND '2024-01-12'")
def f11_effort_filter(t):
    return atlas.effort(t.waka, "2024-01-05", "2024-01-12", "click").select("day", "name", "seconds")


@query("SELECT node_id, c.repo, CASE WHEN visibility IS NULL OR visibility = 'proprietary' THEN 'restricted' ELSE 'kept' END AS outcome FROM commits c LEFT JOIN repos USING (repo)")
def f12_visibility_gate(t):
    return atlas.gated(t.commits, t.repos).select("node_id", "repo", "outcome")


@query(f"SELECT count(*) FILTER (o = 'kept') AS matched, count(*) FILTER (o = 'restricted') AS excluded_restricted, count(*) FILTER (o = 'author') AS excluded_author FROM (SELECT CASE WHEN visibility IS NULL OR visibility <> 'public' THEN 'restricted' WHEN ({Q.email('author_email')} IN ('dev99@gmail.com', 'dev.7@proton.me') OR regexp_matches(lower(author_email), '^dev[.]1.@example[.]org$')) AND NOT starts_with(lower(author_email), 'bot') THEN 'kept' ELSE 'author' END AS o FROM commits LEFT JOIN repos USING (repo))")
def f13_author_filter(t):
    rows = atlas.gated(t.commits, t.repos, public_only=True, me=["dev99@gmail.com", "dev.7@proton.me"], patterns=["dev.1?@example.org"], bots=["bot*"])
    return atlas.gate_counts(rows)


@query("SELECT repo, grp, health FROM repos WHERE health = 'fresh' AND grp IN ('ASIA') ORDER BY repo LIMIT 100")
def f14_list_repos(t):
    return atlas.list_repos(t.repos, health="fresh", group="ASIA").select("repo", "grp", "health")


@query("SELECT DISTINCT repo FROM commits WHERE contains(lower(author_email), 'dev.42@')")
def f15_contributor(t):
    people = t.commits.groupBy("repo").agg(F.collect_set(F.lower("author_email")).alias("contributors"))
    return people.filter(F.exists("contributors", lambda c: c.contains("dev.42@"))).select("repo")


@query(f"SELECT id, {Q.classified()} AS class FROM nodes")
def f16_classify(t):
    return t.nodes.select("id", impact.classify(F.col("kind"), F.col("file"), F.col("qualified_name")).alias("class"))


@query("SELECT id, CASE WHEN regexp_matches(file, '^src/.*/m7[.]') THEN 'test' ELSE 'other' END AS class FROM nodes WHERE kind = 'trait' AND NOT starts_with(file, 'tests/')")
def f17_configured_tests(t):
    c = impact.classify(F.col("kind"), F.col("file"), F.col("qualified_name"), ["src/*/m7.*"])
    return t.nodes.filter("kind = 'trait' and not startswith(file, 'tests/')").select("id", F.when(c == "test", "test").otherwise("other").alias("class"))


@query(f"SELECT id FROM nodes WHERE kind IN ({', '.join(repr(k) for k in EXPORTABLE_KINDS)})")
def f18_exportable(t):
    return t.nodes.filter(F.col("kind").isin(EXPORTABLE_KINDS)).select("id")


@query(f"SELECT page_id, len(list_filter(string_split(list_last(string_split(s, '|')), '/'), lambda x: x <> '' AND x <> '{{}}')) > 0 AS literal FROM (SELECT page_id, {Q.operation('protocol', 'method', 'raw')} AS s FROM raw_paths WHERE protocol = 'rest')")
def f19_literal_segment(t):
    rows = t.raw_paths.filter("protocol = 'rest'")
    return rows.select("page_id", text.has_literal_segment(text.operation_signature(F.col("protocol"), F.col("method"), F.col("raw"))).alias("literal"))


@query("SELECT repo, CASE WHEN k % 5 = 0 THEN 'not indexed' WHEN k % 7 = 0 THEN 'schema changed' WHEN k % 6 = 0 THEN 'no head' WHEN k % 4 = 0 THEN 'new commits' WHEN k % 3 = 0 THEN 'uncommitted changes' END AS reason FROM (SELECT repo, CAST(substr(repo, 5) AS INT) AS k FROM repos)")
def f20_staleness(t):
    k = F.substring("repo", 5, 9).cast("int")
    rows = t.repos.select("repo", F.when(k % 5 != 0, "a").alias("indexed_head"), (k % 7 != 0).alias("schema_ok"), F.when(k % 6 != 0, F.when(k % 4 == 0, "b").otherwise("a")).alias("head"), (k % 3 == 0).alias("dirty"))
    return atlas.staleness(rows).select("repo", "reason")


@query("SELECT repo, CASE WHEN repo = 'repo2' THEN 'public' WHEN repo IN ('repo10', 'repo11', 'repo12', 'repo13', 'repo14', 'repo15', 'repo16', 'repo17', 'repo18', 'repo19') THEN 'proprietary' WHEN visibility = 'public' AND ends_with(repo, '3') THEN 'private' ELSE visibility END AS visibility FROM repos")
def f21_classify_repos(t):
    return atlas.classify_repos(t.repos, ["repo2"], ["REPO1?"], ["*3"]).select("repo", "visibility")


# joins
SPANS = "SELECT file, id, start_line AS start, end_line AS end_ FROM nodes WHERE start_line IS NOT NULL AND file LIKE 'src/%'"


@query("""
  WITH spans AS (SELECT file, id, start_line - 5 * (start_line % 3) AS s, end_line + 7 * (end_line % 4) AS e FROM nodes WHERE kind IN ('function', 'method', 'struct', 'trait')),
  sites AS (SELECT DISTINCT file, start_line + 3 AS at_ FROM nodes WHERE kind = 'function')
  SELECT file, at_ AS site, id FROM (SELECT s.file, at_, id, row_number() OVER (PARTITION BY s.file, at_ ORDER BY e - s, id) AS r FROM sites s JOIN spans p ON s.file = p.file AND s <= at_ AND at_ <= e) WHERE r = 1""")
def j1_innermost_span(t):
    n = t.nodes
    spans = n.filter("kind in ('function', 'method', 'struct', 'trait')").selectExpr("file", "id", "start_line - 5 * (start_line % 3) as start", "end_line + 7 * (end_line % 4) as end")
    sites = n.filter("kind = 'function'").selectExpr("file", "start_line + 3 as site", "start_line + 3 as at").distinct()
    return innermost(sites, spans)


@query("""
  WITH sites AS (SELECT DISTINCT file, start_line + 4 AS at_ FROM nodes WHERE kind = 'function'), spans AS (SELECT file, start_line AS s, min(id) AS id FROM nodes WHERE kind = 'function' GROUP BY ALL)
  SELECT x.file, CAST(x.at_ AS VARCHAR) AS site, id FROM sites x ASOF JOIN spans p ON x.file = p.file AND x.at_ >= p.s""")
def j1_preceding(t):
    n = t.nodes
    sites = n.filter("kind = 'function'").selectExpr("file", "start_line + 4 as site", "start_line + 4 as at").distinct()
    return preceding(sites, n.filter("kind = 'function'").selectExpr("file", "id", "start_line as start"))


CHANGES = "SELECT DISTINCT file, c_custkey % 13 = 0 AS deleted FROM (SELECT file, min(k) AS c_custkey FROM symbols WHERE k % 9 = 0 GROUP BY file) x"


@query(f"""
  WITH changes AS ({CHANGES}), hits AS (SELECT DISTINCT c.file, id FROM changes c JOIN nodes n ON c.file = n.file WHERE NOT deleted AND n.start_line <= 120 AND 41 <= n.end_line)
  SELECT c.file, id, CASE WHEN deleted THEN 'removed' WHEN id IS NULL THEN 'unresolved' ELSE 'seed' END AS outcome FROM changes c LEFT JOIN hits h USING (file)""")
def j2_changed_symbols(t):
    files = t.symbols.filter("k % 9 = 0").groupBy("file").agg(F.min("k").alias("k"))
    changes = files.select("file", (F.col("k") % 13 == 0).alias("deleted"), F.expr("array(named_struct('start', 41, 'end', 120))").alias("ranges"))
    return changed_symbols(changes, t.nodes)


@query("SELECT dst AS id, kind AS edge_kind, confidence FROM edges WHERE src = 'sym:24' UNION ALL SELECT src, concat('in:', kind), confidence FROM edges WHERE dst = 'sym:24'")
def j3_neighbors(t):
    g = graph(t)
    out = g.neighbors("sym:24").select("id", "edge_kind", "confidence")
    return out.unionByName(g.neighbors("sym:24", outgoing=False).select("id", F.concat(F.lit("in:"), "edge_kind").alias("edge_kind"), "confidence"))


@query("SELECT node_id, n.name, o.method FROM operations o JOIN nodes n ON n.id = o.node_id WHERE o.kind = 'endpoint'")
def j4_operations_with_nodes(t):
    return api.of_kind(t.operations, "endpoint").join(t.nodes.select(F.col("id").alias("node_id"), "name"), "node_id").select("node_id", "name", "method")


PENDING = """
  pending AS (SELECT concat('l', CAST(k AS VARCHAR)) AS link, id AS anchor, file AS anchor_file, CASE WHEN k % 50 = 9 THEN 'main' ELSE concat(lower(split_part(qualified_name, '::', 1))[1:4], '_', CAST((k * 7) % 97 AS VARCHAR)) END AS name, CASE WHEN k % 3 = 0 THEN 'building' END AS scope FROM symbols),
  sym_imports AS (SELECT file, name, target_file FROM (SELECT a.file, b.name, b.file AS target_file FROM symbols a JOIN symbols b ON b.k = (a.k * 3 + 1) % 1400 WHERE a.k % 5 = 0)),
  file_imports AS (SELECT a.file, b.file AS target_file FROM symbols a JOIN symbols b ON b.k = (a.k * 11 + 2) % 1400 WHERE a.k % 2 = 0)"""


@query(f"""
  WITH {PENDING},
  c AS (SELECT p.*, n.id AS target, n.qualified_name AS q, n.file AS tf, count(*) OVER (PARTITION BY link) AS n FROM pending p JOIN nodes n ON n.name = p.name AND n.id <> p.anchor),
  f AS (SELECT *, n = 1 AS x0, coalesce(q = scope || '::' || name OR ends_with(q, '::' || scope || '::' || name), false) AS x1,
          (anchor_file, name, tf) IN (SELECT (file, name, target_file) FROM sym_imports) AS x2, (anchor_file, tf) IN (SELECT (file, target_file) FROM file_imports) AS x3,
          regexp_extract(anchor_file, '^(.*)/[^/]*$', 1) = regexp_extract(tf, '^(.*)/[^/]*$', 1) AS x4 FROM c),
  g AS (SELECT link, anchor, {", ".join(f"count(*) FILTER (x{i}) AS n{i}, min(target) FILTER (x{i}) AS t{i}" for i in range(5))} FROM f GROUP BY ALL)
  SELECT link, anchor, CASE {" ".join(f"WHEN n{i} = 1 THEN t{i}" for i in range(5))} END AS target, CASE {" ".join(f"WHEN n{i} = 1 THEN {i}" for i in range(5))} END AS tier FROM g
  WHERE {" OR ".join(f"n{i} = 1" for i in range(5))}""")
def j5_j9_resolve_names(t):
    s = t.symbols
    name = F.expr("case when k % 50 = 9 then 'main' else concat(substr(lower(split_part(qualified_name, '::', 1)), 1, 4), '_', cast((k * 7) % 97 as string)) end")
    pending = s.select(F.concat(F.lit("l"), F.col("k").cast("string")).alias("link"), F.col("id").alias("anchor"), F.col("file").alias("anchor_file"), name.alias("name"), F.expr("case when k % 3 = 0 then 'building' end").alias("scope"))
    a, b = s.alias("a"), s.alias("b")
    symbol = a.filter("k % 5 = 0").join(b, F.expr("b.k = (a.k * 3 + 1) % 1400")).select("a.file", "b.name", F.col("b.file").alias("target_file"))
    file = a.filter("k % 2 = 0").join(b, F.expr("b.k = (a.k * 11 + 2) % 1400")).select("a.file", F.col("b.file").alias("target_file"))
    return resolve.resolve_names(pending, t.nodes, symbol, file)


@query("""
  WITH files AS (SELECT DISTINCT file AS path FROM symbols), imp AS (SELECT DISTINCT file AS importer, concat(lower(substr(qualified_name, 1, strpos(qualified_name, '::') - 1)), '.m', CAST((k * 3) % 60 AS VARCHAR)) AS raw FROM symbols WHERE language = 'python'),
  c AS (SELECT importer, raw, unnest([0, 1]) AS place, unnest([replace(raw, '.', '/') || '.py', replace(raw, '.', '/') || '/__init__.py']) AS cand FROM imp),
  x AS (SELECT importer, raw, 0 AS way, place, cand AS target FROM c JOIN files ON path = cand
        UNION ALL SELECT importer, raw, 1, place, min(path) FROM c JOIN files ON ends_with(path, '/' || cand) GROUP BY ALL HAVING count(*) = 1)
  SELECT importer, raw, arg_min(target, way * 10 + place) AS target, CASE WHEN min(way) = 0 THEN 'exact' ELSE 'suffix' END AS way FROM x GROUP BY ALL""")
def j10_resolve_imports(t):
    s = t.symbols
    raw = F.expr("concat(lower(split_part(qualified_name, '::', 1)), '.m', cast((k * 3) % 60 as string))")
    imports = s.filter("language = 'python'").select(F.col("file").alias("importer"), raw.alias("raw"), "language").distinct()
    return resolve.resolve_imports(imports, s.select(F.col("file").alias("path")).distinct())


@query("""
  WITH acc AS (SELECT id AS node, CASE WHEN k % 2 = 0 THEN 'write' ELSE 'read' END AS access, CASE k % 3 WHEN 0 THEN concat('T_', CAST(k % 300 AS VARCHAR)) WHEN 1 THEN concat('public.t_', CAST(k % 300 AS VARCHAR)) ELSE concat('Entity', CAST(k % 40 AS VARCHAR)) END AS name FROM symbols),
  ent AS (SELECT concat('Entity', CAST(p_partkey % 50 AS VARCHAR)) AS entity, concat('t_', CAST(p_partkey % 60 AS VARCHAR)) AS tab FROM part),
  certain AS (SELECT entity, min(tab) AS t FROM ent GROUP BY entity HAVING count(DISTINCT tab) = 1),
  named AS (SELECT node, access, lower(coalesce(t, name)) AS key FROM acc LEFT JOIN certain ON name = entity),
  keys AS (SELECT id, lower(qualified_name) AS key FROM nodes WHERE kind = 'table' UNION SELECT id, lower(name) FROM nodes WHERE kind = 'table')
  SELECT DISTINCT node AS src, id AS dst, CASE access WHEN 'write' THEN 'writes' ELSE 'reads' END AS kind, 'inferred' AS confidence FROM named JOIN keys USING (key)""")
def j11_table_access(t):
    name = F.expr("case k % 3 when 0 then concat('T_', cast(k % 300 as string)) when 1 then concat('public.t_', cast(k % 300 as string)) else concat('Entity', cast(k % 40 as string)) end")
    acc = t.symbols.select(F.col("id").alias("node"), F.expr("case when k % 2 = 0 then 'write' else 'read' end").alias("access"), name.alias("name"))
    ent = t.part.selectExpr("concat('Entity', cast(p_partkey % 50 as string)) as entity", "concat('t_', cast(p_partkey % 60 as string)) as table")
    return resolve.table_access(acc, t.nodes.filter("kind = 'table'").select("id", F.col("qualified_name").alias("name")), ent)


INVOKES = f"""
  signed AS (SELECT *, {Q.operation('protocol', 'method', 'path')} AS sig FROM operations),
  cand AS (SELECT node_id, sig, 2 AS r FROM signed WHERE kind = 'endpoint'
    UNION ALL SELECT node_id, {Q.operation('protocol', 'method', "substr(path, 5)")}, 1 FROM signed WHERE kind = 'endpoint' AND starts_with(path, '/api/')),
  pairs AS (SELECT c.node_id AS client, c.kind AS ckind, e.node_id AS endpoint, max(r) AS r FROM signed c JOIN cand e USING (sig) WHERE c.kind IN ('client_call', 'schema_op') GROUP BY ALL),
  best AS (SELECT *, max(r) OVER (PARTITION BY client) AS b FROM pairs),
  inv AS (SELECT client AS src, endpoint AS dst, CASE WHEN r = 2 THEN 'extracted' ELSE 'inferred' END AS confidence FROM best WHERE r = b AND ckind = 'client_call'),
  exp AS (SELECT endpoint AS src, client AS dst, CASE WHEN r = 2 THEN 'extracted' ELSE 'inferred' END AS confidence FROM best WHERE r = b AND ckind = 'schema_op')"""


def _calls(t):
    return api.invokes(t.operations, gateways=["/api"])


def _exposed(t):
    return api.exposes(t.operations, gateways=["/api"])


@query(f"WITH {INVOKES} SELECT src, dst, 'invokes' AS kind, confidence FROM inv")
def j12_invokes(t):
    return _calls(t)


@query(f"WITH {INVOKES} SELECT src, dst, 'exposes' AS kind, confidence FROM exp")
def j13_exposes(t):
    return _exposed(t)


@query("SELECT a.id AS src, b.id AS dst, 'mounts' AS kind, 'inferred' AS confidence FROM symbols a JOIN symbols b ON a.file = b.file AND a.name = b.name AND a.id <> b.id WHERE a.kind = 'struct'")
def j14_mounts(t):
    s = t.symbols.select("id", "file", "name", "kind")
    return api.mounts(s.filter("kind = 'struct'").drop("kind"), s.drop("kind"))


@query("""
  WITH p AS (SELECT DISTINCT repo AS to_repo, package FROM packages), u AS (SELECT repo AS from_repo, * EXCLUDE (repo) FROM uses)
  SELECT DISTINCT from_repo, from_file, from_node, p.to_repo, u.package, CASE WHEN e.node_id IS NOT NULL THEN symbol END AS to_symbol, e.node_id AS to_node, CASE WHEN e.node_id IS NULL THEN 'crate' ELSE 'symbol' END AS kind
  FROM u JOIN p ON u.package = p.package AND from_repo <> p.to_repo LEFT JOIN exports e ON e.repo = p.to_repo AND e.package = u.package AND e.name = u.symbol""")
def j15_package_links(t):
    return resolve.package_links(t.uses, t.packages, t.exports)


WEB = f"WITH s AS (SELECT *, {Q.operation('protocol', 'method', 'path')} AS sig FROM operations) SELECT c.repo AS from_repo, c.node_id AS client, e.repo AS to_repo, e.node_id AS endpoint FROM s c JOIN s e ON c.sig = e.sig AND c.repo <> e.repo WHERE c.kind = 'client_call' AND e.kind = 'endpoint' AND len(list_filter(string_split(list_last(string_split(c.sig, '|')), '/'), lambda x: x <> '' AND x <> '{{}}')) > 0"


@query(WEB)
def j16_web_links(t):
    return api.web_links(t.operations)


@query(f"SELECT DISTINCT from_repo, to_repo FROM ({WEB})", name="j16_repo_links")
def j16_repo(t):
    return api.repo_links(api.web_links(t.operations))


HINTS = [("h1", "from", "repo3", "main", None), ("h1", "to", "repo4", "main", None), ("h2", "from", "repo5", "main", None), ("h2", "to", "repo0", None, "rest|GET|/www/en/{}"), ("h3", "from", "nowhere", "main", None), ("h3", "to", "repo1", "main", None)]
HINT_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in HINTS)


@query(f"""
  WITH h(hint, side, repo, symbol, signature) AS (VALUES {HINT_ROWS}),
  s AS (SELECT h.hint, h.side, h.repo, n.id FROM h JOIN nodes n ON n.repo = h.repo AND (n.name = h.symbol OR n.qualified_name = h.symbol)
        UNION SELECT h.hint, h.side, h.repo, o.node_id FROM h JOIN operations o ON o.repo = h.repo AND {Q.operation('o.protocol', 'o.method', 'o.path')} = h.signature)
  SELECT a.hint, a.repo AS from_repo, a.id AS src, b.repo AS to_repo, b.id AS dst FROM s a JOIN s b USING (hint) WHERE a.side = 'from' AND b.side = 'to'""")
def j17_hinted_links(t):
    hints = t.spark.createDataFrame(HINTS, "hint string, side string, repo string, symbol string, signature string")
    return api.hinted_links(hints, t.nodes, t.operations)


PACKAGE_DIRS = [("root", ""), ("auto", "src/automobile"), ("build", "src/building"), ("tests", "tests")]
DIR_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in PACKAGE_DIRS)


@query(f"WITH p(name, dir) AS (VALUES {DIR_ROWS}), f AS (SELECT DISTINCT file AS path FROM symbols) SELECT path, arg_max(name, length(dir)) AS package, arg_max(dir, length(dir)) AS dir FROM f JOIN p ON dir = '' OR starts_with(path, dir || '/') GROUP BY path")
def j18_owning_package(t):
    packages = t.spark.createDataFrame(PACKAGE_DIRS, "name string, dir string")
    return resolve.owning_package(t.symbols.select(F.col("file").alias("path")).distinct(), packages)


@query(f"WITH {INVOKES}, c AS (SELECT dst, min(src) AS caller FROM edges WHERE kind = 'calls' GROUP BY dst) SELECT node_id, method, path, caller, CASE WHEN len(list_filter(string_split(list_last(string_split(sig, '|')), '/'), lambda x: x <> '' AND x <> '{{}}')) > 0 THEN 'no endpoint' ELSE 'dynamic path' END AS reason FROM signed LEFT JOIN c ON dst = node_id WHERE kind = 'client_call' AND node_id NOT IN (SELECT src FROM inv)")
def j19_unmatched_clients(t):
    return api.unmatched_clients(t.operations, _calls(t), t.edges)


@query(f"WITH {INVOKES} SELECT node_id, method, path, CASE kind WHEN 'endpoint' THEN 'undocumented' ELSE 'unimplemented' END AS drift FROM operations WHERE (kind = 'endpoint' AND node_id NOT IN (SELECT src FROM exp)) OR (kind = 'schema_op' AND node_id NOT IN (SELECT dst FROM exp))")
def j20_drift(t):
    return api.drift(t.operations, _exposed(t))


@query("SELECT c.node_id, c.hash, c.committed_at, coalesce(f, 0)::BIGINT AS files FROM commits c LEFT JOIN (SELECT node_id, count(*) AS f FROM touched GROUP BY ALL) USING (node_id) WHERE committed_at >= 900000000 AND c.node_id IN (SELECT node_id FROM tagged WHERE topic = 'anvil')")
def j21_timeline(t):
    return atlas.timeline(t.commits, t.touched, t.tagged, "anvil", since=900000000).select("node_id", "hash", "committed_at", "files")


@query("SELECT node_id, hash FROM commits WHERE k % 100 = 3")
def j22_commit_rows(t):
    ids = t.commits.filter("k % 100 = 3").select("node_id")
    return t.commits.join(ids, "node_id", "left_semi").select("node_id", "hash")


@query("SELECT node_id, path FROM touched JOIN commits USING (node_id) WHERE repo = 'repo3'")
def j23_touched_paths(t):
    return t.touched.join(t.commits.filter("repo = 'repo3'").select("node_id"), "node_id").select("node_id", "path")


@query("SELECT src, dst, kind, confidence FROM edges WHERE src IN (SELECT id FROM symbols WHERE k % 3 < 2) AND dst IN (SELECT id FROM symbols WHERE k % 3 < 2)")
def j24_subgraph(t):
    return graph(t).subgraph(t.symbols.filter("k % 3 < 2").select("id"))[1]


@query(f"WITH {INVOKES} SELECT node_id, method, path, coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM edges e WHERE e.kind = 'handles' AND e.dst = node_id AND src IN (SELECT id FROM nodes)), '') AS handlers, coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM inv WHERE inv.dst = node_id), '') AS callers, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM exp WHERE exp.src = node_id), '') AS schema_ops FROM operations WHERE kind = 'endpoint'")
def j25_api_impact(t):
    out = api.api_impact(t.operations, t.edges, t.nodes, _calls(t), _exposed(t))
    return out.select("node_id", "method", "path", *[F.array_join(c, ",").alias(c) for c in ("handlers", "callers", "schema_ops")])


@query(f"SELECT node_id, method, path, (SELECT min(qualified_name) FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind = 'handles' AND e.dst = node_id) AS handler FROM operations WHERE kind = 'endpoint' AND {Q.signature('path')} = '/www/en/{{}}'")
def j26_serves(t):
    return api.serves(t.operations, t.edges, t.nodes, "/www/en/1")


@query(f"WITH {INVOKES} SELECT i.src, i.dst, c.repo, c.method, c.path, i.confidence FROM inv i JOIN operations e ON e.node_id = i.dst JOIN operations c ON c.node_id = i.src WHERE {Q.signature('e.path')} = '/www/en/{{}}'")
def j27_who_calls(t):
    return api.who_calls(t.operations, _calls(t), "/www/en/7")


CONSTANTS = "SELECT file, name, CASE WHEN k % 4 = 0 THEN concat('/v', CAST(k AS STRING)) END AS value, CASE WHEN k % 4 <> 0 AND k % 3 <> 0 THEN concat('f', CAST((k * 5 + 1) % 1900 AS STRING)) END AS ref_file, CASE WHEN k % 4 <> 0 THEN concat('C', CAST((k * 5 + 1) % 1900 AS STRING)) END AS ref_name FROM (SELECT p_partkey AS k, concat('f', CAST(p_partkey AS STRING)) AS file, concat('C', CAST(p_partkey AS STRING)) AS name FROM part) x"


@query(f"""
  WITH RECURSIVE c AS ({CONSTANTS}), r AS (SELECT c.file, c.name, c.value, c.ref_name, coalesce(c.ref_file, o.only_) AS ref_file FROM c LEFT JOIN (SELECT name AS n, min(file) AS only_ FROM c GROUP BY name HAVING count(*) = 1) o ON o.n = c.ref_name),
  w AS (SELECT file, name, value, ref_file, ref_name, 0 AS hops FROM r UNION ALL SELECT w.file, w.name, r.value, r.ref_file, r.ref_name, hops + 1 FROM w JOIN r ON w.ref_file = r.file AND w.ref_name = r.name WHERE w.value IS NULL AND hops < 8)
  SELECT file, name, value, hops FROM w WHERE value IS NOT NULL""")
def j28_resolve_constants(t):
    return resolve.resolve_constants(t.sql(CONSTANTS))


@query("""
  WITH RECURSIVE k AS (SELECT p_partkey AS entry, unnest([concat('a', CAST(p_partkey % 397 AS VARCHAR)), concat('b', CAST(floor(p_partkey / 3) AS BIGINT))]) AS key FROM part),
  l AS (SELECT DISTINCT a.entry AS x, b.entry AS y FROM k a JOIN k b USING (key)), reach AS (SELECT entry, entry AS y FROM k UNION SELECT reach.entry, l.y FROM reach JOIN l ON reach.y = l.x)
  SELECT entry, min(y) AS entity FROM reach GROUP BY entry""")
def j29_same_entity(t):
    rows = t.part.select(F.col("p_partkey").alias("entry"), F.expr("array(concat('a', cast(p_partkey % 397 as string)), concat('b', cast(p_partkey div 3 as string)))").alias("keys"))
    return resolve.same_entity(rows)


@query("SELECT c.repo, coalesce(r.visibility, 'unregistered') AS visibility, count(*) AS n FROM commits c LEFT JOIN repos r USING (repo) GROUP BY ALL")
def j30_visibility_of_hits(t):
    return t.commits.join(t.repos.select("repo", "visibility"), "repo", "left").groupBy("repo", F.coalesce("visibility", F.lit("unregistered")).alias("visibility")).agg(F.count(F.lit(1)).alias("n"))


REPO_VECTORS = "SELECT concat('repo', CAST(vec_id AS STRING)) AS id, embedding AS vector FROM embeddings"


@query(f"""
  WITH v AS ({REPO_VECTORS}), s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS score FROM v a, v b WHERE a.id <> b.id),
  n AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS p FROM s WHERE score > 0)
  SELECT least(x, y) AS a, greatest(x, y) AS b, round(max(score), 6) AS score FROM n WHERE p <= 5 GROUP BY ALL""")
def j31_similarity_graph(t):
    rows = t.embeddings.select(F.concat(F.lit("repo"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"))
    return vectors.similarity_graph(rows).withColumn("score", F.round("score", 6))


@query("SELECT c.node_id, n.id FROM (SELECT DISTINCT node_id, repo FROM commits) c JOIN nodes n ON n.repo = c.repo AND n.file = 'src/building/m3.rs'")
def j32_bridge(t):
    hits = t.commits.select("node_id", "repo", F.lit("src/building/m3.rs").alias("file")).distinct()
    return hits.join(t.nodes.select("repo", "file", "id"), ["repo", "file"]).select("node_id", "id")


# aggregates
@query("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT file) FROM nodes WHERE file <> '') AS files")
def a1_stats(t):
    return graph(t).stats()


@query("SELECT coalesce(nullif(language, ''), '(unknown)') AS language, count(DISTINCT file) AS files FROM nodes WHERE file <> '' GROUP BY ALL")
def a1_languages(t):
    return graph(t).languages()


@query("SELECT kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT concat('edge:', kind), count(*) FROM edges GROUP BY kind")
def a2_kinds(t):
    g = graph(t)
    return g.node_kinds().unionByName(g.edge_kinds().withColumn("kind", F.concat(F.lit("edge:"), "kind")))


@query("SELECT topic, count(DISTINCT node_id) AS commits FROM tagged GROUP BY topic")
def a3_topics(t):
    return atlas.topics(t.tagged)


@query("SELECT node_id, count(*) AS files FROM touched GROUP BY node_id")
def a4_touched(t):
    return t.touched.groupBy("node_id").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT count(*) AS n FROM commits")
def a5_commit_count(t):
    return t.commits.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT day FROM waka")
def a6_days(t):
    return atlas.days(t.waka)


@query("SELECT * FROM (SELECT dimension, name, seconds::BIGINT AS seconds, row_number() OVER (PARTITION BY dimension ORDER BY seconds DESC, name)::INT AS place, (sum(seconds) OVER (PARTITION BY dimension))::BIGINT AS total FROM (SELECT dimension, CASE name WHEN 'name1' THEN 'merged' WHEN 'name2' THEN 'merged' ELSE name END AS name, sum(seconds) AS seconds FROM waka GROUP BY ALL)) WHERE place <= 10")
def a7_effort_breakdown(t):
    return atlas.effort_breakdown(t.waka, {"name1": "merged", "name2": "merged"})


@query("SELECT 'vectors' AS space, concat('m', CAST(label % 3 AS VARCHAR)) AS model, count(*) AS n, max(len(embedding))::INT AS dim FROM embeddings GROUP BY ALL")
def a8_embedding_index(t):
    rows = t.embeddings.select(F.lit("vectors").alias("space"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"), F.col("embedding").alias("vector"))
    return tables.embedding_index(rows)


IMPACT = traverse.impact_sql(traverse.CROSS_BOUNDARY, "SELECT id FROM nodes WHERE id IN ('sym:11', 'sym:48', 'tab:5', 'sym:300')", "all_edges")
ALL_EDGES = "all_edges AS (SELECT * FROM edges UNION ALL SELECT * FROM data_edges)"
IMPACT = f"WITH {ALL_EDGES},\n" + IMPACT[5:]
ITEMS = f"items AS (SELECT n.id, distance, CASE WHEN r >= 2 THEN 'extracted' ELSE 'inferred' END AS min_confidence, path, name, kind, file, {Q.classified()} AS class, len(list_filter(path, lambda k: k IN ('invokes', 'reads', 'writes'))) > 0 AS cross_boundary FROM reached r JOIN nodes n USING (id))"


def _impact(t):
    seeds = t.nodes.filter(F.col("id").isin("sym:11", "sym:48", "tab:5", "sym:300")).select("id")
    return impact.classified(t.nodes, t.edges.unionByName(t.data_edges), seeds)


@query(f"{IMPACT}, {ITEMS} SELECT id, distance, min_confidence, array_to_string(path, '>') AS path, class, cross_boundary FROM items", name="impact")
def g1_impact(t):
    return _impact(t).select("id", "distance", "min_confidence", F.array_join("path", ">").alias("path"), "class", "cross_boundary")


LEVEL = "CASE WHEN total = 0 THEN 'none' WHEN total >= 50 AND (api > 0 OR cross_boundary > 0) THEN 'critical' WHEN total >= 50 OR api > 0 OR cross_boundary > 0 THEN 'high' WHEN total >= 10 THEN 'medium' ELSE 'low' END"


@query(f"{IMPACT}, {ITEMS}, s AS (SELECT count(*) AS total, count(*) FILTER (class = 'test') AS tests, count(*) FILTER (class = 'api') AS api, count(*) FILTER (class = 'entrypoint') AS entrypoints, count(*) FILTER (class = 'internal') AS internal, count(*) FILTER (cross_boundary) AS cross_boundary, coalesce(max(distance), 0) AS max_distance FROM items) SELECT {LEVEL} AS level, * FROM s")
def a9_impact_summary(t):
    return impact.summary(_impact(t))


EXTRACTED = traverse.impact_sql(traverse.IN_PROCESS, "SELECT id FROM symbols WHERE k % 100 = 0", "edges", 4, 2)


@query(f"{EXTRACTED} SELECT id, distance, array_to_string(path, '>') AS path FROM reached")
def g1_extracted_only(t):
    return traverse.impact(t.edges, t.symbols.filter("k % 100 = 0").select("id"), max_depth=4, min_confidence="extracted").select("id", "distance", F.array_join("path", ">").alias("path"))


@query("""
  WITH RECURSIVE walk AS (SELECT id, 0 AS d FROM symbols WHERE name = 'main' UNION SELECT dst, d + 1 FROM walk JOIN edges ON src = id AND edges.kind = 'calls' WHERE d < 6)
  SELECT id, min(d) AS distance FROM walk GROUP BY id HAVING min(d) > 0""")
def g4_reachable(t):
    return traverse.reachable(t.edges, t.symbols.filter("name = 'main'").select("id"), "calls", True, 6)


@query("""
  WITH seeds AS (SELECT id FROM nodes WHERE name = 'main'),
  hops AS (SELECT src AS id, kind AS edge_kind, 'in' AS direction, confidence FROM edges WHERE dst IN (SELECT id FROM seeds) UNION ALL SELECT dst, kind, 'out', confidence FROM edges WHERE src IN (SELECT id FROM seeds))
  SELECT id, edge_kind, direction, min(h.confidence) AS confidence, any_value(n.kind) AS kind FROM hops h JOIN nodes n USING (id) GROUP BY id, edge_kind, direction""")
def g6_around(t):
    return graph(t).around("main", None, None).select("id", "edge_kind", "direction", "confidence", "kind")


CROSS = """cross_edges AS (
    SELECT DISTINCT from_node AS src, e.node_id AS dst, 'imports' AS kind, 'inferred' AS confidence FROM uses u JOIN exports e ON e.package = u.package AND e.name = u.symbol AND e.repo <> u.repo),
  fed AS (SELECT * FROM edges UNION ALL SELECT * FROM cross_edges)"""
FEDERATED = f"WITH {CROSS},\n" + traverse.impact_sql(traverse.IN_PROCESS, "SELECT node_id AS id FROM exports WHERE repo = 'repo3'", "fed", 3)[5:]


def _federated(t):
    links = resolve.package_links(t.uses, t.packages, t.exports).filter("kind = 'symbol'")
    cross = links.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"), F.lit("imports").alias("kind"), F.lit("inferred").alias("confidence")).distinct()
    seeds = t.exports.filter("repo = 'repo3'").select(F.col("node_id").alias("id")).distinct()
    items = impact.classified(t.nodes, t.edges.unionByName(cross), seeds, traverse.IN_PROCESS, 3)
    return items.join(t.nodes.select("id", "repo"), "id")


@query(f"{FEDERATED}, {ITEMS} SELECT i.id, n.repo, distance, min_confidence, class FROM items i JOIN nodes n USING (id)")
def g7_federated_impact(t):
    return _federated(t).select("id", "repo", "distance", "min_confidence", "class")


@query(f"""{FEDERATED}, {ITEMS}, r AS (SELECT i.*, n.repo FROM items i JOIN nodes n USING (id)),
  s AS (SELECT count(*) AS total, count(*) FILTER (class = 'test') AS tests, count(*) FILTER (class = 'api') AS api, count(*) FILTER (class = 'entrypoint') AS entrypoints, count(*) FILTER (class = 'internal') AS internal, count(*) FILTER (cross_boundary) AS cross_boundary, coalesce(max(distance), 0) AS max_distance, count(DISTINCT repo) FILTER (repo <> 'repo3') AS downstream_repos FROM r),
  l AS (SELECT *, CASE {LEVEL} WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS x, CASE WHEN downstream_repos = 0 THEN 0 WHEN downstream_repos < 5 THEN 2 ELSE 3 END AS y FROM s)
  SELECT ['none', 'low', 'medium', 'high', 'critical'][greatest(x, y) + 1] AS level, * EXCLUDE (x, y) FROM l""")
def a10_federated_summary(t):
    return impact.federated_summary(_federated(t), "repo3")


@query("""
  WITH RECURSIVE l AS (SELECT DISTINCT p.repo AS producer, u.repo AS consumer FROM uses u JOIN packages p ON p.package = u.package AND p.repo <> u.repo ),
  w AS (SELECT 'repo3' AS repo, 0 AS d UNION SELECT consumer, d + 1 FROM w JOIN l ON producer = w.repo WHERE d < 5)
  SELECT repo AS id, min(d) AS distance FROM w GROUP BY repo HAVING min(d) > 0""")
def g9_repo_reachability(t):
    links = resolve.package_links(t.uses, t.packages, t.exports).select(F.col("to_repo").alias("src"), F.col("from_repo").alias("dst")).distinct().withColumn("kind", F.lit("feeds"))
    return traverse.reachable(links, t.spark.createDataFrame([("repo3",)], "id string"), "feeds")


@query("""
  WITH k AS (SELECT repo, count(*) FILTER (kind IN ('function', 'method')) AS functions, count(*) FILTER (kind IN ('class', 'struct', 'interface', 'enum', 'trait')) AS types, count(*) FILTER (kind = 'endpoint') AS endpoints FROM nodes GROUP BY repo),
  s AS (SELECT repo, min(committed_at) AS first, max(committed_at) AS last, string_agg(DISTINCT y, ',' ORDER BY y) AS years FROM (SELECT *, year(to_timestamp(committed_at) AT TIME ZONE 'UTC') AS y FROM commits) GROUP BY repo),
  d AS (SELECT repo, package AS v, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, package) AS p FROM uses GROUP BY repo, package),
  g AS (SELECT repo, topic AS v, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, topic) AS p FROM tagged JOIN commits USING (node_id) GROUP BY repo, topic)
  SELECT k.*, first, last, years, (SELECT string_agg(v, ',' ORDER BY p) FROM d WHERE d.repo = k.repo AND p <= 15) AS dependencies, (SELECT string_agg(v, ',' ORDER BY p) FROM g WHERE g.repo = k.repo AND p <= 12) AS topics FROM k LEFT JOIN s USING (repo)""")
def a11_repo_digest(t):
    out = atlas.repo_digest(t.nodes, t.commits, t.uses.select("repo", F.col("package").alias("raw")), t.tagged)
    return out.select("repo", "functions", "types", "endpoints", "first", "last", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("years", "dependencies", "topics")])


@query("""
  WITH x AS (SELECT node_id, unnest(string_split(regexp_extract(lower(path), '^(.*)/[^/]*$', 1), '/')) AS v, 0 AS o FROM touched UNION ALL SELECT node_id, regexp_extract(lower(path), '[.]([^./]{1,8})$', 1), 1 FROM touched),
  m AS (SELECT node_id, o, v, count(*) AS m FROM x WHERE v <> '' GROUP BY node_id, o, v),
  c AS (SELECT node_id, o, v, row_number() OVER (PARTITION BY node_id, o ORDER BY m DESC, v) AS p FROM m)
  SELECT node_id, string_agg(v, ' ' ORDER BY o, p) AS digest FROM c WHERE (o = 0 AND p <= 12) OR (o = 1 AND p <= 8) GROUP BY node_id""")
def a13_paths_digest(t):
    return atlas.paths_digest(t.touched)


@query("SELECT repo, package, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM exports GROUP BY ALL")
def a14_exports_per_package(t):
    return t.exports.groupBy("repo", "package").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@query("SELECT name, min(file) AS file FROM symbols GROUP BY name HAVING count(DISTINCT file) = 1")
def a15_unambiguous(t):
    return t.symbols.groupBy("name").agg(F.min("file").alias("file"), F.countDistinct("file").alias("n")).filter("n = 1").select("name", "file")


@query(f"SELECT author, count(*) AS commits, min(committed_at) AS first, max(committed_at) AS last FROM (SELECT {Q.email('author_email')} AS author, committed_at FROM commits) GROUP BY author ORDER BY commits DESC, author LIMIT 10")
def a16_authors(t):
    return atlas.authors(t.commits)


@query("SELECT 'health' AS facet, health AS value, count(*) AS n FROM repos GROUP BY ALL UNION ALL SELECT 'group', grp, count(*) FROM repos GROUP BY ALL")
def a17_repo_summary(t):
    return atlas.repo_summary(t.repos)


@query(f"SELECT node_id, hash, committed_at FROM commits JOIN repos USING (repo) WHERE visibility <> 'proprietary' ORDER BY committed_at DESC, node_id DESC LIMIT 25")
def o5_timeline_newest(t):
    return atlas.shown(atlas.gated(t.commits, t.repos), 25).select("node_id", "hash", "committed_at")


@query("SELECT q.vec_id AS query_id, e.vec_id AS id, place FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, LATERAL (SELECT vec_id, row_number() OVER (ORDER BY round(list_cosine_similarity(x.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, vec_id)::INT AS place FROM embeddings x WHERE x.vec_id <> q.vec_id) e WHERE place <= 10")
def o6_vector_topk(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return vectors.nearest(rows, q).select("query_id", "id", "place")


@query(f"{IMPACT}, {ITEMS}, p AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY distance, min_confidence DESC, id) AS place, count(*) OVER (PARTITION BY class) AS n FROM items) SELECT class, place::INT AS place, id, distance, greatest(n - 5, 0) AS more FROM p WHERE place <= 5")
def o9_report_sections(t):
    return impact.report_sections(_impact(t), 5).select("class", "place", "id", "distance", "more")


# set operations and incremental updates
@query("SELECT file AS path, CASE WHEN k % 10 = 0 THEN 'removed' WHEN k % 10 = 1 THEN 'changed' ELSE 'added' END AS change FROM (SELECT file, min(k) AS k FROM symbols GROUP BY file) WHERE k % 10 < 3")
def u5_changed_files(t):
    f = t.symbols.groupBy(F.col("file").alias("path")).agg(F.min("k").alias("k"))
    stored = f.filter("k % 10 <> 2").select("path", F.lit("h").alias("hash"))
    current = f.filter("k % 10 <> 0").select("path", F.expr("case when k % 10 = 1 then 'g' else 'h' end").alias("hash"))
    return tables.changed_files(stored, current)


@query("SELECT src, dst, kind, confidence FROM edges WHERE NOT (src IN (SELECT id FROM nodes WHERE file = 'src/building/m3.rs') OR dst IN (SELECT id FROM nodes WHERE file = 'src/building/m3.rs'))")
def k5_delete_file(t):
    gone = t.spark.createDataFrame([("src/building/m3.rs",)], "file string")
    return tables.delete_files(t.nodes, t.edges, gone)[1]


@query("SELECT src, dst, kind, CASE WHEN kind = 'calls' THEN 'extracted' ELSE confidence END AS confidence FROM edges")
def k3_upsert_edges(t):
    raised = t.edges.filter("kind = 'calls'").withColumn("confidence", F.lit("extracted"))
    lowered = t.edges.withColumn("confidence", F.lit("inferred"))
    return tables.upsert_edges(t.edges, raised.unionByName(lowered))


@query("SELECT id, CASE WHEN k % 4 = 0 THEN 'renamed' ELSE name END AS name FROM symbols")
def k2_upsert_nodes(t):
    s = t.symbols
    new = s.filter("k % 4 = 0").withColumn("name", F.lit("renamed"))
    return tables.upsert(s, new, ["id"], F.col("k")).select("id", "name")


@query("SELECT node_id, committed_at BETWEEN 890000000 AND 920000000 AS in_bounds FROM commits")
def k6_mark_bounds(t):
    return atlas.mark_bounds(t.commits, 890000000, 920000000).select("node_id", "in_bounds")


@query("SELECT repo, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY k) AS o FROM commits) WHERE repo = 'repo24' OR o > 100 GROUP BY repo")
def t3_watermark(t):
    from pyspark.sql import Window as W

    from graphwright.streaming.incremental import new_commits

    log = t.commits.withColumn("ordinal", F.row_number().over(W.partitionBy("repo").orderBy("k")))
    heads = log.filter("ordinal = 100").select("repo", F.when(F.col("repo") == "repo24", "rewritten").otherwise(F.col("hash")).alias("head"))
    return new_commits(log, heads).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_activity(t):
    from graphwright.streaming.incremental import activity

    return activity(t.events).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# scalar functions
@query(f"SELECT page_id, {Q.normalized('raw')} AS normalized, {Q.signature('raw')} AS signature FROM raw_paths")
def c1_c2_paths(t):
    return t.raw_paths.select("page_id", text.normalize_path(F.col("raw")).alias("normalized"), text.path_signature(F.col("raw")).alias("signature"))


@query(f"SELECT page_id, {Q.operation('protocol', 'method', 'op_path')} AS signature FROM raw_paths")
def c3_signature(t):
    return t.raw_paths.select("page_id", text.operation_signature(F.col("protocol"), F.col("method"), F.col("op_path")).alias("signature"))


@query("SELECT node_id, CASE WHEN path = '/api' THEN '/v2' WHEN starts_with(path, '/api/') THEN '/v2' || substr(path, 5) END AS rewritten FROM (SELECT node_id, regexp_replace(path, '/$', '') AS path FROM operations)")
def c4_rewrite(t):
    return t.operations.select("node_id", text.rewrite_prefix(F.col("path"), "/api/", "v2").alias("rewritten"))


@query(f"SELECT doc_id, md5({Q.scrubbed('text')}) AS digest FROM documents")
def c5_scrub(t):
    return t.documents.select("doc_id", F.md5(text.scrub_secrets(F.col("text"))).alias("digest"))


@query("SELECT node_id FROM commits WHERE regexp_matches(lower(author_email), '^dev[.].*7.*@example[.]...$')")
def c6_glob(t):
    return t.commits.filter(text.glob_match(F.col("author_email"), "DEV.*7*@example.???")).select("node_id")


@query(f"SELECT node_id, {Q.email('author_email')} AS email FROM commits")
def c7_email(t):
    return t.commits.select("node_id", text.canonical_email(F.col("author_email")).alias("email"))


@query(f"SELECT doc_id, len({Q.tokens('text')})::INT AS n, md5(array_to_string({Q.tokens('text')}, ' ')) AS digest FROM documents")
def c8_tokens(t):
    tokens = text.lexical_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(tokens).alias("n"), F.md5(F.array_join(tokens, " ")).alias("digest"))


@query(f"WITH f AS (SELECT node_id, list(path ORDER BY path) AS files FROM touched GROUP BY node_id) SELECT node_id, array_to_string({Q.topics('subject', 'files')}, ',') AS topics FROM commits JOIN f USING (node_id)")
def c9_topics(t):
    files = t.touched.groupBy("node_id").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return t.commits.join(files, "node_id").select("node_id", F.array_join(text.derive_topics(F.col("subject"), F.col("files")), ",").alias("topics"))


@query("SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])License($|[^A-Za-z0-9_])') AS found, regexp_matches(upper(text), 'NOTE|WHY|HACK|TODO|FIXME') AS marked FROM documents")
def c10_c16_contains(t):
    return t.documents.select("doc_id", text.contains_identifier(F.col("text"), "License").alias("found"), text.has_marker(F.col("text")).alias("marked"))


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages")
def c15_host(t):
    return t.pages.select("page_id", text.host_of(F.col("url")).alias("host"))


@query("SELECT id, substr(sha256(CAST(kind || chr(0) || file || chr(0) || name || chr(0) AS BLOB)), 1, 16) AS node FROM symbols")
def c18_node_id(t):
    return t.symbols.select("id", hashing.node_id(F.col("kind"), F.col("file"), F.col("name")).alias("node"))


@query(f"SELECT id, lpad(lower(hex(({Q.fnv1a('qualified_name')})::UBIGINT)), 16, '0') AS fnv FROM symbols")
def c19_fnv1a(t):
    return t.symbols.select("id", hashing.fnv1a(F.col("qualified_name")).alias("fnv"))


@query(f"SELECT repo, {Q.uuid5("concat('forge.example/', label)")} AS uuid FROM repos")
def c20_repo_uuid(t):
    return t.repos.select("repo", hashing.repo_uuid(F.concat(F.lit("forge.example/"), F.col("label"))).alias("uuid"))


@query("SELECT node_id, strftime(make_timestamp(committed_at * 1000000), '%Y-%m-%d') AS day, committed_at - committed_at % 86400 AS start, committed_at - committed_at % 86400 + 86399 AS stop FROM commits")
def c21_c22_dates(t):
    day = dates.day_of(F.col("committed_at"))
    return t.commits.select("node_id", day.alias("day"), dates.day_start(day).alias("start"), dates.day_end(day).alias("stop"))


def _cells(rows, key):
    """The cells of vectors that aren't zero."""
    return rows.select(key, F.posexplode("vector").alias("bucket", "x")).filter("x <> 0").select(key, "bucket", F.round(F.col("x").cast("double"), 4).alias("x"))


@query(f"""
  WITH w AS (SELECT node_id, unnest({Q.tokens('subject')}) AS t FROM commits),
  f AS (SELECT node_id, (({Q.fnv1a('t')}) % 64)::INT AS bucket, count(*) AS n FROM w GROUP BY ALL),
  v AS (SELECT node_id, bucket, 1 + ln(n) AS x FROM f)
  SELECT node_id, bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY node_id)), 4) AS x FROM v""")
def c24_hashing_embedder(t):
    return _cells(t.commits.select("node_id", vectors.hashing_embedder(64)(F.col("subject")).alias("vector")), "node_id")


@query(f"""
  WITH p AS (SELECT repo AS key, concat('nk:', kind) AS f, count(*) AS n FROM nodes GROUP BY ALL),
  c AS (SELECT key, (({Q.fnv1a('f')}) % 64)::INT AS bucket, sum(sqrt(n)) AS x FROM p GROUP BY ALL)
  SELECT key, bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY key)), 4) AS x FROM c""")
def c25_structural_embedder(t):
    profile = t.nodes.groupBy(F.col("repo").alias("key"), F.lit("nk").alias("facet"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return _cells(vectors.structural_vectors(profile, 64), "key")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2")
def c26_cosine(t):
    other = t.embeddings.select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(other, F.floor(F.col("vec_id") / 2) == F.col("other_id")).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
