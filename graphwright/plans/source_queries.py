"""Queries over sources, extractors and stored state; texts are made from the driver's tables, so that SQL knows what they say."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwright.functions import text
from graphwright.operators import resolve, tables
from graphwright.plans import cypher
from graphwright.plans import sqltext as Q
from graphwright.plans.queries import graph, query
from graphwright.sources import code, history, manifests, schemas
from graphwright.sources.sqltext import access


@query(f"SELECT id, {Q.language('file')} AS language FROM symbols")
def s5_language(t):
    return t.symbols.select("id", text.language_of(F.col("file")).alias("language"))


RUST = "concat('// part ', CAST(p_partkey AS STRING), chr(10), 'pub fn ', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING), '() {', chr(10), '    helper_', CAST(p_partkey % 50 AS STRING), '();', chr(10), '}', chr(10))"


def _rust_files(t):
    """Dealt out, as a table of parts is small for the work on its files."""
    rows = t.sql(f"SELECT concat('src/f', CAST(p_partkey AS STRING), '.rs') AS path, 'rust' AS language, concat({RUST}, 'struct S', CAST(p_partkey AS STRING), ';', chr(10)) AS text FROM part")
    return rows.repartition("path")


@query("""
  SELECT concat('src/f', CAST(p_partkey AS VARCHAR), '.rs') AS path, 'function' AS kind, concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR)) AS name, 2 AS start_line, 4 AS end_line FROM part
  UNION ALL SELECT concat('src/f', CAST(p_partkey AS VARCHAR), '.rs'), 'struct', concat('S', CAST(p_partkey AS VARCHAR)), 5, 5 FROM part""")
def s6_extract_definitions(t):
    return code.facts(_rust_files(t)).filter("fact = 'def'").select("path", "kind", "name", "start_line", "end_line")


@query("SELECT concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR)) AS caller, concat('helper_', CAST(p_partkey % 50 AS VARCHAR)) AS callee FROM part")
def x1_calls_by_span(t):
    nodes, _, pending = code.graph_of(code.facts(_rust_files(t)), "r")
    return pending.filter("kind = 'calls'").join(nodes.select(F.col("id").alias("anchor"), F.col("name").alias("caller")).hint("merge"), "anchor").select("caller", F.col("name").alias("callee"))


ROUTE = "concat('@app.', CASE p_partkey % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'post' ELSE 'delete' END, '(\"/', replace(p_name, ' ', '/'), '/{id}\")', chr(10), 'def h', CAST(p_partkey AS STRING), '(id):', chr(10), '    return requests.get(\"https://', lower(p_brand), '.example/x/\" + id)', chr(10))"


@query("""
  SELECT concat('api/p', CAST(p_partkey AS VARCHAR), '.py') AS file, 'endpoint' AS kind, CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS method, concat('/', replace(p_name, ' ', '/'), '/{id}') AS path, concat('h', CAST(p_partkey AS VARCHAR)) AS handler FROM part
  UNION ALL SELECT concat('api/p', CAST(p_partkey AS VARCHAR), '.py'), 'client_call', 'GET', concat('https://', lower(p_brand), '.example/x/'), NULL FROM part""")
def x3_x7_routes_and_clients(t):
    files = t.sql(f"SELECT concat('api/p', CAST(p_partkey AS STRING), '.py') AS path, 'python' AS language, {ROUTE} AS text FROM part")
    return code.operations_of(code.facts(files), "r").select("file", "kind", "method", "path", "handler")


STATEMENT = "CASE o_orderkey % 4 WHEN 0 THEN concat('SELECT * FROM t', CAST(o_custkey AS STRING), ' x JOIN \"S\".u ON true -- from no') WHEN 1 THEN concat('INSERT INTO t', CAST(o_custkey AS STRING), ' SELECT * FROM s.u') WHEN 2 THEN concat('DELETE FROM T', CAST(o_custkey AS STRING), ' WHERE x = ''from y''') ELSE concat('update only t', CAST(o_custkey AS STRING), ' set a = 1; select 1 from s.u') END"


@query("""
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'read' ELSE 'write' END AS access, concat('t', CAST(o_custkey AS VARCHAR)) AS name FROM orders
  UNION ALL SELECT o_orderkey, 'read', 's.u' FROM orders WHERE o_orderkey % 4 <> 2""")
def x10_sql_access(t):
    kind = T.ArrayType(T.StructType([T.StructField("access", T.StringType()), T.StructField("name", T.StringType())]))

    @F.pandas_udf(kind)
    def accesses(sql: pd.Series) -> pd.Series:
        return sql.map(lambda s: [{"access": a, "name": n} for a, n in access(s)])

    rows = t.sql(f"SELECT o_orderkey, {STATEMENT} AS sql FROM orders")
    return rows.select("o_orderkey", F.explode(accesses("sql")).alias("a")).select("o_orderkey", "a.access", "a.name")


@query("""
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN array_to_string([concat('lib/', lower(c_mktsegment), e) FOR e IN ['', '.ts', '.tsx', '.d.ts', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.d.ts', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs']], ' ')
         WHEN c_custkey % 3 = 1 THEN concat('lib/', lower(c_mktsegment), '.py lib/', lower(c_mktsegment), '/__init__.py') ELSE '' END AS candidates FROM customer""")
def x16_import_candidates(t):
    c = t.customer
    raw = F.expr("case c_custkey % 3 when 0 then concat('../lib/', lower(c_mktsegment)) when 1 then concat('..lib.', lower(c_mktsegment)) else 'fmt' end")
    language = F.expr("case c_custkey % 3 when 0 then 'typescript' when 1 then 'python' else 'go' end")
    return c.select("c_custkey", F.array_join(resolve.import_candidates(F.lit("src/a.ts"), raw, language), " ").alias("candidates"))


@query("SELECT repo, hash, committed_at, subject, coalesce(f, 0)::INT AS files FROM commits LEFT JOIN (SELECT node_id, count(*) AS f FROM touched GROUP BY node_id) USING (node_id)")
def s20_git_log(t):
    files = t.touched.groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_list("path")), "\n").alias("files"))
    c = t.commits.join(files, "node_id", "left")
    head = F.concat_ws(history.FIELD, "hash", F.col("committed_at").cast("string"), F.lit("N"), "author_email", "subject", F.lit(""))
    logs = c.groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.concat(F.lit(history.RECORD), head, F.lit("\n"), F.coalesce("files", F.lit("")), F.lit("\n")).alias("r"))), asc=False), lambda x: x["r"]), "").alias("log"))
    return history.parse_log(logs).select("repo", "hash", "committed_at", "subject", F.size("files").alias("files"))


@query("WITH c AS (SELECT repo, author_email, count(*) AS n FROM commits GROUP BY repo, author_email) SELECT repo, author_email AS email, n AS commits FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, author_email) AS p FROM c) WHERE p <= 5")
def s24_contributors(t):
    return history.contributors(t.commits.select("repo", F.lit("N").alias("author"), F.col("author_email").alias("email")), 5).select("repo", "email", "commits")


@query("SELECT concat('m', CAST(s_suppkey AS VARCHAR), '/Cargo.toml') AS path, concat('pkg', CAST(s_suppkey AS VARCHAR)) AS name, 'package' AS kind FROM supplier UNION ALL SELECT concat('m', CAST(s_suppkey AS VARCHAR), '/Cargo.toml'), concat('dep', CAST(s_nationkey AS VARCHAR)), 'dependencies' FROM supplier")
def s16_manifests(t):
    files = t.sql("SELECT concat('m', CAST(s_suppkey AS STRING), '/Cargo.toml') AS path, concat('[package]', chr(10), 'name = \"pkg', CAST(s_suppkey AS STRING), '\"', chr(10), '[dependencies]', chr(10), 'dep', CAST(s_nationkey AS STRING), ' = \"1\"', chr(10)) AS text FROM supplier")
    return manifests.manifests(files).select("path", "name", "kind")


@query("SELECT concat('s', CAST(n_nationkey AS VARCHAR), '.proto') AS path, 'grpc' AS protocol, concat('p', CAST(n_regionkey AS VARCHAR), '.S/Get', CAST(n_nationkey AS VARCHAR)) AS operation FROM nation")
def s12_protobuf(t):
    files = t.sql("SELECT concat('s', CAST(n_nationkey AS STRING), '.proto') AS path, concat('package p', CAST(n_regionkey AS STRING), ';', chr(10), 'service S {', chr(10), '  rpc Get', CAST(n_nationkey AS STRING), ' (A) returns (B);', chr(10), '}', chr(10)) AS text FROM nation")
    return schemas.schema_operations(files).select("path", "protocol", "operation")


@query("SELECT a.id AS x, b.id AS y, r.confidence FROM edges r JOIN nodes a ON a.id = r.src JOIN nodes b ON b.id = r.dst WHERE r.kind = 'calls' AND a.kind = 'function' AND b.kind = 'method' AND contains(a.file, 'auto')")
def e5_cypher(t):
    g = graph(t)
    return cypher.run(g.nodes, g.edges, "MATCH (a:Function)-[r:calls]->(b:Method) WHERE a.file CONTAINS $part RETURN a.id AS x, b.id AS y, r.confidence AS confidence", {"part": "auto"})


@query("SELECT kind AS k, count(*) AS n FROM nodes WHERE language = 'rust' GROUP BY kind")
def e5_cypher_grouping(t):
    g = graph(t)
    return cypher.run(g.nodes, g.edges, "MATCH (a) WHERE a.language = 'rust' RETURN a.kind AS k, count(a) AS n ORDER BY n DESC")


@query("SELECT 'node' AS grp, count(*) AS n FROM nodes UNION ALL SELECT 'edge', count(*) FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def k11_graph_view(t):
    return tables.graph_elements(t.nodes, t.edges).groupBy(F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'old' AS space, 'm' AS model, vec_id FROM embeddings WHERE label % 2 = 0 UNION ALL SELECT 'new', 'm', vec_id FROM embeddings WHERE label % 3 = 0")
def k7_replace_namespace(t):
    e = t.embeddings.select(F.expr("case when label % 2 = 0 then 'old' else 'new' end").alias("space"), F.lit("m").alias("model"), F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    new = t.embeddings.filter("label % 3 = 0").select(F.col("vec_id").alias("ordinal"), F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    twice = new.unionByName(new.withColumn("ordinal", F.col("ordinal") + 1_000_000_000))
    return tables.replace_namespace(e, "new", "m", twice).select("space", "model", F.col("node_id").alias("vec_id"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN '' ELSE concat('h', CAST(vec_id AS VARCHAR)) END AS key FROM embeddings")
def k8_backup_keys(t):
    e = t.embeddings.select(F.col("vec_id").alias("node_id"))
    keys = e.filter("node_id % 3 <> 0").withColumn("key", F.concat(F.lit("h"), F.col("node_id").cast("string")))
    return tables.with_human_key(e, keys).select(F.col("node_id").alias("vec_id"), "key")


@query("SELECT id FROM nodes WHERE name = 'main' UNION SELECT src FROM edges WHERE kind = 'handles'")
def u1_u2_unions(t):
    a = t.nodes.filter("name = 'main'").select("id")
    return a.unionByName(t.edges.filter("kind = 'handles'").select(F.col("src").alias("id"))).dropDuplicates(["id"])


@query("SELECT hash FROM commits WHERE k % 3 = 0 OR k % 5 = 0")
def u4_merged_history(t):
    c = t.commits
    return history.merged_history(c.filter("k % 3 = 0"), c.filter("k % 5 = 0")).select("hash")


@query("""
  WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
  SELECT user_id, count(DISTINCT n) AS sessions, count(*) AS events FROM s GROUP BY user_id""")
def stream_sessions(t):
    from graphwright.streaming.incremental import sessions

    return sessions(t.events, "6 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))
