"""A deterministic code graph over the driver's star-schema tables.

Every view is one SQL text that Spark and DuckDB both run, so that queries and their SQL start from the same rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_S = "CAST({} AS STRING)"

VIEWS: dict[str, str] = {
    "n_all": "SELECT count(*) AS n FROM customer",
    "symbols": """
        SELECT c_custkey AS k, concat('repo', CAST(c_nationkey AS STRING)) AS repo, concat('sym:', CAST(c_custkey AS STRING)) AS id,
               CASE c_custkey % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'struct' WHEN 3 THEN 'function' ELSE 'trait' END AS kind,
               CASE WHEN c_custkey % 50 = 7 THEN 'main' ELSE concat(lower(substr(c_mktsegment, 1, 4)), '_', CAST(c_custkey % 97 AS STRING)) END AS name,
               concat(lower(c_mktsegment), '::', CASE WHEN c_custkey % 50 = 7 THEN 'main' ELSE concat(lower(substr(c_mktsegment, 1, 4)), '_', CAST(c_custkey % 97 AS STRING)) END) AS qualified_name,
               concat(CASE WHEN c_custkey % 11 = 0 THEN 'tests/' ELSE 'src/' END, lower(c_mktsegment), '/m', CAST(c_custkey % 40 AS STRING),
                      CASE c_custkey % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' ELSE '.go' END) AS file,
               CASE c_custkey % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' ELSE 'go' END AS language,
               CAST(10 * (c_custkey % 25) + 1 AS INT) AS start_line, CAST(10 * (c_custkey % 25) + 8 AS INT) AS end_line,
               CASE WHEN c_custkey % 7 = 0 THEN concat('Handles ', lower(c_mktsegment), ' accounts') END AS doc,
               concat('fn ', lower(c_mktsegment), '(', CAST(c_custkey % 4 AS STRING), ')') AS signature
        FROM customer""",
    "api_pages": """
        SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'endpoint' ELSE 'client_call' END AS kind,
               CASE WHEN page_id % 2 = 0 THEN concat('ep:', CAST(page_id AS STRING)) ELSE concat('call:', CAST(page_id AS STRING)) END AS id,
               concat('repo', CAST(page_id % 25 AS STRING)) AS repo,
               CASE WHEN page_id % 10 >= 8 THEN 'POST' ELSE 'GET' END AS method,
               concat(CASE WHEN page_id % 14 = 0 THEN '/api/' ELSE '/' END, regexp_extract(url, '^https?://([^/.]+)', 1), regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)) AS path,
               regexp_extract(url, '^https?://([^/?#]+)', 1) AS host
        FROM pages""",
    "operations": """
        SELECT id AS node_id, repo, kind, 'rest' AS protocol, method, path FROM api_pages
        UNION ALL
        SELECT concat('op:', CAST(page_id AS STRING)), repo, 'schema_op', 'rest', method, path FROM api_pages WHERE kind = 'endpoint' AND page_id % 6 = 0
        UNION ALL
        SELECT concat('op:x', CAST(page_id AS STRING)), repo, 'schema_op', 'rest', 'DELETE', path FROM api_pages WHERE kind = 'endpoint' AND page_id % 34 = 0""",
    "nodes": """
        SELECT repo, id, kind, name, qualified_name, file, language, start_line, end_line, doc, signature FROM symbols
        UNION ALL
        SELECT 'repo0', concat('tab:', CAST(p_partkey AS STRING)), 'table', concat('t_', CAST(p_partkey AS STRING)), concat('public.t_', CAST(p_partkey AS STRING)), 'db/schema.sql', 'sql',
               CAST(p_partkey AS INT) + 1, CAST(p_partkey AS INT) + 1, p_name, NULL FROM part
        UNION ALL
        SELECT repo, node_id, kind, concat(method, ' ', path), path, concat('api/', repo, '.yaml'), 'rest', 1, 1, NULL, NULL FROM operations
        UNION ALL
        SELECT 'repo0', concat('mod:', CAST(n_nationkey AS STRING)), 'module', n_name, n_name, '', NULL, NULL, NULL, NULL, NULL FROM nation""",
    "edges": """
        SELECT DISTINCT src, dst, kind, CASE WHEN conf = 0 THEN 'extracted' ELSE 'inferred' END AS confidence FROM (
          SELECT concat('sym:', CAST(c_custkey AS STRING)) AS src, concat('sym:', CAST((37 * c_custkey + 11) % n AS STRING)) AS dst, 'calls' AS kind, c_custkey % 2 AS conf FROM customer, n_all
          UNION ALL SELECT concat('sym:', CAST(c_custkey AS STRING)), concat('sym:', CAST((101 * c_custkey + 7) % n AS STRING)), 'references', c_custkey % 3 % 2 FROM customer, n_all WHERE c_custkey % 3 = 0
          UNION ALL SELECT concat('sym:', CAST(c_custkey AS STRING)), concat('sym:', CAST((13 * c_custkey + 5) % n AS STRING)), 'imports', 1 FROM customer, n_all WHERE c_custkey % 4 = 0
          UNION ALL SELECT concat('sym:', CAST(c_custkey AS STRING)), concat('sym:', CAST((17 * c_custkey + 3) % n AS STRING)), 'implements', 0 FROM customer, n_all WHERE c_custkey % 6 = 0
          UNION ALL SELECT concat('sym:', CAST(c_custkey AS STRING)), concat('sym:', CAST((19 * c_custkey + 1) % n AS STRING)), 'extends', 0 FROM customer, n_all WHERE c_custkey % 8 = 0
          UNION ALL SELECT concat('sym:', CAST(page_id % n AS STRING)), id, 'handles', 0 FROM api_pages, n_all WHERE kind = 'endpoint'
          UNION ALL SELECT concat('sym:', CAST((page_id * 3) % n AS STRING)), id, 'calls', 0 FROM api_pages, n_all WHERE kind = 'client_call') e""",
    "data_edges": """
        SELECT DISTINCT concat('sym:', CAST(o_custkey AS STRING)) AS src, concat('tab:', CAST(l_partkey AS STRING)) AS dst,
               CASE WHEN l_returnflag = 'R' THEN 'reads' ELSE 'writes' END AS kind, 'inferred' AS confidence
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "raw_paths": """
        SELECT page_id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN concat(path, '/:id?x=1') WHEN 2 THEN concat('/<int:uid>', path) WHEN 3 THEN concat('//{name:re}', path, '/')
               WHEN 4 THEN concat('/[...slug]', path, '/*rest') WHEN 5 THEN concat(path, '/550e8400-e29b-41d4-a716-446655440000/$', '{x}') ELSE concat(path, '/*') END AS raw,
               CASE page_id % 5 WHEN 0 THEN 'rest' WHEN 1 THEN 'grpc' WHEN 2 THEN 'graphql' WHEN 3 THEN 'websocket' ELSE 'rest' END AS protocol,
               CASE WHEN page_id % 3 = 0 THEN 'GET' END AS method,
               CASE page_id % 5 WHEN 1 THEN concat('pkg.v1.User_Service/Get_', CAST(page_id AS STRING)) WHEN 2 THEN concat(CASE WHEN page_id % 2 = 0 THEN 'Query.' ELSE '' END, 'get_User', CAST(page_id AS STRING))
               WHEN 3 THEN CASE WHEN page_id % 2 = 0 THEN concat('event:Chat_Msg', CAST(page_id AS STRING)) ELSE path END ELSE path END AS op_path
        FROM (SELECT page_id, url, concat('/', regexp_extract(url, '^https?://([^/.]+)', 1), regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)) AS path FROM pages) p""",
    "repos": """
        SELECT concat('repo', CAST(n_nationkey AS STRING)) AS repo, n_name AS label, r_name AS grp,
               CASE n_nationkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'proprietary' END AS visibility,
               CASE n_nationkey % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'stale' WHEN 2 THEN 'fresh' ELSE 'unknown' END AS health,
               concat('/work/', lower(r_name), '/', lower(n_name)) AS root
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 23""",
    "commits": """
        SELECT concat('commit:', CAST(o_orderkey AS STRING)) AS node_id, substr(md5(CAST(o_orderkey AS STRING)), 1, 12) AS hash,
               concat(CASE WHEN o_custkey % 10 = 0 THEN 'bot' ELSE 'Dev.' END, CAST(o_custkey % 200 AS STRING), CASE WHEN o_custkey % 4 = 0 THEN '+ci' ELSE '' END,
                      CASE o_custkey % 3 WHEN 0 THEN '@gmail.com' WHEN 1 THEN '@example.org' ELSE '@proton.me' END) AS author_email,
               concat('repo', CAST(c_nationkey AS STRING)) AS repo,
               CAST(epoch_s AS BIGINT) AS committed_at,
               concat(CASE o_orderstatus WHEN 'F' THEN 'Fix ' WHEN 'O' THEN 'Add ' ELSE 'Refactor ' END, lower(substr(o_orderpriority, 3)), ' path for ', lower(c_mktsegment)) AS subject,
               o_orderkey AS k
        FROM (SELECT *, {epoch} AS epoch_s FROM orders) o JOIN customer ON o_custkey = c_custkey""",
    "touched": "SELECT DISTINCT concat('commit:', CAST(l_orderkey AS STRING)) AS node_id, concat('src/', replace(p_name, ' ', '/'), '/f', CAST(l_partkey % 30 AS STRING), '.rs') AS path FROM lineitem JOIN part ON l_partkey = p_partkey",
    "tagged": "SELECT DISTINCT concat('commit:', CAST(l_orderkey AS STRING)) AS node_id, split_part(p_name, ' ', 2) AS topic FROM lineitem JOIN part ON l_partkey = p_partkey",
    "waka": "SELECT substr(CAST(ts AS STRING), 1, 10) AS day, event_type AS dimension, concat('name', CAST(user_id % 20 AS STRING)) AS name, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS seconds FROM events GROUP BY 1, 2, 3",
    "packages": "SELECT concat('repo', CAST(s_nationkey AS STRING)) AS repo, concat('pkg', CAST(s_suppkey % 60 AS STRING)) AS package, s_suppkey FROM supplier",
    "exports": "SELECT DISTINCT p.repo, p.package, concat('t_', CAST(l_partkey AS STRING)) AS name, concat('tab:', CAST(l_partkey AS STRING)) AS node_id FROM lineitem JOIN packages p ON l_suppkey = s_suppkey WHERE l_linenumber = 1",
    "uses": """
        SELECT DISTINCT concat('repo', CAST(c_nationkey AS STRING)) AS repo, concat('src/', lower(c_mktsegment), '.rs') AS from_file, concat('pkg', CAST(l_suppkey % 70 AS STRING)) AS package,
               concat('t_', CAST(l_partkey AS STRING)) AS symbol, concat('sym:', CAST(c_custkey AS STRING)) AS from_node
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linenumber = 2""",
}
#: What differs between the engines.
EPOCH = {"spark": "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)", "duckdb": "epoch(o_orderdate)"}


def needed(names: list[str]) -> list[str]:
    """The views that the named ones are made of, in order."""
    out: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name in VIEWS and name not in out:
            out.add(name)
            todo += re.findall(r"\w+", VIEWS[name])
    return [n for n in VIEWS if n in out]


def with_views(sql: str, engine: str = "duckdb") -> str:
    """SQL over the views as one statement."""
    names = needed(re.findall(r"\w+", sql))
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].replace('{epoch}', EPOCH[engine])})" for n in names)
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE') :]}"
    return f"WITH {ctes},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes}\n{body}"


class Tables:
    """The driver's tables and the views over them, as DataFrames by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        """SQL over the tables and views, which get no names in the session that others could have."""
        body = with_views(text, "spark").strip()
        used = [t for t in TABLES if t in re.findall(r"\w+", body)]
        names = {t: f"given_{uuid.uuid4().hex}" for t in used}
        for t, name in names.items():
            getattr(self, t).createTempView(name)
        ctes = ", ".join(f"{t} AS (SELECT * FROM {name})" for t, name in names.items())
        try:
            return self.spark.sql(f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}" if ctes else body)
        finally:
            for name in names.values():
                self.spark.catalog.dropTempView(name)
