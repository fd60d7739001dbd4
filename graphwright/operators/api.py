"""API boundaries: matching clients, endpoints and schema operations by signature; drift; links between repositories.

operations(node_id, repo, kind, protocol, method, path) with kind endpoint, client_call or schema_op.  All joins are
equi-joins on the precomputed signature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphwright.functions.text import external_candidates, has_literal_segment, operation_signature, path_signature
from graphwright.operators.graph import unrank


def signed(operations: DataFrame) -> DataFrame:
    return operations.withColumn("signature", operation_signature(F.col("protocol"), F.col("method"), F.col("path")))


def of_kind(operations: DataFrame, kind: str, protocol: str | None = None) -> DataFrame:
    rows = operations.filter(F.col("kind") == kind)
    if protocol is not None:
        if protocol not in ("rest", "grpc", "graphql", "websocket"):
            raise ValueError(f"unknown protocol {protocol!r}")
        rows = rows.filter(F.col("protocol") == protocol)
    return rows


def match(calls: DataFrame, endpoints: DataFrame, rewrites: list[tuple[str, str]] = (), gateways: list[str] = (), heuristic: bool = True) -> DataFrame:
    """(client, endpoint, confidence): endpoints reach as far as prefix rewrites take them; exact matches hide inferred ones."""
    rest = endpoints.filter("protocol = 'rest'").withColumn("c", F.explode(external_candidates(F.col("path"), list(rewrites), list(gateways), heuristic)))
    rest = signed(rest.withColumn("path", F.col("c.path"))).select("node_id", "signature", F.col("c.rank").alias("r"))
    other = signed(endpoints.filter("protocol <> 'rest'")).select("node_id", "signature", F.lit(2).alias("r"))
    index = rest.unionByName(other).select(F.col("node_id").alias("endpoint"), "signature", "r")
    pairs = signed(calls).select(F.col("node_id").alias("client"), "signature").join(index, "signature").groupBy("client", "endpoint").agg(F.max("r").alias("r"))
    best = F.max("r").over(W.partitionBy("client"))
    return pairs.withColumn("best", best).filter("r = best").select("client", "endpoint", unrank(F.col("r")).alias("confidence"))


def invokes(operations: DataFrame, **how) -> DataFrame:
    """Edges from client calls to endpoints."""
    found = match(of_kind(operations, "client_call"), of_kind(operations, "endpoint"), **how)
    return found.select(F.col("client").alias("src"), F.col("endpoint").alias("dst"), F.lit("invokes").alias("kind"), "confidence")


def exposes(operations: DataFrame, **how) -> DataFrame:
    """Edges from endpoints to the schema operations that declare them."""
    found = match(of_kind(operations, "schema_op"), of_kind(operations, "endpoint"), **how)
    return found.select(F.col("endpoint").alias("src"), F.col("client").alias("dst"), F.lit("exposes").alias("kind"), "confidence")


def mounts(routers: DataFrame, definitions: DataFrame) -> DataFrame:
    """Edges from routers(id, file, name), mounted under a name, to definitions(id, file, name) in the same file."""
    d = definitions.select(F.col("id").alias("dst"), "file", "name")
    return routers.withColumnRenamed("id", "src").join(d, ["file", "name"]).filter("src <> dst").select("src", "dst", F.lit("mounts").alias("kind"), F.lit("inferred").alias("confidence"))


def operations_matching(operations: DataFrame, path: str, method: str | None = None) -> DataFrame:
    """Operations whose path has the same shape, and the method if one is given."""
    rows = operations.filter(path_signature(F.col("path")) == path_signature(F.lit(path)))
    return rows if method is None else rows.filter(F.col("method") == method)


def _handlers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.filter("kind = 'handles'").join(nodes.select(F.col("id").alias("src"), "qualified_name"), "src").select(F.col("dst").alias("node_id"), F.col("src").alias("handler"), "qualified_name")


def serves(operations: DataFrame, edges: DataFrame, nodes: DataFrame, path: str, method: str | None = None) -> DataFrame:
    """Endpoints that match, with their first handler by qualified name, or null."""
    first = _handlers(edges, nodes).groupBy("node_id").agg(F.min("qualified_name").alias("handler"))
    return operations_matching(of_kind(operations, "endpoint"), path, method).join(first, "node_id", "left").select("node_id", "method", "path", "handler")


def who_calls(operations: DataFrame, calls: DataFrame, path: str, method: str | None = None) -> DataFrame:
    """Clients of the endpoints that match; calls are invokes edges."""
    endpoints = operations_matching(of_kind(operations, "endpoint"), path, method).select(F.col("node_id").alias("dst"), F.col("path").alias("endpoint_path"))
    clients = of_kind(operations, "client_call").select(F.col("node_id").alias("src"), "repo", "method", "path")
    return calls.join(endpoints, "dst").join(clients, "src").select("src", "dst", "repo", "method", "path", "confidence")


def unmatched_clients(operations: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """REST calls that reach no endpoint, the function around each, and why."""
    rows = signed(of_kind(operations, "client_call", "rest")).join(calls.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_anti")
    caller = edges.filter("kind = 'calls'").groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("caller"))
    reason = F.when(has_literal_segment(F.col("signature")), "no endpoint").otherwise("dynamic path")
    return rows.join(caller, "node_id", "left").select("node_id", "method", "path", "caller", reason.alias("reason"))


def drift(operations: DataFrame, exposed: DataFrame, require_schema: bool = True) -> DataFrame:
    """Endpoints that no schema operation declares (undocumented), and operations that no endpoint serves (unimplemented).

    With require_schema nothing is undocumented where there is no schema at all.
    """
    endpoints, schema = of_kind(operations, "endpoint"), of_kind(operations, "schema_op")
    undocumented = endpoints.join(exposed.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_anti")
    if require_schema:
        undocumented = undocumented.join(schema.limit(1).select(F.lit(1).alias("any")))
    unimplemented = schema.join(exposed.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_anti")
    cols = ["node_id", "method", "path"]
    return undocumented.select(*cols, F.lit("undocumented").alias("drift")).unionByName(unimplemented.select(*cols, F.lit("unimplemented").alias("drift")))


def api_impact(operations: DataFrame, edges: DataFrame, nodes: DataFrame, calls: DataFrame, exposed: DataFrame) -> DataFrame:
    """Each endpoint with its handlers, callers and schema operations (sorted arrays)."""

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("node_id").agg(F.sort_array(F.collect_set("x")).alias(name))

    handlers = gathered(_handlers(edges, nodes).select("node_id", F.col("handler").alias("x")), "handlers")
    callers = gathered(calls.select(F.col("dst").alias("node_id"), F.col("src").alias("x")), "callers")
    schema = gathered(exposed.select(F.col("src").alias("node_id"), F.col("dst").alias("x")), "schema_ops")
    out = of_kind(operations, "endpoint")
    for rows in (handlers, callers, schema):
        out = out.join(rows, "node_id", "left")
    none = F.array().cast("array<string>")
    return out.select("node_id", "method", "path", *[F.coalesce(c, none).alias(c) for c in ("handlers", "callers", "schema_ops")])


def web_links(operations: DataFrame) -> DataFrame:
    """(from_repo, client, to_repo, endpoint): REST calls that meet endpoints of other repositories on a literal path."""
    rows = signed(operations.filter("protocol = 'rest'")).filter(has_literal_segment(F.col("signature")))
    c = of_kind(rows, "client_call").select(F.col("repo").alias("from_repo"), F.col("node_id").alias("client"), "signature")
    e = of_kind(rows, "endpoint").select(F.col("repo").alias("to_repo"), F.col("node_id").alias("endpoint"), "signature")
    return c.join(e, "signature").filter("from_repo <> to_repo").select("from_repo", "client", "to_repo", "endpoint")


def repo_links(links: DataFrame) -> DataFrame:
    return links.select("from_repo", "to_repo").distinct()


def hinted_links(hints: DataFrame, nodes: DataFrame, operations: DataFrame) -> DataFrame:
    """Links by hand: hints(hint, side, repo, symbol, signature), sides from and to; every source node with every target node of a hint."""
    named = nodes.select(F.col("repo").alias("r"), "id", "name", "qualified_name")
    by_name = hints.join(named, (F.col("repo") == F.col("r")) & (F.col("symbol") == F.col("name"))).select("hint", "side", "repo", "id")
    by_qualified = hints.join(named, (F.col("repo") == F.col("r")) & (F.col("symbol") == F.col("qualified_name"))).select("hint", "side", "repo", "id")
    ops = signed(operations).select(F.col("repo").alias("r"), F.col("node_id").alias("id"), F.col("signature").alias("s"))
    by_endpoint = hints.join(ops, (F.col("repo") == F.col("r")) & (F.col("signature") == F.col("s"))).select("hint", "side", "repo", "id")
    sides = by_name.unionByName(by_qualified).unionByName(by_endpoint).distinct()
    a = sides.filter("side = 'from'").select("hint", F.col("repo").alias("from_repo"), F.col("id").alias("src"))
    b = sides.filter("side = 'to'").select("hint", F.col("repo").alias("to_repo"), F.col("id").alias("dst"))
    return a.join(b, "hint")


def dead_hints(hints: DataFrame, links: DataFrame) -> DataFrame:
    """How many hints resolve to nothing."""
    return hints.select("hint").distinct().join(links.select("hint").distinct(), "hint", "left_anti").agg(F.count(F.lit(1)).alias("dead"))
