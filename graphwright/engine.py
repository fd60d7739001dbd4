"""One function per verb over a set of tables; each returns a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.functions import vectors
from graphwright.operators import api, atlas, impact, resolve, tables, traverse
from graphwright.operators.graph import Graph, changed_symbols
from graphwright.plans import cypher
from graphwright.sources.history import merged_history

#: Exit code of a gate that a report fails.
GATE_EXIT = 2


@dataclass
class Engine:
    """nodes and edges; the other tables where a verb needs them."""

    nodes: DataFrame
    edges: DataFrame
    operations: DataFrame | None = None
    repos: DataFrame | None = None
    commits: DataFrame | None = None
    touched: DataFrame | None = None
    tagged: DataFrame | None = None
    waka: DataFrame | None = None
    embeddings: DataFrame | None = None
    gateways: tuple[str, ...] = ()
    rewrites: tuple[tuple[str, str], ...] = ()

    @property
    def graph(self) -> Graph:
        return Graph(self.nodes, self.edges, self.operations)

    # structure
    def definition(self, name: str) -> DataFrame:
        return self.graph.find_by_name(name)

    def callers(self, name: str) -> DataFrame:
        return self.graph.around(name, ["calls"], False)

    def callees(self, name: str) -> DataFrame:
        return self.graph.around(name, ["calls"], True)

    def neighbors(self, name: str) -> DataFrame:
        return self.graph.around(name, None, None)

    def search(self, query: str, limit: int = 50, case_sensitive: bool = False) -> DataFrame:
        return self.graph.search(query, limit, case_sensitive)

    def outline(self, prefix: str | None = None) -> DataFrame:
        return self.graph.outline(prefix)

    def reachable(self, name: str, kind: str = "calls", depth: int = traverse.MAX_DEPTH) -> DataFrame:
        """Everything that reaches a definition of the name over edges of a kind."""
        return traverse.reachable(self.edges, self.definition(name).select("id"), kind, False, depth).join(self.nodes, "id")

    def export_graph(self, node_kinds: list[str] | None = None, edge_kinds: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        return self.graph.export(node_kinds, edge_kinds, limit)

    def subgraph(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self.graph.subgraph(ids)

    def view(self, ids: DataFrame) -> DataFrame:
        return tables.graph_elements(*self.graph.subgraph(ids))

    def status(self) -> DataFrame:
        return self.graph.stats()

    def cypher(self, text: str, params: dict | None = None) -> DataFrame:
        return cypher.run(self.nodes, self.edges, text, params)

    # impact
    def impact(self, name: str, tokens: list[str] | None = None, depth: int = traverse.MAX_DEPTH, min_confidence: str = "inferred") -> DataFrame:
        return impact.classified(self.nodes, self.edges, self.definition(name).select("id"), tokens, depth, min_confidence)

    def impact_of_changes(self, changes: DataFrame, tokens: list[str] | None = None, depth: int = traverse.MAX_DEPTH) -> DataFrame:
        seeds = changed_symbols(changes, self.nodes).filter("outcome = 'seed'").select("id").distinct()
        return impact.classified(self.nodes, self.edges, seeds, tokens, depth)

    def federated_impact(self, seeds: DataFrame, uses: DataFrame, packages: DataFrame, exports: DataFrame, hints: DataFrame | None = None, depth: int = traverse.MAX_DEPTH) -> DataFrame:
        """Impact over all repositories: package, web and hand-made links ride along as inferred imports."""
        links = resolve.package_links(uses, packages, exports).filter("kind = 'symbol'").select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
        if self.operations is not None:
            links = links.unionByName(api.web_links(self.operations).select(F.col("client").alias("src"), F.col("endpoint").alias("dst")))
        if hints is not None:
            links = links.unionByName(api.hinted_links(hints, self.nodes, self.operations).select("src", "dst"))
        cross = links.distinct().select("src", "dst", F.lit("imports").alias("kind"), F.lit("inferred").alias("confidence"))
        return impact.classified(self.nodes, self.edges.unionByName(cross), seeds, None, depth).join(self.nodes.select("id", "repo"), "id")

    def gate(self, items: DataFrame) -> int:
        return GATE_EXIT if impact.fails_gate(items) else 0

    # API
    def endpoints(self, protocol: str | None = None) -> DataFrame:
        return api.of_kind(self.operations, "endpoint", protocol)

    def clients(self, protocol: str | None = None, unmatched: bool = False) -> DataFrame:
        return api.unmatched_clients(self.operations, self.invokes(), self.edges) if unmatched else api.of_kind(self.operations, "client_call", protocol)

    def invokes(self) -> DataFrame:
        return api.invokes(self.operations, rewrites=self.rewrites, gateways=self.gateways)

    def exposes(self) -> DataFrame:
        return api.exposes(self.operations, rewrites=self.rewrites, gateways=self.gateways)

    def serves(self, path: str, method: str | None = None) -> DataFrame:
        return api.serves(self.operations, self.edges, self.nodes, path, method)

    def who_calls(self, path: str, method: str | None = None) -> DataFrame:
        return api.who_calls(self.operations, self.invokes(), path, method)

    def api_impact(self) -> DataFrame:
        return api.api_impact(self.operations, self.edges, self.nodes, self.invokes(), self.exposes())

    def drift(self, require_schema: bool = True) -> DataFrame:
        return api.drift(self.operations, self.exposes(), require_schema)

    def group_links(self) -> DataFrame:
        return api.repo_links(api.web_links(self.operations))

    # histories
    def list_repos(self, **how) -> DataFrame:
        return atlas.list_repos(self.repos, **how)

    def timeline(self, topic: str | None = None, since: int | None = None, until: int | None = None, limit: int = 50, **who) -> DataFrame:
        rows = atlas.timeline(self.commits, self.touched, self.tagged, topic, since, until)
        return atlas.shown(atlas.gated(rows, self.repos, **who), limit)

    def topics(self) -> DataFrame:
        return atlas.topics(self.tagged)

    def digest(self, imports: DataFrame) -> DataFrame:
        return atlas.repo_digest(self.nodes, self.commits, imports, self.tagged)

    def effort(self, aliases: dict[str, str] | None = None, n: int = 10) -> DataFrame:
        return atlas.effort_breakdown(self.waka, aliases, n)

    def history(self, *passes: DataFrame) -> DataFrame:
        return merged_history(*passes)

    # similarity
    def embed_commits(self, dim: int = vectors.DIM) -> DataFrame:
        text = F.concat_ws(" ", "subject", "digest")
        rows = self.commits.join(atlas.paths_digest(self.touched), "node_id", "left")
        return rows.select("node_id", vectors.EMBEDDERS[vectors.LEXICAL_MODEL](dim)(text).alias("vector"))

    def embed_graph(self, dim: int = vectors.DIM) -> DataFrame:
        n = self.nodes.groupBy(F.col("repo").alias("key"), F.lit("nk").alias("facet"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        g = self.nodes.filter("language is not null").groupBy(F.col("repo").alias("key"), F.lit("lang").alias("facet"), F.col("language").alias("name")).agg(F.countDistinct("file").alias("n"))
        e = self.edges.join(self.nodes.select(F.col("id").alias("src"), "repo"), "src").groupBy(F.col("repo").alias("key"), F.lit("ek").alias("facet"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        return vectors.structural_vectors(n.unionByName(g).unionByName(e), dim)

    def similar_commits(self, text: str, k: int = 10, dim: int = vectors.DIM, **who) -> DataFrame:
        """Commits most like a text, among those that the gate lets through."""
        spark = self.nodes.sparkSession
        seen = atlas.gated(self.commits, self.repos, **who).filter("outcome = 'kept'").select(F.col("node_id").alias("id"))
        rows = self.embed_commits(dim).withColumnRenamed("node_id", "id").join(seen, "id", "left_semi")
        query = spark.createDataFrame([("query", vectors.hashed_vectors([text], dim)[0])], "query_id string, query_vector array<float>")
        return vectors.nearest(rows, query, k)

    def similar_repos(self, repo: str, k: int = 10, dim: int = vectors.DIM, public_only: bool = False) -> DataFrame:
        """The repositories most like one, among those that may be seen where there is a registry; ties by name."""
        rows = self.embed_graph(dim).withColumnRenamed("key", "id")
        query = rows.filter(F.col("id") == repo).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
        if self.repos is not None:
            seen = self.repos.filter(~atlas.restricted(F.col("visibility"), public_only)).select(F.col("repo").alias("id"))
            rows = rows.join(seen, "id", "left_semi")
        return vectors.nearest(rows, query, k)

    def repo_map(self, k: int = 5, dim: int = vectors.DIM) -> DataFrame:
        return vectors.similarity_graph(self.embed_graph(dim).withColumnRenamed("key", "id"), k)
