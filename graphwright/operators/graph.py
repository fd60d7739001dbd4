"""A typed code graph over DataFrames: lookups, filters, neighbours, subgraphs and counts.

nodes(repo, id, kind, name, qualified_name, file, language, start_line, end_line, doc, signature),
edges(src, dst, kind, confidence); operations(node_id, repo, kind, protocol, method, path) where there are any.
Everything is declarative; pruning and join strategies are left to the optimizer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of nodes and edges.
NODE_KINDS = [
    "repo", "directory", "file", "module", "function", "method", "class", "struct", "interface", "enum", "trait", "constant", "comment", "endpoint",
    "client_call", "schema_op", "router", "commit", "author", "identity", "topic", "table", "column",
]
EDGE_KINDS = [
    "contains", "defines", "calls", "imports", "extends", "implements", "documents", "references", "handles", "mounts", "exposes", "invokes", "reads",
    "writes", "authored", "alias_of", "touched", "tagged", "part_of",
]
OUTLINE_KINDS = ["module", "function", "method", "class", "struct", "interface", "enum", "trait", "constant", "endpoint"]
EXPORTABLE_KINDS = ["function", "method", "class", "struct", "interface", "enum", "trait", "constant"]
USE_SITE_KINDS = ["function", "method", "class", "struct", "interface", "enum", "trait"]
NON_SYMBOL_KINDS = ["repo", "directory", "file", "module", "comment"]
CONFIDENCE = {"inferred": 1, "extracted": 2}


def rank(confidence: Column) -> Column:
    """Confidence as a number: extracted above inferred."""
    return F.when(confidence == "extracted", 2).otherwise(1)


def unrank(number: Column) -> Column:
    return F.when(number >= 2, F.lit("extracted")).otherwise(F.lit("inferred"))


def one_of(column: Column, values: list[str] | None) -> Column:
    """Membership; None lets everything pass, an empty list nothing."""
    return F.lit(True) if values is None else F.lit(False) if not values else column.isin(values)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    operations: DataFrame | None = None

    # lookups
    def get(self, node: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node)

    def find_by_name(self, name: str, limit: int = 200) -> DataFrame:
        """Definitions by name or qualified name, in order of their ids."""
        return self.nodes.filter((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy("id").limit(limit)

    def in_file(self, file: str) -> DataFrame:
        return self.nodes.filter(F.col("file") == file)

    def search(self, query: str, limit: int = 50, case_sensitive: bool = False) -> DataFrame:
        """Nodes that have every term in their name, qualified name, doc or file, best first; score is summed over terms."""
        terms = query.split() if case_sensitive else query.lower().split()
        fold = (lambda c: F.coalesce(F.col(c), F.lit(""))) if case_sensitive else (lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))))
        if not terms:
            return self.nodes.limit(0).withColumn("score", F.lit(0))
        hit = [F.when(fold("name").contains(t), 3).when(fold("qualified_name").contains(t), 2).when(fold("doc").contains(t) | fold("file").contains(t), 1).otherwise(0) for t in terms]
        rows = self.nodes.filter(~((F.col("kind") == "module") & (F.coalesce("file", F.lit("")) == "")))
        rows = rows.filter(reduce(lambda a, b: a & b, [h > 0 for h in hit])).withColumn("score", reduce(lambda a, b: a + b, hit))
        return rows.orderBy(F.desc("score"), F.octet_length("name"), "name", "id").limit(limit)

    def outline(self, prefix: str | None = None) -> DataFrame:
        """Definitions under a path, in order of file and line."""
        rows = self.nodes.filter(F.col("kind").isin(OUTLINE_KINDS) & (F.coalesce("file", F.lit("")) != ""))
        if prefix:
            rows = rows.filter((F.col("file") == prefix) | F.col("file").startswith(f"{prefix.rstrip('/')}/"))
        return rows.select("file", "start_line", "end_line", "kind", "name", "signature", "id").orderBy("file", "start_line", "id")

    # neighbours
    def neighbors(self, node: str, kind: str | None = None, outgoing: bool = True) -> DataFrame:
        near, far = ("src", "dst") if outgoing else ("dst", "src")
        step = self.edges.filter((F.col(near) == node) & one_of(F.col("kind"), [kind] if kind else None))
        step = step.select(F.col(far).alias("id"), F.col("kind").alias("edge_kind"), "confidence")
        return step.join(self.nodes, "id")

    def around(self, name: str, kinds: list[str] | None, outgoing: bool | None) -> DataFrame:
        """One hop from all definitions of a name; the strongest edge of each (id, edge kind). outgoing None: both ways."""
        seeds = self.nodes.filter((F.col("name") == name) | (F.col("qualified_name") == name)).select(F.col("id").alias("seed"))
        ways = [("src", "dst", "out"), ("dst", "src", "in")] if outgoing is None else [("src", "dst", "out") if outgoing else ("dst", "src", "in")]
        edges = self.edges.filter(one_of(F.col("kind"), kinds))
        steps = [edges.select(F.col(a).alias("seed"), F.col(b).alias("id"), F.col("kind").alias("edge_kind"), rank(F.col("confidence")).alias("r"), F.lit(d).alias("direction")) for a, b, d in ways]
        hops = reduce(DataFrame.unionByName, steps).join(seeds, "seed", "left_semi")
        best = hops.groupBy("id", "edge_kind", "direction").agg(F.max("r").alias("r"))
        return best.join(self.nodes, "id").select("id", "edge_kind", "direction", unrank(F.col("r")).alias("confidence"), "name", "kind", "file")

    # subgraphs
    def subgraph(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The nodes with ids(id), and the edges between them."""
        ids = ids.select("id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return self.nodes.join(ids, "id", "left_semi"), edges.select("src", "dst", "kind", "confidence")

    def export(self, node_kinds: list[str] | None = None, edge_kinds: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes of some kinds (the first by id, if limited), and edges of some kinds between them."""
        nodes = self.nodes.filter(one_of(F.col("kind"), node_kinds))
        if limit is not None:
            nodes = nodes.orderBy("id").limit(limit)
        picked = nodes.select("id")
        edges = self.edges.filter(one_of(F.col("kind"), edge_kinds))
        edges = edges.join(picked.withColumnRenamed("id", "src"), "src", "left_semi").join(picked.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return nodes, edges.select("src", "dst", "kind", "confidence")

    # counts
    def stats(self) -> DataFrame:
        files = self.nodes.filter(F.coalesce("file", F.lit("")) != "").select("file").distinct()
        return (
            self.nodes.agg(F.count(F.lit(1)).alias("nodes"))
            .join(self.edges.agg(F.count(F.lit(1)).alias("edges")))
            .join(files.agg(F.count(F.lit(1)).alias("files")))
        )

    def languages(self) -> DataFrame:
        """Files by language, most first."""
        rows = self.nodes.filter(F.coalesce("file", F.lit("")) != "").select("file", F.when(F.coalesce("language", F.lit("")) == "", "(unknown)").otherwise(F.col("language")).alias("language"))
        return rows.groupBy("language").agg(F.countDistinct("file").alias("files")).orderBy(F.desc("files"), "language")

    def node_kinds(self) -> DataFrame:
        return self.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind")

    def edge_kinds(self) -> DataFrame:
        return self.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind")


#: Widths of the bins that spans are kept in, as powers of two: a span is in the narrowest bin that holds all of it.
BINS = [3, 6, 9, 12, 15, 18, 21, 24, 27, 30]


def binned(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans with the bin that each is in: (bits, bin)."""
    bits = F.expr(f"coalesce(array_min(filter(array({', '.join(map(str, BINS))}), l -> shiftright({start}, l) = shiftright({end}, l))), 31)")
    return spans.withColumn("bits", bits).withColumn("bin", F.expr(f"case when bits = 31 then 0 else shiftright({start}, bits) end"))


def probes(rows: DataFrame, start: str, end: str) -> DataFrame:
    """rows once for every bin that meets the positions from start to end: (bits, bin)."""
    each = [f"transform(sequence(shiftright({start}, {l}), shiftright({end}, {l})), b -> named_struct('bits', {l}, 'bin', b))" for l in BINS]
    return rows.withColumn("_probe", F.explode(F.expr(f"concat({', '.join(each)}, array(named_struct('bits', 31, 'bin', 0)))"))).withColumns({"bits": F.col("_probe.bits"), "bin": F.col("_probe.bin")}).drop("_probe")


def innermost(sites: DataFrame, spans: DataFrame, strict: bool = False) -> DataFrame:
    """Interval join: for sites(file, site, at), the innermost of spans(file, id, start, end) that holds it.

    Spans meet the sites of their bin of the file alone, so that a file with very many of both isn't one group.
    """
    a = probes(sites.select("file", "site", F.col("at").cast("int").alias("at")), "at", "at")
    b = binned(spans.select("file", "id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")), "start", "end")
    holds = (F.col("start") < F.col("at")) & (F.col("at") < F.col("end")) if strict else (F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end"))
    size = (F.col("end") - F.col("start")).alias("size")
    best = a.join(b, ["file", "bits", "bin"]).filter(holds).groupBy("file", "site").agg(F.min(F.struct(size, "id")).alias("m"))
    return best.select("file", "site", F.col("m.id").alias("id"))


def preceding(sites: DataFrame, spans: DataFrame) -> DataFrame:
    """As-of join: for each site, the span that starts last at or before it (ties: the smallest id).

    Spans and sites are merged by position and the last span is carried forward within the file.
    """
    marks = spans.groupBy("file", "start").agg(F.min("id").alias("id")).select("file", F.col("start").alias("at"), F.lit(0).alias("o"), F.lit(None).cast("string").alias("site"), "id")
    rows = marks.unionByName(sites.select("file", "at", F.lit(1).alias("o"), F.col("site").cast("string").alias("site"), F.lit(None).cast("string").alias("id")))
    last = F.last("id", ignorenulls=True).over(W.partitionBy("file").orderBy("at", "o").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("id", last).filter("o = 1 and id is not null").select("file", "site", "id")


def changed_symbols(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Range-overlap join: changes(file, deleted, ranges array<struct<start,end>>) to a row per file and node, with its outcome.

    outcome: removed (the file was deleted), seed (a node overlaps; a file without ranges seeds all its nodes), unresolved.
    Nodes meet the ranges in their bin of the file alone.
    """
    ranges = changes.filter("not deleted").select("file", F.explode_outer("ranges").alias("r"))
    spans = nodes.filter("start_line is not null").select("file", "id", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))
    whole = ranges.filter("r is null").select("file").distinct().join(spans.select("file", "id"), "file")
    part = probes(ranges.filter("r is not null").select("file", F.col("r.start").cast("int").alias("low"), F.greatest(F.col("r.end"), F.col("r.start")).cast("int").alias("high")), "low", "high")
    near = part.join(binned(spans, "start_line", "end_line"), ["file", "bits", "bin"]).filter((F.col("start_line") <= F.col("high")) & (F.col("low") <= F.col("end_line")))
    hits = whole.unionByName(near.select("file", "id")).distinct()
    out = changes.select("file", "deleted").join(hits, "file", "left")
    return out.select("file", "id", F.when(F.col("deleted"), "removed").when(F.col("id").isNull(), "unresolved").otherwise("seed").alias("outcome"))
