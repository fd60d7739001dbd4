"""Breadth-first traversals as level loops.

Each level is one join of the frontier with the edges, a partial aggregate per node and an anti-join with the nodes seen
before; it is written to the shared folder, so that a level is computed once and outlives the executors that did.
Only counts reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.operators.graph import rank, unrank
from graphwright.plans.scratch import Settled, stable

#: What each set of edges follows: (kind, from the edge's destination to its source).
RULES = {
    "calls": [("calls", "in")],
    "refs": [("references", "in")],
    "imports": [("imports", "in")],
    "impl": [("implements", "in"), ("extends", "in")],
    "api": [("handles", "out"), ("exposes", "out"), ("invokes", "in"), ("mounts", "in")],
    "db": [("reads", "in"), ("writes", "in")],
}
IN_PROCESS = ["calls", "refs", "imports", "impl"]
CROSS_BOUNDARY = [*IN_PROCESS, "api", "db"]
MAX_DEPTH = 5


def rules(tokens: list[str]) -> list[tuple[str, str]]:
    unknown = [t for t in tokens if t not in RULES]
    if unknown:
        raise ValueError(f"unknown edge set {unknown[0]!r} (expected {', '.join(RULES)})")
    return [r for t in tokens for r in RULES[t]]


def steps(edges: DataFrame, follow: list[tuple[str, str]]) -> DataFrame:
    """Directed steps (at, to, kind, r) that a traversal may take."""
    parts = []
    for way, near, far in (("in", "dst", "src"), ("out", "src", "dst")):
        kinds = [k for k, d in follow if d == way]
        if kinds:
            parts.append(edges.filter(F.col("kind").isin(kinds)).select(F.col(near).alias("at"), F.col(far).alias("to"), "kind", rank(F.col("confidence")).alias("r")))
    return reduce(DataFrame.unionByName, parts)


def impact(edges: DataFrame, seeds: DataFrame, tokens: list[str] | None = None, max_depth: int = MAX_DEPTH, min_confidence: str = "inferred") -> DataFrame:
    """What depends on seeds(id): (id, distance, min_confidence, path), by the shortest and then the strongest path.

    path has the edge kinds of the example path: of the strongest, the one through the parent that was found first, then the
    smaller kind.  The order of finding is kept as the chain of ids (``pos``), which compares as the queue's order does.
    """
    step = steps(edges, rules(tokens or IN_PROCESS))
    if min_confidence == "extracted":
        step = step.filter("r >= 2")
    step = stable(step)
    first = seeds.select("id").distinct()
    level = first.select("id", F.lit(2).alias("r"), F.array().cast("array<string>").alias("path"), F.array("id").alias("pos"), F.lit(0).alias("distance"))
    found = [Settled(level)]
    for depth in range(1, max_depth + 1):
        seen = reduce(DataFrame.unionByName, [x.df.select("id") for x in found])
        ahead = found[-1].df.join(step.withColumnsRenamed({"r": "er", "kind": "ek"}), F.col("id") == F.col("at"))
        ahead = ahead.select(F.col("to").alias("id"), F.least("r", "er").alias("r"), "pos", "ek", F.concat("path", F.array("ek")).alias("path"))
        # aggregated first: partial minima before the shuffle, whose partitions the anti-join uses again
        best = ahead.groupBy("id").agg(F.min(F.struct((-F.col("r")).alias("r"), "pos", "ek", "path")).alias("b"), F.min("pos").alias("first")).join(seen, "id", "left_anti")
        level = best.select("id", (-F.col("b.r")).alias("r"), F.col("b.path").alias("path"), F.concat("first", F.array("id")).alias("pos"), F.lit(depth).alias("distance"))
        found.append(Settled(level, counted=True))
        if not found[-1].rows:
            break
    items = reduce(DataFrame.unionByName, [x.df for x in found[1:]]) if len(found) > 1 else found[0].df.limit(0)
    return items.select("id", "distance", unrank(F.col("r")).alias("min_confidence"), "path")


def reachable(edges: DataFrame, seeds: DataFrame, kind: str, outgoing: bool = True, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Nodes within max_depth edges of a kind from seeds(id), without the seeds: (id, distance)."""
    near, far = ("src", "dst") if outgoing else ("dst", "src")
    step = edges.filter(F.col("kind") == kind).select(F.col(near).alias("at"), F.col(far).alias("to")).distinct()
    step = stable(step)
    found = [Settled(seeds.select("id").distinct().withColumn("distance", F.lit(0)))]
    for depth in range(1, max_depth + 1):
        seen = reduce(DataFrame.unionByName, [x.df.select("id") for x in found])
        ahead = found[-1].df.join(step, F.col("id") == F.col("at")).select(F.col("to").alias("id")).distinct()
        found.append(Settled(ahead.join(seen, "id", "left_anti").withColumn("distance", F.lit(depth)), counted=True))
        if not found[-1].rows:
            break
    return reduce(DataFrame.unionByName, [x.df for x in found]).filter("distance > 0")


def impact_sql(tokens: list[str], seed_sql: str, edges: str = "edges", max_depth: int = MAX_DEPTH, min_rank: int = 1) -> str:
    """The levels of impact() as one SQL statement that ends in a CTE named reached(id, distance, r, path)."""
    ways = rules(tokens)
    arms = []
    for way, near, far in (("in", "dst", "src"), ("out", "src", "dst")):
        kinds = ", ".join(f"'{k}'" for k, d in ways if d == way)
        if kinds:
            arms.append(f"SELECT {near} AS at_, {far} AS to_, kind, CASE WHEN confidence = 'extracted' THEN 2 ELSE 1 END AS r FROM {edges} WHERE kind IN ({kinds})")
    out = [f"step AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(arms)}) WHERE r >= {min_rank})"]
    out.append(f"l0 AS MATERIALIZED (SELECT DISTINCT id, 2 AS r, CAST([] AS VARCHAR[]) AS path, [id] AS pos FROM ({seed_sql}))")
    for d in range(1, max_depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(d))
        out.append(f"""l{d} AS MATERIALIZED (
            SELECT id, -b.r AS r, b.path AS path, list_append(first_, id) AS pos FROM (
              SELECT to_ AS id, min(struct_pack(r := -least(p.r, s.r), pos := pos, ek := s.kind, path := list_append(path, s.kind))) AS b, min(pos) AS first_
              FROM l{d - 1} p JOIN step s ON p.id = s.at_ WHERE to_ NOT IN ({seen}) GROUP BY to_))""")
    reached = " UNION ALL ".join(f"SELECT id, {d} AS distance, r, path FROM l{d}" for d in range(1, max_depth + 1))
    return "WITH " + ",\n".join(out) + f",\nreached AS ({reached})"
