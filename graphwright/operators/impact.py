"""Impact reports: classes of dependents, summaries, levels and gates, in one repository or several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.text import glob_regex
from graphwright.operators.traverse import CROSS_BOUNDARY, IN_PROCESS, MAX_DEPTH, impact

LEVELS = ["none", "low", "medium", "high", "critical"]


def is_test(file: Column, qualified_name: Column) -> Column:
    f = F.lower(F.replace(file, F.lit("\\"), F.lit("/")))
    base = F.regexp_extract(f, "([^/]*)$", 1)
    path = f.contains("/tests/") | f.startswith("tests/") | f.contains("/test/") | f.startswith("test/")
    name = base.contains(".test.") | base.contains(".spec.") | base.endswith("_test.go") | base.startswith("test_") | base.endswith("_test.py") | base.endswith("_test.rs")
    return path | name | qualified_name.contains("tests::")


def is_entrypoint(kind: Column, qualified_name: Column) -> Column:
    return kind.isin("function", "method") & ((qualified_name == "main") | qualified_name.endswith("::main"))


def classify(kind: Column, file: Column, qualified_name: Column, test_globs: list[str] | None = None) -> Column:
    """test, api, entrypoint or internal, in this order of precedence; files under test_globs are tests too."""
    f, q = F.coalesce(file, F.lit("")), F.coalesce(qualified_name, F.lit(""))
    test = is_test(f, q)
    for g in test_globs or []:
        test = test | f.rlike(glob_regex(g))
    return F.when(test, "test").when(kind.isin("endpoint", "schema_op"), "api").when(is_entrypoint(kind, q), "entrypoint").otherwise("internal")


def crosses_boundary(path: Column) -> Column:
    return F.arrays_overlap(path, F.array(F.lit("invokes"), F.lit("reads"), F.lit("writes")))


def classified(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, tokens: list[str] | None = None, max_depth: int = MAX_DEPTH, min_confidence: str = "inferred", test_globs: list[str] | None = None) -> DataFrame:
    """impact() with its nodes: class and cross_boundary; ids without a node are left out."""
    items = impact(edges, seeds, tokens or CROSS_BOUNDARY, max_depth, min_confidence).join(nodes, "id")
    return items.select("id", "distance", "min_confidence", "path", "name", "kind", "file", classify(F.col("kind"), F.col("file"), F.col("qualified_name"), test_globs).alias("class"), crosses_boundary(F.col("path")).alias("cross_boundary"))


def level(total: Column, api: Column, cross: Column) -> Column:
    """The level of risk as a number, an index into LEVELS."""
    contract, big = (api > 0) | (cross > 0), total >= 50
    return F.when(total == 0, 0).when(big & contract, 4).when(big | contract, 3).when(total >= 10, 2).otherwise(1)


def level_name(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), number)


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("class") == c).alias(n) for c, n in (("test", "tests"), ("api", "api"), ("entrypoint", "entrypoints"), ("internal", "internal"))],
        F.count_if("cross_boundary").alias("cross_boundary"),
        F.coalesce(F.max("distance"), F.lit(0)).alias("max_distance"),
    ]


def summary(items: DataFrame) -> DataFrame:
    """One row of counts with the level."""
    out = items.agg(*_counts())
    return out.select(level_name(level(F.col("total"), F.col("api"), F.col("cross_boundary"))).alias("level"), "*")


def breadth_level(repos: Column) -> Column:
    return F.when(repos == 0, 0).when(repos < 5, 2).otherwise(3)


def federated_summary(items: DataFrame, origin: str, crate_hits: DataFrame | None = None) -> DataFrame:
    """summary() over items(repo, ...) of several repositories; downstream repositories raise the level."""
    down = items.filter(F.col("repo") != origin).select("repo")
    if crate_hits is not None:
        down = down.unionByName(crate_hits.select("repo"))
    out = items.agg(*_counts()).join(down.agg(F.countDistinct("repo").alias("downstream_repos")))
    number = F.greatest(level(F.col("total"), F.col("api"), F.col("cross_boundary")), breadth_level(F.col("downstream_repos")))
    return out.select(level_name(number).alias("level"), "*")


def crate_hits(links: DataFrame, origin: str, packages: DataFrame) -> DataFrame:
    """Where package-level links of other repositories reach the seeds' packages(package) of a repository: (repo, file, package)."""
    hit = links.filter((F.col("kind") == "crate") & (F.col("to_repo") == origin)).join(packages.select("package").distinct(), "package", "left_semi")
    return hit.select(F.col("from_repo").alias("repo"), F.col("from_file").alias("file"), "package").distinct()


def diagnostics(scope: DataFrame, hints: DataFrame, web: DataFrame, reachable: DataFrame) -> DataFrame:
    """One row that explains a federated report: repositories in scope(repo), hints(hint, side, repo) and how many name none of them, web matches, reachable(repo), and which of them have an index."""
    known = scope.select("repo").distinct()
    dead = hints.join(known, "repo", "left_anti").select("hint").distinct()
    one = [
        known.unionByName(reachable.select("repo")).distinct().agg(F.count(F.lit(1)).alias("scope_repos")),
        hints.agg(F.countDistinct("hint").alias("hints_total")),
        dead.agg(F.count(F.lit(1)).alias("hints_unresolved")),
        web.agg(F.count(F.lit(1)).alias("web_matches")),
        reachable.agg(F.countDistinct("repo").alias("reachable")),
        reachable.join(scope.filter("indexed").select("repo"), "repo", "left_semi").agg(F.countDistinct("repo").alias("opened")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.join(x)  # one row each
    return out


def markdown(items: DataFrame, cap: int = 20) -> DataFrame:
    """A report as lines of Markdown (place, line): the counts, then tests, API surface and cross-boundary consumers, cap of each."""
    from pyspark.sql import Window as W

    s = summary(items)
    counts = F.concat(F.lit("**Impact: "), "level", F.lit("** - "), *[x for c, n in (("total", " symbols, "), ("tests", " tests, "), ("api", " API surface, "), ("cross_boundary", " cross-boundary consumers, max distance ")) for x in (F.col(c), F.lit(n))], "max_distance")
    head = s.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("p"), F.lit("## Impact analysis").alias("line")), F.struct(F.lit(0).alias("s"), F.lit(1).alias("p"), counts.alias("line")))).alias("x")).select("x.*")
    sections = [("Tests to run", F.col("class") == "test"), ("API surface affected", F.col("class") == "api"), ("Cross-boundary consumers", F.col("cross_boundary"))]
    own = F.explode(F.filter(F.array(*[F.when(c, i) for i, (_, c) in enumerate(sections, 1)]), lambda x: x.isNotNull()))
    rows = items.withColumn("s", own)
    rows = rows.withColumn("p", F.row_number().over(W.partitionBy("s").orderBy("distance", F.desc("min_confidence"), "id")))
    line = F.concat(F.lit("- `"), "name", F.lit("` ("), "file", F.lit(") d"), "distance", F.when(F.col("min_confidence") == "inferred", " (inferred)").otherwise(""))
    titles = rows.select("s").distinct().select("s", F.lit(0).alias("p"), F.get(F.array(*[F.lit(f"### {t}") for t, _ in sections]), F.col("s") - 1).alias("line"))
    body = rows.filter(F.col("p") <= cap).select("s", "p", line.alias("line"))
    more = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("s", F.lit(cap + 1).alias("p"), F.concat(F.lit("... "), F.col("n") - cap, F.lit(" more")).alias("line"))
    return head.unionByName(titles).unionByName(body).unionByName(more).orderBy("s", "p")


def fails_gate(items: DataFrame) -> bool:
    """Whether a report touches the API (for exit codes)."""
    return not items.filter("class = 'api'").isEmpty()


def report_sections(items: DataFrame, cap: int = 20) -> DataFrame:
    """The first rows of each class, with how many more there are."""
    from pyspark.sql import Window as W

    own = W.partitionBy("class")
    rows = items.withColumn("place", F.row_number().over(own.orderBy("distance", F.desc("min_confidence"), "id"))).withColumn("n", F.count(F.lit(1)).over(own))
    return rows.filter(F.col("place") <= cap).select("class", "place", "id", "name", "distance", F.greatest(F.col("n") - cap, F.lit(0)).alias("more"))


__all__ = ["IN_PROCESS", "CROSS_BOUNDARY", "classified", "classify", "summary", "federated_summary", "fails_gate", "report_sections"]
