"""Histories over many repositories: timelines with visibility rules, topics, effort and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphwright.functions.text import canonical_email, glob_regex

VISIBILITY = {"public": 0, "private": 1, "proprietary": 2}


def visibility_rank(v: Column) -> Column:
    """Rank of a visibility; null (not registered) stays null."""
    return F.when(v == "public", 0).when(v == "private", 1).when(v == "proprietary", 2)


def in_range(commits: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Commits in an inclusive window of Unix seconds with open sides."""
    rows = commits if since is None else commits.filter(F.col("committed_at") >= since)
    return rows if until is None else rows.filter(F.col("committed_at") <= until)


def mark_bounds(commits: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Commits re-marked as in or out of bounds, instead of being deleted."""
    low, high = F.lit(since).cast("long"), F.lit(until).cast("long")
    inside = F.coalesce(F.col("committed_at") >= low, F.lit(True)) & F.coalesce(F.col("committed_at") <= high, F.lit(True))
    return commits.withColumn("in_bounds", inside)


def timeline(commits: DataFrame, touched: DataFrame, tagged: DataFrame | None = None, topic: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Commits of a window with the number of files they touched, of one topic if it is given."""
    rows = in_range(commits, since, until)
    if topic is not None:
        rows = rows.join(tagged.filter(F.col("topic") == topic).select("node_id").distinct(), "node_id", "left_semi")
    n = touched.groupBy("node_id").agg(F.count(F.lit(1)).alias("files"))
    return rows.join(n, "node_id", "left").withColumn("files", F.coalesce("files", F.lit(0)).cast("long"))


def restricted(visibility: Column, public_only: bool = False) -> Column:
    """Whether a repository is hidden: unregistered always; else all but public ones, or only proprietary ones."""
    hidden = (visibility != "public") if public_only else (visibility == "proprietary")
    return visibility.isNull() | hidden


def by_author(email: Column, author: str | None = None, me: list[str] = (), patterns: list[str] = (), bots: list[str] = ()) -> Column:
    """An explicit substring decides; else my addresses and patterns, and no bots; without any, everyone."""
    lower = F.lower(email)
    if author is not None:
        return lower.contains(author.lower())
    ok = F.lit(not me and not patterns)
    if me:
        ok = ok | canonical_email(email).isin([*me])
    for p in patterns:
        ok = ok | lower.rlike(glob_regex(p))
    for b in bots:
        ok = ok & ~lower.rlike(glob_regex(b))
    return ok


def gated(rows: DataFrame, repos: DataFrame, public_only: bool = False, include_restricted: bool = False, **who) -> DataFrame:
    """rows with how they fare: kept, restricted or author."""
    seen = rows.join(repos.select("repo", "visibility"), "repo", "left")
    hidden = F.lit(False) if include_restricted else restricted(F.col("visibility"), public_only)
    return seen.withColumn("outcome", F.when(hidden, "restricted").when(~by_author(F.col("author_email"), **who), "author").otherwise("kept"))


def shown(rows: DataFrame, limit: int = 50) -> DataFrame:
    """The kept rows of gated(), newest first."""
    return rows.filter("outcome = 'kept'").orderBy(F.desc("committed_at"), F.desc("node_id")).limit(limit)


def gate_counts(rows: DataFrame) -> DataFrame:
    """How many rows matched, and how many were hidden for which reason."""
    return rows.agg(F.count_if(F.col("outcome") == "kept").alias("matched"), F.count_if(F.col("outcome") == "restricted").alias("excluded_restricted"), F.count_if(F.col("outcome") == "author").alias("excluded_author"))


def topics(tagged: DataFrame) -> DataFrame:
    """Topics with their commits, most first."""
    return tagged.groupBy("topic").agg(F.countDistinct("node_id").alias("commits")).orderBy(F.desc("commits"), "topic")


def authors(commits: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent authors, by canonical address."""
    return commits.groupBy(canonical_email(F.col("author_email")).alias("author")).agg(F.count(F.lit(1)).alias("commits"), F.min("committed_at").alias("first"), F.max("committed_at").alias("last")).orderBy(F.desc("commits"), "author").limit(n)


def effort(waka: DataFrame, since: str | None = None, until: str | None = None, dimension: str | None = None) -> DataFrame:
    """Tracked time in a range of days (YYYY-MM-DD, inclusive), of one dimension if it is given."""
    rows = waka
    for keep in ([F.col("dimension") == dimension] if dimension else []) + ([F.col("day") >= since] if since else []) + ([F.col("day") <= until] if until else []):
        rows = rows.filter(keep)
    return rows.orderBy("day", "dimension", F.desc("seconds"), "name")


def effort_breakdown(waka: DataFrame, aliases: dict[str, str] | None = None, n: int = 10) -> DataFrame:
    """The n names with most time in every dimension, after aliases, with the dimension's total."""
    name = F.col("name")
    if aliases:
        name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), name), name)
    sums = waka.groupBy("dimension", name.alias("name")).agg(F.sum("seconds").alias("seconds"))
    own = W.partitionBy("dimension")
    rows = sums.withColumn("place", F.row_number().over(own.orderBy(F.desc("seconds"), "name"))).withColumn("total", F.sum("seconds").over(own))
    return rows.filter(F.col("place") <= n)


def days(waka: DataFrame) -> DataFrame:
    return waka.select("day").distinct().orderBy("day")


def top_values(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, value, n, place): the n most frequent values of each key, ties by value."""
    c = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), value))).filter(F.col("place") <= n)


def paths_digest(paths: DataFrame, key: str = "node_id", path: str = "path", dirs: int = 12, extensions: int = 8) -> DataFrame:
    """Per key, the most frequent directories and then extensions of its paths, in one string.

    Paths are dealt by key once; counts, places and the text need no other shuffle.
    """
    parts = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
    above = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda v: F.struct(F.lit(0).alias("o"), v.alias("v")))
    ending = F.regexp_extract(F.lower(path), r"[^/]\.([^./]{1,8})$", 1)
    values = F.concat(above, F.when(ending != "", F.array(F.struct(F.lit(1).alias("o"), ending.alias("v")))).otherwise(F.array().cast("array<struct<o:int,v:string>>")))
    rows = paths.select(key, path).repartition(key).select(key, F.explode(values).alias("x")).select(key, "x.o", "x.v")
    counted = rows.groupBy(key, "o", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.withColumn("place", F.row_number().over(W.partitionBy(key, "o").orderBy(F.desc("n"), "v")))
    kept = placed.filter(F.col("place") <= F.when(F.col("o") == 0, dirs).otherwise(extensions))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "place", "v"))), lambda x: x["v"]), " ").alias("digest"))


def repo_digest(nodes: DataFrame, commits: DataFrame, imports: DataFrame, tagged: DataFrame, stop: list[str] = ("std", "core", "alloc", "self", "super", "crate"), deps: int = 15, tops: int = 12) -> DataFrame:
    """One row per repository: counts of functions, types and endpoints, frequent imports and topics, span and active years."""
    kinds = nodes.groupBy("repo").agg(
        F.count_if(F.col("kind").isin("function", "method")).alias("functions"),
        F.count_if(F.col("kind").isin("class", "struct", "interface", "enum", "trait")).alias("types"),
        F.count_if(F.col("kind") == "endpoint").alias("endpoints"),
    )
    year = F.year(F.timestamp_seconds("committed_at"))
    span = commits.groupBy("repo").agg(F.min("committed_at").alias("first"), F.max("committed_at").alias("last"), F.sort_array(F.collect_set(year)).alias("years"))
    roots = imports.select("repo", F.regexp_extract("raw", "^([^./:]+)", 1).alias("v")).filter(~F.col("v").isin(list(stop)) & (F.col("v") != ""))
    tags = tagged.join(commits.select("node_id", "repo"), "node_id").select("repo", F.col("topic").alias("v"))

    def listed(rows: DataFrame, n: int, name: str) -> DataFrame:
        return top_values(rows, "repo", "v", n).groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias(name))

    out = kinds.join(span, "repo", "left")
    return out.join(listed(roots, deps, "dependencies"), "repo", "left").join(listed(tags, tops, "topics"), "repo", "left")


def list_repos(repos: DataFrame, health: str | None = None, group: str | None = None, name: str | None = None, under: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Registered repositories by health, group, part of the name or place, a page at a time."""
    rows = repos
    for keep in (
        ([F.col("health") == health] if health else [])
        + ([F.col("grp") == group] if group else [])
        + ([F.lower("label").contains(name.lower())] if name else [])
        + ([(F.col("root") == under) | F.col("root").startswith(f"{under.rstrip('/')}/")] if under else [])
    ):
        rows = rows.filter(keep)
    return rows.orderBy("repo").offset(offset).limit(limit)


def repo_summary(repos: DataFrame) -> DataFrame:
    """Repositories by health and by group."""
    h = repos.groupBy(F.lit("health").alias("facet"), F.col("health").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return h.unionByName(repos.groupBy(F.lit("group").alias("facet"), F.col("grp").alias("value")).agg(F.count(F.lit(1)).alias("n")))


def classify_repos(repos: DataFrame, public: list[str] = (), proprietary: list[str] = (), private: list[str] = ()) -> DataFrame:
    """Visibility by globs on the name: public globs pin, the others only raise."""

    def any_of(globs: list[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            out = out | F.col("repo").rlike(glob_regex(g))
        return out

    raised = F.greatest(visibility_rank(F.col("visibility")), F.when(any_of(proprietary), 2).when(any_of(private), 1).otherwise(0))
    number = F.when(any_of(public), 0).otherwise(raised)
    return repos.withColumn("visibility", F.get(F.array(*map(F.lit, VISIBILITY)), number))


def sync_order(repos: DataFrame) -> DataFrame:
    """Repositories that were never synced first, else in their order."""
    return repos.orderBy(F.col("last_synced").isNotNull(), "ordinal")


def staleness(files: DataFrame) -> DataFrame:
    """State of an index from (indexed_head, head, dirty, schema_ok): the first reason that holds."""
    reason = (
        F.when(F.col("indexed_head").isNull(), "not indexed")
        .when(~F.col("schema_ok"), "schema changed")
        .when(F.col("head").isNull(), "no head")
        .when(F.col("head") != F.col("indexed_head"), "new commits")
        .when(F.col("dirty"), "uncommitted changes")
    )
    return files.withColumn("reason", reason).withColumn("state", F.when(F.col("reason").isNull(), "fresh").when(F.col("reason") == "no head", "unknown").otherwise("stale"))
