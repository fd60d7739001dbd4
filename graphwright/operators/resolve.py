"""From facts to edges: names to definitions, imports to files, code to tables, packages to packages, and entities.

Theta joins are rewritten as equi-joins: suffixes and prefixes of paths are exploded, spans carry their file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphwright.operators.components import components
from graphwright.plans.scratch import Settled

#: Extensions that a JavaScript import may leave out, best first.
JS_EXTENSIONS = [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs"]


def directory(file: Column) -> Column:
    return F.regexp_extract(file, "^(.*)/[^/]*$", 1)


def unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys that have one row."""
    return rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key))).filter("_n = 1").drop("_n")


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """rows(keys, target) to how many targets a key has, and the smallest and largest."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("low"), F.max("target").alias("high"))


def _only(own: Column) -> Column:
    """Of a counted group, the one target besides the anchor, which is in the group where own says so; null if there isn't exactly one."""
    other = F.when(F.col("low") == F.col("anchor"), F.col("high")).otherwise(F.col("low"))
    return F.when(F.col("n") - F.when(own, 1).otherwise(0) == 1, F.when(own, other).otherwise(F.col("low")))


def resolve_names(pending: DataFrame, nodes: DataFrame, symbol_imports: DataFrame, file_imports: DataFrame) -> DataFrame:
    """pending(link, anchor, anchor_file, name, scope) to (link, anchor, target, tier).

    One candidate of the name is taken as it is (tier 0); of several, the first tier that leaves exactly one decides:
    1 the receiver's scope, 2 the symbol's import, 3 the files that the anchor's file imports, 4 the same directory.  The anchor
    itself is no candidate.  Links never meet all definitions of a name: every tier joins them with counted groups (name; name and
    scope; name and file; name and directory), one row each, however common the name is.
    """
    named = nodes.select(F.col("id").alias("target"), "name", F.col("qualified_name").alias("q"), F.col("file").alias("target_file"))
    anchors = nodes.select(F.col("id").alias("anchor"), F.col("name").alias("own_name"), F.col("qualified_name").alias("own_q"), F.col("file").alias("own_file"))
    rows = pending.select("link", "anchor", "anchor_file", "name", "scope").join(anchors, "anchor", "left")
    same = F.coalesce(F.col("own_name") == F.col("name"), F.lit(False))
    scoped = F.concat("scope", F.lit("::"), "name")
    keys = ["link", "anchor"]
    found = [rows.join(_counted(named, "name"), "name").select(*keys, F.lit(0).alias("tier"), _only(same).alias("target"))]

    parts = F.split("q", "::")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))
    by_scope = _counted(named.filter("q is not null").select("name", "target", F.explode(suffixes).alias("suffix")), "name", "suffix")
    inside = same & F.coalesce((F.col("own_q") == F.col("suffix")) | F.col("own_q").endswith(F.concat(F.lit("::"), "suffix")), F.lit(False))
    found.append(rows.withColumn("suffix", scoped).join(by_scope, ["name", "suffix"]).select(*keys, F.lit(1).alias("tier"), _only(inside).alias("target")))

    by_file = _counted(named, "name", "target_file")
    own = same & F.coalesce(F.col("own_file") == F.col("target_file"), F.lit(False))
    imported = [
        (2, rows.join(symbol_imports.select(F.col("file").alias("anchor_file"), "name", "target_file").distinct(), ["anchor_file", "name"])),
        (3, rows.join(file_imports.select(F.col("file").alias("anchor_file"), "target_file").distinct(), "anchor_file")),
    ]
    for tier, near in imported:  # several files may hold candidates, and all of them count
        some = near.join(by_file, ["name", "target_file"]).select(*keys, F.when(own, F.col("n") - 1).otherwise(F.col("n")).alias("n"), _only(own).alias("one"))
        found.append(some.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("one").alias("one")).select(*keys, F.lit(tier).alias("tier"), F.when(F.col("n") == 1, F.col("one")).alias("target")))

    by_dir = _counted(named.withColumn("dir", directory(F.col("target_file"))), "name", "dir")
    beside = same & F.coalesce(directory(F.col("own_file")) == F.col("dir"), F.lit(False))
    found.append(rows.withColumn("dir", directory(F.col("anchor_file"))).join(by_dir, ["name", "dir"]).select(*keys, F.lit(4).alias("tier"), _only(beside).alias("target")))
    best = reduce(DataFrame.unionByName, found).filter("target is not null").groupBy(*keys).agg(F.min(F.struct("tier", "target")).alias("b"))
    return best.select("link", "anchor", F.col("b.target").alias("target"), F.col("b.tier").alias("tier"))


def join_path(base: Column, relative: Column) -> Column:
    """A path joined and its . and .. resolved; null if it leaves the root."""
    parts = F.filter(F.concat(F.split(base, "/"), F.split(relative, "/")), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(a: Column, x: Column) -> Column:
        up = F.struct(F.slice(a["p"], 1, F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok"))
        return F.when(x == "..", up).otherwise(F.struct(F.concat(a["p"], F.array(x)).alias("p"), a["ok"].alias("ok")))

    return F.aggregate(parts, start, step, lambda a: F.when(a["ok"], F.array_join(a["p"], "/")))


def import_candidates(importer: Column, raw: Column, language: Column) -> Column:
    """Paths that an import may mean, best first; empty where the language's imports name no files."""
    raw = F.trim(raw)
    none = F.array().cast("array<string>")
    there = F.filter(F.array(join_path(directory(importer), raw)), lambda x: x.isNotNull() & (x != ""))
    endings = F.array(*map(F.lit, ["", *JS_EXTENSIONS, *[f"/index{e}" for e in JS_EXTENSIONS]]))
    js = F.when(raw.startswith("."), F.flatten(F.transform(there, lambda b: F.transform(endings, lambda e: F.concat(b, e))))).otherwise(none)
    rooted = F.filter(F.array(join_path(F.lit(""), raw)), lambda x: x.isNotNull() & (x != ""))
    dotted = F.replace(F.regexp_replace(raw, r"^\.+|\.+$", ""), F.lit("."), F.lit("/"))
    python = F.when(dotted == "", none).otherwise(F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py"))))
    java = F.when(raw.endswith(".*"), none).otherwise(F.array(F.concat(F.replace(raw, F.lit("."), F.lit("/")), F.lit(".java"))))
    pascal = F.array(F.concat(raw, F.lit(".pas")), F.concat(raw, F.lit(".pp")))
    found = (
        F.when(language.isin("javascript", "typescript", "tsx"), js)
        .when(language.isin("c", "cpp"), F.array_distinct(F.concat(there, rooted)))
        .when(language == "python", python)
        .when(language == "java", java)
        .when(language == "pascal", pascal)
        .otherwise(none)
    )
    return F.when(F.coalesce(raw, F.lit("")) == "", none).otherwise(found)


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path on segment boundaries, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def path_prefixes(path: Column) -> Column:
    """All directories above a path, the root as the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(importer, raw, language) to (importer, raw, target): the first candidate that is a file, or the unique file that ends with it."""
    c = imports.select("importer", "raw", F.posexplode(import_candidates(F.col("importer"), F.col("raw"), F.col("language"))).alias("place", "candidate"))
    exact = c.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").select("importer", "raw", F.lit(0).alias("way"), "place", F.col("candidate").alias("target"))
    ends = files.select("path", F.explode(path_suffixes(F.col("path"))).alias("candidate")).filter("path <> candidate")
    only = ends.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("target")).filter("n = 1")
    suffix = c.join(only, "candidate").select("importer", "raw", F.lit(1).alias("way"), "place", "target")
    best = exact.unionByName(suffix).groupBy("importer", "raw").agg(F.min(F.struct("way", "place", "target")).alias("b"))
    return best.select("importer", "raw", F.col("b.target").alias("target"), F.when(F.col("b.way") == 0, "exact").otherwise("suffix").alias("way"))


def table_access(accesses: DataFrame, tables: DataFrame, entities: DataFrame) -> DataFrame:
    """accesses(node, access, name) of tables, by qualified or bare name, or by an entity that means one table: edges to every such table."""
    certain = entities.groupBy("entity").agg(F.min("table").alias("t"), F.countDistinct("table").alias("n")).filter("n = 1")
    named = accesses.join(certain, accesses["name"] == certain["entity"], "left").select("node", "access", F.lower(F.coalesce("t", "name")).alias("key"))
    bare = F.regexp_extract("name", r"([^.]*)$", 1)
    keys = tables.select("id", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower(bare)))).alias("key"))
    return named.join(keys, "key").select(F.col("node").alias("src"), F.col("id").alias("dst"), F.when(F.col("access") == "write", "writes").otherwise("reads").alias("kind"), F.lit("inferred").alias("confidence")).distinct()


def package_links(uses: DataFrame, packages: DataFrame, exports: DataFrame) -> DataFrame:
    """uses(repo, from_file, package, symbol, from_node) to links with packages of other repositories.

    A link is to the exported symbol where the name meets one (kind symbol), else to the package (kind crate).
    """
    u = uses.select(F.col("repo").alias("from_repo"), "from_file", "package", "symbol", "from_node")
    p = packages.select(F.col("repo").alias("to_repo"), "package").distinct()
    e = exports.select(F.col("repo").alias("to_repo"), "package", F.col("name").alias("symbol"), F.col("node_id").alias("to_node")).distinct()
    pairs = u.join(p, "package").filter("from_repo <> to_repo")
    rows = pairs.join(e, ["to_repo", "package", "symbol"], "left")
    return rows.select("from_repo", "from_file", "from_node", "to_repo", "package", F.when(F.col("to_node").isNotNull(), F.col("symbol")).alias("to_symbol"), "to_node", F.when(F.col("to_node").isNull(), "crate").otherwise("symbol").alias("kind")).distinct()


def owning_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Longest-prefix join: each file(path) with the package(name, dir) whose directory is the nearest above it."""
    above = files.select("path", F.explode(path_prefixes(F.col("path"))).alias("dir"))
    best = above.join(packages, "dir").groupBy("path").agg(F.max(F.struct(F.length("dir").alias("n"), "name", "dir")).alias("b"))
    return best.select("path", F.col("b.name").alias("package"), F.col("b.dir").alias("dir"))


def resolve_constants(constants: DataFrame, max_hops: int = 8) -> DataFrame:
    """constants(file, name, value, ref_file, ref_name): chains of references followed to a value, at most max_hops.

    A reference whose file is null means the only constant of that name, if there is one.
    """
    lone = constants.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("only")).filter("n = 1")
    rows = constants.join(lone.select(F.col("name").alias("ref_name"), "only"), "ref_name", "left").select("file", "name", "value", F.coalesce("ref_file", "only").alias("ref_file"), "ref_name")
    at = Settled(rows.withColumn("hops", F.lit(0)))
    table = at.df.select(F.col("file").alias("f"), F.col("name").alias("m"), F.col("value").alias("v"), F.col("ref_file").alias("rf"), F.col("ref_name").alias("rn"))
    done, now = at.df.filter("value is not null"), at.df.filter("value is null and ref_name is not null")
    for _ in range(max_hops):
        step = Settled(now.join(table, (F.col("ref_file") == F.col("f")) & (F.col("ref_name") == F.col("m"))).select("file", "name", F.col("v").alias("value"), F.col("rf").alias("ref_file"), F.col("rn").alias("ref_name"), (F.col("hops") + 1).alias("hops")))
        done, now = done.unionByName(step.df.filter("value is not null")), step.df.filter("value is null and ref_name is not null")
        if now.isEmpty():
            break
    return done.select("file", "name", "value", "hops")


def same_entity(entries: DataFrame) -> DataFrame:
    """entries(entry, keys array<string>) to (entry, entity): entries that share a key, directly or through others, are one.

    The entity is the smallest entry.  Entries and keys are nodes of a graph by a 64-bit hash, whose components are found in
    rounds that grow with the logarithm of the longest chain.
    """
    node = F.xxhash64(F.lit("entry"), F.col("entry").cast("string")).alias("u")
    links = entries.select(node, F.explode(F.transform("keys", lambda k: F.xxhash64(F.lit("key"), k))).alias("v"))
    group = components(links)
    named = entries.select("entry", node).join(group.df, F.col("u") == F.col("node"), "left").select("entry", F.coalesce("component", "u").alias("c")).distinct()
    first = named.groupBy("c").agg(F.min("entry").alias("entity"))
    return named.join(first, "c").select("entry", "entity")


def contained_roots(roots: DataFrame) -> DataFrame:
    """Registry entries(entry, root) whose root lies under another entry's: (entry, within), the nearest."""
    above = roots.select("entry", F.explode(path_prefixes(F.col("root"))).alias("dir")).filter("dir <> ''")
    return above.join(roots.select(F.col("entry").alias("within"), F.col("root").alias("dir")), "dir").groupBy("entry").agg(F.max_by("within", F.length("dir")).alias("within"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
