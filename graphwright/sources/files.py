"""Source trees: which files are read, their languages and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions.text import glob_regex, language_of

#: Directories that are skipped at any depth.
IGNORED_DIRS = [
    "node_modules", "bower_components", "vendor", "target", "build", "bin", "obj", "dist", "out", "coverage", ".next", "turbo", ".turbo", ".gradle",
    ".nuget", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".idea", ".vs", ".vscode", ".gitnexus", "gitnexus", ".git", ".hg", ".svn", ".cvs", ".bzr",
]
#: Files that hold credentials and aren't read.
SENSITIVE = [".env", ".env.*", "*.pem", "*.key", "*.pfx", "*.p12", "*.pkcs12", "*.keystore", "*.jks", "*.kdbx", "*.ppk", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "*.tfvars"]
#: Directories that mark a repository's root.
VCS_MARKERS = [".git", ".svn", ".bzr", ".hg"]
#: Files with ignore patterns.
IGNORE_FILES = [".gitignore", ".aiignore", ".aiexclude", ".claudeignore"]


def is_sensitive(path: Column) -> Column:
    base = F.regexp_extract(path, "([^/]*)$", 1)
    out = F.lit(False)
    for g in SENSITIVE:
        out = out | base.rlike(glob_regex(g))
    return out


def in_ignored_dir(path: Column, extra: list[str] = ()) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, [*IGNORED_DIRS, *extra])))


def under(path: Column, trees: list[str]) -> Column:
    """Whether a path is one of the trees or below one."""
    out = F.lit(False)
    for t in trees:
        out = out | (path == t.rstrip("/")) | path.startswith(f"{t.rstrip('/')}/")
    return out


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """A line of an ignore file as an anchored regular expression, and whether it takes back; None for comments."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    rooted = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (line[i] if line[i].isalnum() or line[i] in "_/" else f"\\{line[i]}"), i + 1
    return ("^" if rooted else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), back


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns hide a path: the last one that matches decides."""
    out = F.lit(False)
    for found in filter(None, map(ignore_regex, patterns)):
        out = F.when(path.rlike(found[0]), F.lit(not found[1])).otherwise(out)
    return out


def ignore_rules(files: DataFrame) -> DataFrame:
    """The rules of the ignore files among files(path, content): (dir, place, pattern, back), patterns for paths below the directory."""
    base = F.regexp_extract("path", "([^/]*)$", 1)
    kind = F.array_position(F.array(*map(F.lit, IGNORE_FILES)), base)
    lines = files.filter(kind > 0).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), kind.alias("kind"), F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("line", "text"))

    def parsed(parts):
        for f in parts:
            rules = f["text"].map(ignore_regex)
            f = f[rules.notna()]
            rules = rules[rules.notna()]
            yield f.assign(pattern=[r[0] for r in rules], back=[r[1] for r in rules])[["dir", "kind", "line", "pattern", "back"]]

    rules = lines.mapInPandas(parsed, "dir string, kind long, line int, pattern string, back boolean")
    return rules.select("dir", F.struct("kind", "line").alias("place"), "pattern", "back")


def hidden(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The paths(path) that ignore files hide: of all rules above a path that match, the one of the deepest directory and last place decides."""
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest")))).alias("a"))
    both = above.select("path", "a.*").join(rules, "dir").filter("rest rlike pattern")
    last = both.groupBy("path").agg(F.max_by("back", F.struct("depth", "place")).alias("back"))
    return last.filter("not back").select("path")


def select_files(files: DataFrame, patterns: list[str] = (), extra_dirs: list[str] = (), excluded: list[str] = (), record_sensitive: bool = False) -> DataFrame:
    """(path, language, hash, content) of a listing files(path, content), paths being relative to the root.

    Ignored directories, what ignore files and the given patterns (which an ignore file can take back) hide, nested repositories
    and excluded trees are left out; credential files too, or, if they are to be recorded, they have no content and a hash of
    their name alone.
    """
    path = F.col("path")
    rows = files.filter(~in_ignored_dir(path, list(extra_dirs)) & ~under(path, list(excluded)))
    given = [(i, *r) for i, r in enumerate(map(ignore_regex, patterns)) if r]
    rules = ignore_rules(rows)
    if given:
        first = files.sparkSession.createDataFrame(given, "line int, pattern string, back boolean")
        rules = rules.unionByName(first.select(F.lit("").alias("dir"), F.struct(F.lit(0).cast("long").alias("kind"), "line").alias("place"), "pattern", "back"))
    marker = "|".join(m.replace(".", "[.]") for m in VCS_MARKERS)
    nested = files.select(F.regexp_extract(path, f"^(.+)/(?:{marker})(?:/|$)", 1).alias("dir")).filter("dir <> ''").distinct()
    parts = F.split("path", "/")
    above = rows.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir"))
    inside = above.join(nested, "dir", "left_semi").select("path").distinct()
    rows = rows.join(inside, "path", "left_anti").join(hidden(rows.select("path"), rules), "path", "left_anti")
    secret = is_sensitive(path)
    if not record_sensitive:
        rows = rows.filter(~secret)
    digest = F.when(secret, F.sha2(F.concat(F.lit("sensitive:"), "path").cast("binary"), 256)).otherwise(F.sha2("content", 256))
    return rows.select("path", language_of(path).alias("language"), digest.alias("hash"), F.when(~secret, F.col("content")).alias("content"))


def discover(spark: SparkSession, root: str, **how) -> DataFrame:
    """select_files() of all files below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z0-9]+:/*", "/")
    path = F.substring(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), F.length(base) + 2, F.lit(10_000))
    return select_files(files.select(path.alias("path"), "content"), **how)


def repo_roots(paths: DataFrame, recursive: bool = False) -> DataFrame:
    """Roots of repositories in a listing of paths(path): directories with a marker; nested ones only if recursive."""
    root = F.regexp_extract("path", f"^(.*?)/?(?:^|/)(?:{'|'.join(m.replace('.', '[.]') for m in VCS_MARKERS)})(?:/.*)?$", 1)
    marked = F.col("path").rlike(f"(?:^|/)(?:{'|'.join(m.replace('.', '[.]') for m in VCS_MARKERS)})(?:/|$)")
    roots = paths.filter(marked).select(F.regexp_replace(root, "/$", "").alias("root")).distinct()
    if recursive:
        return roots
    above = roots.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("root", "/"))), lambda i: F.array_join(F.slice(F.split("root", "/"), 1, i - 1), "/"))).alias("dir")).filter("dir <> root")
    inner = above.join(roots.select(F.col("root").alias("dir")), "dir", "left_semi").select("root").distinct()
    return roots.join(inner, "root", "left_anti")
