"""Version history: logs, diffs, contributors and symbol histories."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Framing of log text: records, fields, co-authors.
RECORD, FIELD, ITEM = "\x1e", "\x1f", "\x1d"
FORMAT = f"{RECORD}%H{FIELD}%ct{FIELD}%an{FIELD}%ae{FIELD}%s{FIELD}%(trailers:key=Co-authored-by,valueonly,separator={ITEM})"
LOG_SCHEMA = "repo string, part int, log string"
#: Commits in one row of a log.
PART = 2000


def parse_log(logs: DataFrame) -> DataFrame:
    """logs(repo, log), in several parts if need be, to a row per commit: hash, committed_at, author, email, subject, coauthors, files, ordinal (oldest first)."""
    part = F.col("part") if "part" in logs.columns else F.lit(0)
    records = logs.select("repo", part.alias("part"), F.posexplode(F.split("log", RECORD)).alias("place", "record")).filter(F.trim("record") != "")
    lines = F.split("record", "\n")
    head = F.split(F.get(lines, F.lit(0)), FIELD)
    files = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x) != "")
    rows = records.select("repo", "part", "place", head.alias("h"), files.alias("files")).filter(F.size("h") >= 5)
    people = F.filter(F.split(F.coalesce(F.get("h", F.lit(5)), F.lit("")), ITEM), lambda x: F.trim(x) != "")
    return rows.select(
        "repo",
        F.get("h", F.lit(0)).alias("hash"),
        F.get("h", F.lit(1)).cast("long").alias("committed_at"),
        F.get("h", F.lit(2)).alias("author"),
        F.get("h", F.lit(3)).alias("email"),
        F.get("h", F.lit(4)).alias("subject"),
        people.alias("coauthors"),
        "files",
        F.row_number().over(W.partitionBy("repo").orderBy(F.desc("part"), F.desc("place"))).alias("ordinal"),
    )


class _Partition(InputPartition):
    def __init__(self, repo: str, root: str, head: str | None):
        self.repo, self.root, self.head = repo, root, head


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [x.split("=", 1) for x in options.get("repos", "").split(";") if x]
        self.heads = dict(x.split("=", 1) for x in options.get("heads", "").split(";") if x)

    def partitions(self) -> list[InputPartition]:
        return [_Partition(name, root, self.heads.get(name)) for name, root in self.roots]

    def read(self, partition: _Partition) -> Iterator[tuple]:
        def git(*args: str) -> list[str]:
            return ["git", "-C", partition.root, *args]

        since = []
        if partition.head:  # unless history was rewritten
            known = subprocess.run(git("merge-base", "--is-ancestor", partition.head, "HEAD"), capture_output=True)
            since = [f"{partition.head}..HEAD"] if known.returncode == 0 else []
        run = subprocess.Popen(git("log", "--no-merges", "--name-only", f"--pretty=format:{FORMAT}", *since), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace")
        part, lines, seen = 0, [], 0
        with run:
            for line in run.stdout:
                if line.startswith(RECORD):
                    if seen == PART:
                        yield partition.repo, part, "".join(lines)
                        part, lines, seen = part + 1, [], 0
                    seen += 1
                lines.append(line)
        yield partition.repo, part, "".join(lines)


class GitLog(DataSource):
    """spark.read.format("gitlog").option("repos", "name=/path;...").option("heads", "name=hash;..."): a partition per repository, and a row for every PART commits."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def parse_diff(diff: str) -> list[dict]:
    """Files of a unified diff without context: path, whether it is gone, and the changed ranges on the new side."""
    out: list[dict] = []
    for line in diff.splitlines():
        if m := re.match(r"diff --git a/(.*) b/(.*)", line):
            out.append({"file": m[2], "deleted": False, "ranges": []})
        elif not out:
            continue
        elif line == "+++ /dev/null":
            out[-1]["deleted"] = True
        elif m := re.match(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@", line):
            start, n = int(m[1]), int(m[2] or 1)
            out[-1]["ranges"].append({"start": max(start, 1), "end": max(start, 1) + max(n, 1) - 1})
    return out


CHANGES = "file string, deleted boolean, ranges array<struct<start: int, end: int>>"


def changes(spark, diff: str) -> DataFrame:
    return spark.createDataFrame([(r["file"], r["deleted"], [(x["start"], x["end"]) for x in r["ranges"]]) for r in parse_diff(diff)], CHANGES)


def changes_of(diffs: DataFrame) -> DataFrame:
    """The files and ranges of diffs(diff), one unified diff a row."""

    def run(parts):
        for f in parts:
            rows = [r for d in f["diff"].dropna() for r in parse_diff(d)]
            yield pd.DataFrame(rows, columns=["file", "deleted", "ranges"])

    return diffs.select("diff").mapInPandas(run, CHANGES)


def contributors(commits: DataFrame, n: int = 100) -> DataFrame:
    """The n authors of each repository with most commits."""
    c = commits.groupBy("repo", "author", "email").agg(F.count(F.lit(1)).alias("commits"))
    return c.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("commits"), "email"))).filter(F.col("place") <= n)


def merged_history(*passes: DataFrame) -> DataFrame:
    """Several passes over a symbol's history as one, newest first; of a commit's rows the one of the first pass stays."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_pass", F.lit(i)) for i, p in enumerate(passes)])
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("hash").orderBy("_pass"))).filter("_n = 1")
    return first.drop("_n", "_pass").orderBy(F.desc("committed_at"), "hash")


class _SymbolReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(2 if self.options.get("lines") else 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options

        def git(*args: str) -> str:
            run = subprocess.run(["git", "-C", o["root"], *args], capture_output=True, text=True, errors="replace")
            return run.stdout if run.returncode == 0 else ""

        way = ["--all", f"-S{o['symbol']}", "--", o["file"]] if partition.value == 0 else ["-s", f"-L{o['lines']}:{o['file']}"]
        for line in git("log", f"-n{o.get('limit', '50')}", f"--pretty=format:%H{FIELD}%ct{FIELD}%an{FIELD}%s", *way).splitlines():
            if len(row := line.split(FIELD)) == 4:
                inside = subprocess.run(["git", "-C", o["root"], "merge-base", "--is-ancestor", row[0], "HEAD"], capture_output=True).returncode == 0
                branches = [] if inside else git("branch", "--all", "--format=%(refname:short)", "--contains", row[0]).split()
                yield partition.value == 0, row[0], int(row[1]), row[2], row[3], inside, branches


class GitSymbol(DataSource):
    """spark.read.format("gitsymbol") with options root, file, symbol and, where the symbol is in HEAD, lines ("10,20"), limit.

    The commits that changed the lines, and those of all branches that changed how often the name occurs; pickaxe marks the latter.
    """

    @classmethod
    def name(cls) -> str:
        return "gitsymbol"

    def schema(self) -> str:
        return "pickaxe boolean, hash string, committed_at long, author string, subject string, in_head boolean, branches array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _SymbolReader(dict(self.options))


def symbol_history(spark, root: str, file: str, symbol: str, lines: str | None = None, limit: int = 50) -> DataFrame:
    """A symbol's commits on all branches, newest first."""
    spark.dataSource.register(GitSymbol)
    how = {"root": root, "file": file, "symbol": symbol, "limit": str(limit)} | ({"lines": lines} if lines else {})
    rows = spark.read.format("gitsymbol").options(**how).load()
    return merged_history(rows.filter("not pickaxe"), rows.filter("pickaxe"))


def narrated(commits: DataFrame, authors: int = 10) -> DataFrame:
    """The facts of repositories' histories for a narrative, one text per repository: span, contributors, subjects from old to new."""
    day = F.date_format(F.timestamp_seconds("committed_at"), "yyyy-MM-dd")
    lines = commits.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("committed_at", "hash", day.alias("day"), "subject"))).alias("c"))
    top = contributors(commits.withColumn("email", F.col("author")), authors).groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("place", F.concat("author", F.lit(" ("), "commits", F.lit(")")).alias("t")))).alias("a"))
    out = lines.join(top, "repo")
    span = F.concat(F.lit("Span: "), F.get("c", F.lit(0))["day"], F.lit(" to "), F.element_at("c", -1)["day"])
    people = F.concat(F.lit("Contributors: "), F.array_join(F.transform("a", lambda x: x["t"]), ", "))
    log = F.array_join(F.transform("c", lambda x: F.concat(F.lit("- "), x["day"], F.lit(" "), x["subject"])), "\n")
    return out.select("repo", F.concat_ws("\n", F.concat(F.lit("Repository: "), "repo"), span, people, F.lit("Commits, oldest first:"), log).alias("text"))


def recent(commits: DataFrame, n: int) -> DataFrame:
    return commits.orderBy(F.desc("committed_at"), "hash").limit(n)
