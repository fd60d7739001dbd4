"""Captured JSON payloads: registries, tracked time, forge listings and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "repos array<struct<name: string, root: string, visibility: string, groups: array<string>, ids: array<string>, contributors: array<struct<name: string, email: string, commits: bigint>>>>"
EMBEDDING = "node_id string, space string, model string, dim int, vector array<float>"
_ITEM = "array<struct<name: string, total_seconds: double>>"
#: Dimensions of tracked time.
DIMENSIONS = ["projects", "languages", "editors", "operating_systems", "categories", "machines"]
SUMMARIES = "data array<struct<range: struct<date: string>, grand_total: struct<total_seconds: double>, " + ", ".join(f"{d}: {_ITEM}" for d in DIMENSIONS) + ">>"
FORGE_FIELDS = ["id bigint", "full_name string", "private boolean", "fork boolean", "archived boolean", "owner struct<login: string, type: string>", "clone_url string"]


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """The JSON texts (json) under a path, one a file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def registry_of(texts: DataFrame) -> DataFrame:
    """Registered repositories of JSON texts(json); one that can't be read registers none."""
    return texts.select(F.explode(F.from_json("json", f"struct<{REGISTRY.replace('repos array', 'repos: array', 1)}>")["repos"]).alias("r")).select("r.*")


def registry(spark: SparkSession, path: str) -> DataFrame:
    return registry_of(documents_of(spark, path))


def tracked_time_of(texts: DataFrame) -> DataFrame:
    """(day, dimension, name, seconds) of daily summaries(json), with the day's total as a dimension of its own."""
    d = texts.select(F.explode(F.from_json("json", f"struct<{SUMMARIES.replace('data array', 'data: array', 1)}>")["data"]).alias("d"))
    parts = [d.select(F.col("d.range.date").alias("day"), F.lit(n).alias("dimension"), F.explode(f"d.{n}").alias("x")).select("day", "dimension", "x.name", F.col("x.total_seconds").cast("long").alias("seconds")) for n in DIMENSIONS]
    out = d.select(F.col("d.range.date").alias("day"), F.lit("total").alias("dimension"), F.lit("total").alias("name"), F.col("d.grand_total.total_seconds").cast("long").alias("seconds"))
    for p in parts:
        out = out.unionByName(p)
    return out


def tracked_time(spark: SparkSession, path: str) -> DataFrame:
    return tracked_time_of(documents_of(spark, path))


def forge_repos_of(texts: DataFrame, forks: bool = False, archived: bool = False, organizations: bool = True) -> DataFrame:
    """Repositories of listings(json), an array or one object each, without forks, archived or organizations' ones unless asked for."""
    kind = f"struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in FORGE_FIELDS)}>"
    one = F.array(F.from_json("json", kind))
    rows = texts.select(F.explode(F.when(F.ltrim("json").startswith("["), F.from_json("json", f"array<{kind}>")).otherwise(one)).alias("r")).select("r.*").filter("id is not null")
    keep = (F.lit(forks) | ~F.coalesce("fork", F.lit(False))) & (F.lit(archived) | ~F.coalesce("archived", F.lit(False)))
    return rows.filter(keep & (F.lit(organizations) | (F.coalesce("owner.type", F.lit("User")) == "User")))


def forge_repos(spark: SparkSession, path: str, **how) -> DataFrame:
    return forge_repos_of(documents_of(spark, path), **how)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Embeddings of JSON lines; a namespace with vectors of different lengths fails the query."""
    rows = spark.read.schema(EMBEDDING).json(path).filter("node_id is not null and vector is not null")
    sizes = rows.groupBy("space", "model").agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b"))
    ok = F.when(F.col("a") == F.col("b"), True).otherwise(F.raise_error(F.concat(F.lit("vectors of different lengths in "), "space", F.lit("/"), "model")).isNull())
    return rows.join(sizes, ["space", "model"]).filter(ok).select("node_id", "space", "model", "vector")


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.select("node_id", "space", "model", F.size("vector").alias("dim"), "vector").write.mode("overwrite").json(path)


def decoded(text, schema: str):
    """A column of JSON as a struct; of malformed text an empty one."""
    return F.coalesce(F.from_json(text, schema), F.from_json(F.lit("{}"), schema))


def merged_config(layers: list[str]) -> dict:
    """TOML layers from weak to strong: tables are merged, stronger values win, and the links of all layers are kept in order."""
    import tomllib

    def merge(low: dict, high: dict) -> dict:
        return low | {k: merge(low[k], v) if isinstance(v, dict) and isinstance(low.get(k), dict) else v for k, v in high.items()}

    out, links = {}, []
    for text in layers:
        table = tomllib.loads(text)
        links += table.pop("links", [])
        out = merge(out, table)
    return out | ({"links": links} if links else {})


def configs_of(layers: DataFrame) -> DataFrame:
    """layers(repo, layer, text) of TOML to (repo, config), the merged settings as JSON with sorted keys; a layer that can't be read is left out."""

    def run(parts):
        import json
        import tomllib

        def readable(text: str) -> bool:
            try:
                tomllib.loads(text)
            except tomllib.TOMLDecodeError:
                return False
            return True

        for f in parts:
            yield f.assign(config=[json.dumps(merged_config([t for t in texts if readable(t)]), sort_keys=True, separators=(",", ":"), default=str) for texts in f["texts"]])[["repo", "config"]]

    rows = layers.filter("text is not null").groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(F.struct("layer", "text"))), lambda x: x["text"]).alias("texts"))
    return rows.mapInPandas(run, "repo string, config string")


def manifest_files(paths: DataFrame, depth: int = 3) -> DataFrame:
    """The paths(path) of at most so many segments."""
    return paths.filter(F.size(F.split("path", "/")) <= depth)


def load_from(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """Rows of a file by its ending: CSV with a header, JSON lines or Parquet."""
    reader = spark.read.schema(columns) if columns else spark.read
    if path.rstrip("/").endswith(".csv"):
        return reader.option("header", True).csv(path)
    return reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else reader.parquet(path)


def readme_paragraph(text: str) -> str | None:
    """The first paragraph of prose: no headings, badges, quotes, lists, tables or code."""
    import re

    text = re.sub(r"(?s)```.*?```|<!--.*?-->", "", text)
    for block in re.split(r"\n\s*\n", text):
        line = " ".join(x.strip() for x in block.strip().splitlines())
        if line and not re.match(r"[#>|<\-*+=]|!\[|\[!\[|\d+\.\s", line):
            return re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", line)
    return None
