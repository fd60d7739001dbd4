"""Sinks: upserts, deletes and replacements of stored tables, and what changed between two states.

Without a transactional format an update is a join that makes the new table, and a write of a new version to which a
pointer is moved.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphwright.operators.graph import rank, unrank


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """New rows replace existing ones of the same keys; of several new ones the last in order wins."""
    if order is not None:
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order.desc()))).filter("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(keys)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_edges(existing: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges are known by (src, dst, kind), and their confidence only rises; with nodes, edges without both ends are left out."""
    both = existing.unionByName(new).groupBy("src", "dst", "kind").agg(F.max(rank(F.col("confidence"))).alias("r"))
    out = both.select("src", "dst", "kind", unrank(F.col("r")).alias("confidence"))
    if nodes is not None:
        ids = nodes.select("id")
        out = out.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out.select("src", "dst", "kind", "confidence")


def delete_files(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of gone(file), and without the edges that touched them."""
    dead = nodes.join(gone.select("file"), "file", "left_semi").select("id")
    return nodes.join(gone.select("file"), "file", "left_anti"), detach(edges, dead)


def delete_kinds(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    return nodes.filter(~F.col("kind").isin(kinds)), detach(edges, nodes.filter(F.col("kind").isin(kinds)).select("id"))


def detach(edges: DataFrame, dead: DataFrame) -> DataFrame:
    """Edges without those that start or end at dead(id)."""
    return edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "kind", "confidence")


def delete_edges(edges: DataFrame, kind: str | None = None, confidence: str | None = None) -> DataFrame:
    rows = edges if kind is None else edges.filter(F.col("kind") != kind)
    return rows if confidence is None else rows.filter(F.col("confidence") != confidence)


def live_operations(operations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Operations whose node is still there."""
    return operations.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def changed_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) between two tables (path, hash): removed, added or changed."""
    a, b = stored.select("path", F.col("hash").alias("was")), current.select("path", F.col("hash").alias("now"))
    rows = a.join(b, "path", "full_outer")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return rows.select("path", change.alias("change")).filter("change is not null")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def replace_namespace(existing: DataFrame, space: str, model: str, new: DataFrame) -> DataFrame:
    """embeddings(space, model, node_id, vector) with a namespace replaced by new(ordinal, node_id, vector).

    The first of equal ids wins, vectors must be equally long (the query fails otherwise), and no rows clear the namespace.
    """
    first = new.withColumn("_n", F.row_number().over(W.partitionBy("node_id").orderBy("ordinal"))).filter("_n = 1")
    sizes = new.agg(F.countDistinct(F.size("vector")).alias("d"))
    checked = first.join(sizes).filter(F.when(F.col("d") <= 1, True).otherwise(F.raise_error(F.lit("vectors of different lengths")).isNull()))
    rows = checked.select(F.lit(space).alias("space"), F.lit(model).alias("model"), "node_id", "vector")
    return existing.filter(~((F.col("space") == space) & (F.col("model") == model))).unionByName(rows)


def embedding_index(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("space", "model").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"))


def with_human_key(embeddings: DataFrame, keys: DataFrame) -> DataFrame:
    """Embeddings with keys(node_id, key) for a backup that outlives the ids; empty where there is none."""
    return embeddings.join(keys, "node_id", "left").withColumn("key", F.coalesce("key", F.lit("")))


def restore(backup: DataFrame, keys: DataFrame) -> DataFrame:
    """A backup's embeddings under the present ids of keys(node_id, key); rows without a key keep theirs."""
    now = keys.select(F.col("node_id").alias("now"), "key").filter("key <> ''")
    return backup.join(now, "key", "left").select("space", "model", F.coalesce("now", "node_id").alias("node_id"), "vector")


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows, and the new ones whose keys aren't there yet, each once."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def bulk_load(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A first load: one row per node id, and edges once, between loaded nodes."""
    n = nodes.dropDuplicates(["id"])
    ids = n.select("id")
    e = edges.dropDuplicates(["src", "dst", "kind"]).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return n, e.select("src", "dst", "kind", "confidence")


def reinferred(edges: DataFrame, resolved: DataFrame, pending: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Edges with all inferred ones replaced by what pending(link, kind) links resolve to now: resolved(link, anchor, target); others are further inferred edges."""
    found = resolved.join(pending.select("link", "kind"), "link").select(F.col("anchor").alias("src"), F.col("target").alias("dst"), "kind", F.lit("inferred").alias("confidence"))
    found = found if others is None else found.unionByName(others.select("src", "dst", "kind", F.lit("inferred").alias("confidence")))
    return upsert_edges(edges.filter("confidence <> 'inferred'"), found)


def merge_spilled(table: DataFrame, spilled: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A table with the rows that other writers have set aside: of each key the last in order, the table's own first."""
    both = table.withColumn("_o", F.lit(None).cast(spilled.schema[order].dataType)).unionByName(spilled.withColumnRenamed(order, "_o"))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_o").desc_nulls_last()))
    return both.withColumn("_n", first).filter("_n = 1").drop("_n", "_o")


#: The file of a table that names the folders of its present version.
POINTER = "_current"
#: Parts of a table that upsert_table() keeps, by a hash of the keys.
BUCKETS = 256


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces a table: a new version is written beside the old one, then the pointer to it is replaced; read_table() follows it.

    Readers see the old or the new version, and a writer that fails leaves the old one in place.  The version before is kept
    for those who still read it, until the next write.
    """
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path.rstrip('/')}/{version}")
    _point(df.sparkSession, path, {"all": version})


def upsert_table(new: DataFrame, path: str, keys: list[str], order: Column | None = None) -> None:
    """upsert() of a stored table, which is kept in BUCKETS parts by its keys: only parts with new rows are read and written.

    A table that write_table() wrote is divided first.  It becomes visible at once, as in write_table().
    """
    spark = new.sparkSession
    folders = current_folders(spark, path) or {}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("string")
    if "all" in folders:
        kept, touched = spark.read.schema(new.schema).parquet(f"{path.rstrip('/')}/{folders['all']}"), None
        folders = {}
    else:
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # at most BUCKETS
        there = [f"{path.rstrip('/')}/{folders[b]}" for b in touched if b in folders]
        kept = spark.read.schema(new.schema).parquet(*there) if there else new.limit(0)
    version = f"v-{uuid.uuid4().hex}"
    merged = upsert(kept, new, keys, order).withColumn("_bucket", bucket)
    merged.write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{path.rstrip('/')}/{version}")
    if touched is None:
        touched = [r[0] for r in merged.select("_bucket").distinct().collect()]
    _point(spark, path, folders | {b: f"{version}/_bucket={b}" for b in touched})


def _point(spark: SparkSession, path: str, folders: dict[str, str]) -> None:
    """Moves a table's pointer to these folders, and removes versions that neither it nor the pointer before names."""
    before = current_folders(spark, path) or {}
    jvm = spark._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    aside = pointer.suffix(f".{uuid.uuid4().hex}")
    fs = pointer.getFileSystem(hadoop)
    fs.mkdirs(pointer.getParent())
    out = fs.create(aside)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), hadoop).rename(aside, pointer, overwrite)
    named = {x.split("/")[0] for x in (*before.values(), *folders.values())}
    for status in fs.listStatus(pointer.getParent()):
        if status.getPath().getName() not in {POINTER, *named}:
            fs.delete(status.getPath(), True)


def current_folders(spark: SparkSession, path: str) -> dict[str, str] | None:
    """The folders of a table's present version, by part; None if there is no table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The present version of a stored table; None if there is none."""
    folders = current_folders(spark, path)
    if folders is None:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*[f"{path.rstrip('/')}/{x}" for x in folders.values()])


def backup_manifest(embeddings: DataFrame) -> DataFrame:
    """What a backup holds: rows and widths by namespace."""
    return embedding_index(embeddings).orderBy("space", "model")


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Rows as JSON objects."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def yaml_of(df: DataFrame) -> Column:
    """A row as an item of a YAML list, keys sorted; texts are quoted where YAML would read them as something else."""

    def value(c: str):
        kind = df.schema[c].dataType.simpleString()
        if kind != "string":
            nested = F.when(F.col(f"`{c}`").isNotNull(), F.to_json(F.col(f"`{c}`")))
            return F.coalesce(nested if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`").cast("string"), F.lit("null"))
        plain = F.col(f"`{c}`").rlike(r"^[A-Za-z_/][A-Za-z0-9_ ./@-]*$") & ~F.lower(f"`{c}`").isin("true", "false", "null", "yes", "no", "on", "off", "y", "n") & ~F.col(f"`{c}`").endswith(" ")
        quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.col(f"`{c}`"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
        return F.coalesce(F.when(plain, F.col(f"`{c}`")).otherwise(quoted), F.lit("null"))

    lines = [F.concat(F.lit(f"{'- ' if i == 0 else '  '}{c}: "), value(c)) for i, c in enumerate(sorted(df.columns))]
    return F.concat_ws("\n", *lines)


def as_yaml(df: DataFrame, name: str = "yaml") -> DataFrame:
    return df.select(yaml_of(df).alias(name))


def graph_html(elements: DataFrame, title: str = "Graph") -> str:
    """A page that shows the elements of graph_elements(), which must be few: a view, not an export."""
    import html

    rows = [r.element for r in elements.select("element").toLocalIterator()]
    data = "[" + ",".join(rows).replace("</", "<\\/") + "]"
    json.loads(data.replace("<\\/", "</"))
    script = "const e=JSON.parse(document.getElementById('d').textContent),n=e.filter(x=>!x.data.source),p={};const s=document.getElementById('g'),r=260;n.forEach((x,i)=>{const a=2*Math.PI*i/n.length;p[x.data.id]=[300+r*Math.cos(a),300+r*Math.sin(a)]});const add=(t,o,x)=>{const y=document.createElementNS('http://www.w3.org/2000/svg',t);for(const k in o)y.setAttribute(k,o[k]);if(x)y.textContent=x;s.appendChild(y)};e.filter(x=>x.data.source).forEach(x=>{const[a,b]=[p[x.data.source],p[x.data.target]];if(a&&b)add('line',{x1:a[0],y1:a[1],x2:b[0],y2:b[1],stroke:'#999'})});n.forEach(x=>{const a=p[x.data.id];add('circle',{cx:a[0],cy:a[1],r:4,fill:x.data.distance===undefined?'#456':'#c40'});add('text',{x:a[0]+6,y:a[1],'font-size':9},x.data.name)})"
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><script id="d" type="application/json">{data}</script><svg id="g" viewBox="0 0 600 600"></svg><script>{script}</script>'


def graph_elements(nodes: DataFrame, edges: DataFrame, impact: DataFrame | None = None) -> DataFrame:
    """A graph view: one JSON element per node and per edge between them, with the distance of an impact overlay."""
    n = nodes.select("id", "name", "kind", "file")
    n = n.join(impact.select("id", "distance", "class"), "id", "left") if impact is not None else n
    ids = nodes.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    data = [F.col(c) for c in n.columns]
    a = n.select(F.lit("node").alias("group"), F.to_json(F.struct(F.struct(*data).alias("data"))).alias("element"))
    b = e.select(F.lit("edge").alias("group"), F.to_json(F.struct(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "confidence").alias("data"))).alias("element"))
    return a.unionByName(b)
