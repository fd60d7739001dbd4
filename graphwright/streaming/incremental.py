"""Incremental state: file updates, per-repository watermarks, retractions, and streams over events.

The streaming queries are ordinary DataFrame code over readStream sources; state is kept by Spark's checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphwright.operators.tables import changed_files, delete_files, upsert, upsert_edges, upsert_table


def update_graph(nodes: DataFrame, edges: DataFrame, files: DataFrame, current: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and files(path, hash) after an update: files that went or changed are dropped, and what was parsed again is put in."""
    change = changed_files(files, current)
    gone = change.filter("change in ('removed', 'changed')").select(F.col("path").alias("file"))
    kept_nodes, kept_edges = delete_files(nodes, edges, gone)
    nodes = upsert(kept_nodes, new_nodes, ["id"])
    return nodes, upsert_edges(kept_edges, new_edges, nodes), current


def nothing_to_do(files: DataFrame, current: DataFrame, revision: str, stored_revision: str | None) -> bool:
    """Whether an update would change nothing: the same revision and the same files."""
    return revision == stored_revision and changed_files(files, current).isEmpty()


def new_commits(log: DataFrame, heads: DataFrame) -> DataFrame:
    """log(repo, ordinal, hash, ...), oldest first, after each repository's saved head(repo, head).

    Where the saved head is no longer in the log, history was rewritten and all of it is new.
    """
    at = log.join(heads, "repo", "left").withColumn("is_head", F.coalesce(F.col("hash") == F.col("head"), F.lit(False)))
    seen = F.max(F.when(F.col("is_head"), F.col("ordinal"))).over(W.partitionBy("repo"))
    return at.withColumn("seen", seen).filter("seen is null or ordinal > seen").drop("is_head", "seen", "head")


def saved_heads(log: DataFrame) -> DataFrame:
    return log.groupBy("repo").agg(F.max_by("hash", "ordinal").alias("head"))


def auto_ignore(walks: DataFrame) -> DataFrame:
    """walks(repo, everyone, kept, full_walk, cached) with what becomes of each repository on the ignore list.

    One with commits of mine is taken off the list; one whose whole history, in a cache of its own, has none is put on it.  An
    incremental walk that finds nothing says nothing, nor does one for everyone's commits or in somebody's own clone.
    """
    action = F.when(F.col("everyone"), "keep").when(F.col("kept") >= 1, "unignore").when(F.col("full_walk") & F.col("cached"), "ignore").otherwise("keep")
    return walks.withColumn("action", action)


def ignore_list(ignored: DataFrame, decided: DataFrame) -> DataFrame:
    """The next list(repo) from the present one and auto_ignore()'s rows."""
    kept = ignored.select("repo").join(decided.filter("action = 'unignore'").select("repo"), "repo", "left_anti")
    return kept.unionByName(decided.filter("action = 'ignore'").select("repo")).distinct()


def replay_journal(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of a journal of JSON lines(value, ordinal): torn lines are skipped, and the last row of each key wins."""
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "ordinal").filter("r is not null and r.key is not null")
    return rows.groupBy("r.key").agg(F.max_by("r", "ordinal").alias("r")).select("r.*")


def activity(events: DataFrame, size: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums of events(ts, event_type, value); works on a stream and on a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", watermark)
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions of users: runs of events with no longer gap than given."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def upsert_stream(spark: SparkSession, source: DataFrame, path: str, keys: list[str], checkpoint: str, order: str):
    """A streaming query that upserts each batch of source into a stored table; batches that are replayed change nothing.

    A batch writes the parts of the table that its keys are in, and no others.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            upsert_table(batch, path, keys, F.col(order))

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
