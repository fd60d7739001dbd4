"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards, and every shard has a weight; a region or rack weighs
what is below it.  A key descends: on each level every child draws -ln(u) / weight from a hash u of (key, child),
and the smallest draw wins, so that children win in proportion to their weights.  A draw depends on the child alone,
so where a weight rises, keys move only into that child's subtree, and nothing moves between the others.

``grow`` adds one shard as a region of its own.  The other regions' draws stay as they are; so the new shard takes
rows only into itself, and the key and the number of shards decide the place (the law ``key``).

All of it is expressions on the row: no Python, no shuffle.  ``numbered`` adds gapless slots: rows that agree in key, size
and checksum are counted first, the counted ones are numbered within (shard, bucket), with as many buckets as the rows call
for, and the buckets' offsets come from summed counts; so no task holds a shard, whatever its size.  Counted rows are then
repeated, ``REPEATS`` of one at a time, which are dealt out.  Texts are not shuffled.

Null keys are one key.  Repeated rows (ties) go to the same shard and get slots of their own.  Null texts have no bytes.
Texts count whole, however long.  Empty tables give no rows.  Extra columns pass through ``assign``, and new names get
underscores where they clash; ``numbered`` doesn't read them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphwright.llm.words import fresh
from graphwright.plans.scratch import Settled

#: Rows to be numbered in one bucket.
BUCKET_ROWS = 10_000
#: Equal rows that are repeated at a time.
REPEATS = 10_000
#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Hexadecimal digits of the hashes.
HASH_DIGITS = 12


@dataclass(frozen=True)
class Tree:
    """weights[region][rack][shard]."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        return Tree((*self.weights, ((weight,),)))


def even(regions: int, racks: int, shards: int) -> Tree:
    return Tree((((1.0,) * shards,) * racks,) * regions)


#: 40 shards.
TREE = even(4, 2, 5)


def _descend(key: Column, path: Column, weights: Column) -> Column:
    """The number of the child that wins; path names the parent, weights are its children's."""

    def draw(w: Column, i: Column) -> Column:
        hashed = F.substring(F.md5(F.concat_ws("|", key, F.concat_ws(".", path, i.cast("string")))), 1, HASH_DIGITS)
        u = (F.conv(hashed, 16, 10).cast("double") + 0.5) / F.lit(float(16**HASH_DIGITS))
        return F.struct((-F.log(u) / w).alias("draw"), i.alias("i"))

    return F.array_min(F.transform(weights, draw))["i"]


def place(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """df with the shard of the key (shards are counted in order of region, rack and place)."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    region, rack = fresh(df.columns, "region", "rack")
    nested = F.array(*[F.array(*[F.array(*map(F.lit, map(float, k))) for k in r]) for r in tree.weights])
    of_racks = F.array(*[F.array(*[F.lit(float(sum(k))) for k in r]) for r in tree.weights])
    of_regions = F.array(*[F.lit(float(sum(map(sum, r)))) for r in tree.weights])
    first, firsts = 0, []
    for r in tree.weights:
        firsts.append(F.array(*[F.lit(first + sum(len(x) for x in r[:i])) for i in range(len(r))]))
        first += sum(map(len, r))
    out = df.withColumn(region, _descend(key, F.lit("tree"), of_regions))
    at = F.col(region)
    out = out.withColumn(rack, _descend(key, at.cast("string"), F.get(of_racks, at)))
    path = F.concat_ws(".", at.cast("string"), F.col(rack).cast("string"))
    leaf = _descend(key, path, F.get(F.get(nested, at), F.col(rack)))
    return out.withColumn(name, (F.get(F.get(F.array(*firsts), at), F.col(rack)) + leaf).cast("int")).drop(region, rack)


def assign(df: DataFrame, key_col: str = "doc_id", tree: Tree = TREE) -> DataFrame:
    """df with its shard, and the shard that it would have if the tree had one more; names get underscores where df has them."""
    shard, grown = fresh(df.columns, "shard", "grown_shard")
    key = F.col(f"`{key_col}`")
    return place(place(df, key, tree, shard), key, tree.grow(), grown)


def numbered(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", tree: Tree = TREE) -> DataFrame:
    """One row per row of df: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    Within a shard, slots follow the order of a hash of key and text; a bucket is a range of that hash.  Texts
    are read once and only their sizes and checksums are settled, in a small table.
    """
    text = F.col(f"`{text_col}`")
    small = df.select(F.col(f"`{key_col}`").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))), 1, HASH_DIGITS), 16, 10).cast("long")
    rows = Settled(assign(small, "doc_id", tree).withColumn("order", order)).df
    buckets = max(1, math.ceil(rows.count() / tree.shards / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.floor(F.col("order") * (buckets / 16**HASH_DIGITS)).cast("long"))
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    ahead = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "bucket").orderBy("order", "doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    first = alike.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["shard", "bucket"])
    first = first.withColumn("first", F.col("offset") + F.col("before"))

    def placed(some: DataFrame, start: Column, stop: Column) -> DataFrame:
        slots = some.withColumn("slot", F.explode(F.sequence(start, stop)))
        return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

    few = placed(first.filter(F.col("n") <= REPEATS), F.col("first"), F.col("first") + F.col("n") - 1)
    many = first.filter(F.col("n") > REPEATS).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))))
    start = F.col("first") + F.col("step") * REPEATS
    return few.unionByName(placed(many.repartition("doc_id", "step"), start, F.least(start + REPEATS - 1, F.col("first") + F.col("n") - 1)))


QUERY_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM crc_table WHERE step < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM crc_table WHERE step = 8),
docs AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(octet_length(encode(text)), 0) + 16 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM documents, tab),
regions AS (SELECT unnest(range(5)) AS r),
draws AS (
  SELECT d.k, r, -ln((('0x' || substr(md5(d.k || '|tree.' || r), 1, 12))::BIGINT + 0.5) / 281474976710656) / CASE WHEN r < 4 THEN 10 ELSE 1 END AS draw
  FROM (SELECT DISTINCT k FROM docs) d, regions),
top AS (
  SELECT k, arg_min(r, draw) FILTER (r < 4) AS r, arg_min(r, draw) AS grown_r FROM draws GROUP BY k),
rack AS (
  SELECT k, any_value(t.r) AS r, any_value(grown_r) AS grown_r, arg_min(c, -ln((('0x' || substr(md5(k || '|' || t.r || '.' || c), 1, 12))::BIGINT + 0.5) / 281474976710656)) AS c
  FROM top t, range(2) x(c) GROUP BY k),
leaf AS (
  SELECT k, any_value(r) AS r, any_value(grown_r) AS grown_r, any_value(c) AS c,
         arg_min(s, -ln((('0x' || substr(md5(k || '|' || r || '.' || c || '.' || s), 1, 12))::BIGINT + 0.5) / 281474976710656)) AS s
  FROM rack, range(5) x(s) GROUP BY k),
-- the children of a region don't depend on the tree's growth, so a row that stays in its region keeps its shard
placed AS (
  SELECT d.doc_id, d.size, d.crc, d.k, (l.r * 10 + l.c * 5 + l.s)::INT AS shard,
         (CASE WHEN l.grown_r = 4 THEN 40 ELSE l.r * 10 + l.c * 5 + l.s END)::INT AS grown_shard
  FROM docs d JOIN leaf l USING (k))
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(concat_ws('|', k, crc::VARCHAR)), 1, 12))::BIGINT, doc_id, crc, size) - 1 AS slot,
       grown_shard
FROM placed
"""
