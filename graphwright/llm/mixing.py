"""Mixing sources to target weights by hash-threshold histograms.

Sizes are word counts.  Each source has a weight; the mix has as many words as the input, shared by weight,
but a source's target stops at ``CAP`` times its size and the excess is reshared by weight until none is above.
Every document of a source is taken floor(target / source size) times, and the rest of the target is met by
taking some documents once more: those whose hash is at most the source's threshold.

The thresholds come from histograms, without sorting documents: words are summed by source and by the leading
digits of the hash, the buckets that fit into the budget are accepted whole, and only the one bucket on the
boundary is split by the next digits, until the boundary holds one hash value, which fits or doesn't.  Thresholds
of smaller budgets lie below those of larger ones, so mixes are nested.  Each level sums a small table (source,
hash, size) with map-side partial sums: at most BINS rows per source and task are shuffled, whatever a source's
share of the rows, and one row per source reaches the driver (and goes back to the executors in a broadcast if there are
at most ``MANY`` sources, else in a join).

The hash is of key and text, so that rows without keys or with repeated ones are told apart.  Rows that agree in both have
one hash; if it is the boundary, as many of them are taken once more as fit.  They are alike but for extra columns, so which
of them doesn't show; they are numbered in the order in which tasks settled them, so no task holds the group.

Null texts have size 0; a null source is a source, the last, and a null key is a key.  Empty tables, and sources without
words, have targets of 0.  Texts count whole, however long; one longer than what is left of a target isn't taken once more.
Ties are rows that agree in key and text.  Extra columns pass through, and new names get underscores where they clash.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from graphwright.llm.words import fresh
from graphwright.plans.scratch import Settled

#: Weights of the sources in order of their names' code points (null last), repeating.
WEIGHTS = (5, 2, 1)
#: A source gives no more than this many times its size.
CAP = 3
#: Hashes have HASH_DIGITS hexadecimal digits, refined by DIGITS of them at a time: BINS buckets a level.
HASH_DIGITS, DIGITS = 16, 2
BINS = 16**DIGITS
#: Sources whose plan is broadcast.
MANY = 10_000

_PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("copies", T.LongType()), T.StructField("threshold", T.StringType()), T.StructField("edge", T.StringType()), T.StructField("more", T.LongType())])


def words(text: Column) -> Column:
    """The number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def digits(key: Column, text: Column) -> Column:
    """A hash of HASH_DIGITS hexadecimal digits, which compare as numbers do."""
    parts = (F.coalesce(x, F.lit("null")) for x in (key.cast("string"), F.md5(text)))
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, HASH_DIGITS)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> list[Fraction]:
    """Targets of sources in order: the whole by weight, stopped at cap times the size, the excess reshared."""
    left, out = Fraction(sum(sizes)), [Fraction(0)] * len(sizes)
    free = {i: Fraction(weights[i % len(weights)]) for i in range(len(sizes))}
    while free:
        share = left / sum(free.values())
        full = [i for i, w in free.items() if share * w >= cap * sizes[i]]
        for i in full or free:
            out[i] = Fraction(cap * sizes[i]) if full else share * free[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        for i in full:
            del free[i]
    return out


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> list[tuple]:
    """From rows (source, hash, size), a row of _PLAN per source: its size, target, whole copies, and the hash threshold of those taken once more.

    Of the rows with the hash edge, which don't all fit, as many as more says are taken too.
    """
    spark = sized.sparkSession

    def histogram(rows: DataFrame, deep: int) -> DataFrame:
        return rows.groupBy("source", F.substring("hash", 1, deep).alias("prefix")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))

    level = histogram(sized, DIGITS)
    sizes = sorted(((r[0], r[1]) for r in level.groupBy("source").agg(F.sum("size")).collect()), key=lambda r: (r[0] is None, [*map(ord, r[0] or "")]))
    goal = targets([n for _, n in sizes], weights, cap)
    out = [[s, n, float(t), int(t // n) if n else 0, "", None, 0] for (s, n), t in zip(sizes, goal, strict=True)]
    left = {i: int(t - out[i][3] * out[i][1]) for i, t in enumerate(goal)}
    todo, deep = [i for i, x in left.items() if x > 0], DIGITS
    while todo:
        budget = _small(spark.createDataFrame([(i, out[i][0], left[i]) for i in todo], "k int, name string, budget long"), len(todo))
        run = level.join(budget, level["source"].eqNullSafe(budget["name"])).withColumn("upto", F.sum("size").over(W.partitionBy("k").orderBy("prefix")))
        fits = F.col("upto") <= F.col("budget")
        edge = F.min(F.when(~fits, F.struct("prefix", "lo", "hi", "size", "n")))
        found = run.groupBy("k").agg(F.max(F.when(fits, F.struct("upto", "hi"))).alias("whole"), edge.alias("edge")).collect()
        split = []
        for r in found:
            k, edge = r["k"], r["edge"]
            if r["whole"] is not None:
                left[k] -= r["whole"]["upto"]
                out[k][4] = r["whole"]["hi"]
            if edge is not None and edge["lo"] != edge["hi"]:
                split.append((out[k][0], edge["prefix"], k))
            elif edge is not None and edge["size"] % edge["n"] == 0:
                out[k][5:] = edge["lo"], left[k] * edge["n"] // edge["size"]
        todo = [k for *_, k in split]
        if todo:
            edges = _small(spark.createDataFrame(split, "name string, edge string, k int").drop("k"), len(split))
            inside = sized["source"].eqNullSafe(edges["name"]) & (F.substring(sized["hash"], 1, deep) == edges["edge"])
            deep += DIGITS
            level = histogram(sized.join(edges, inside, "left_semi"), deep)
    return [tuple(r) for r in out]


def _small(rows: DataFrame, n: int) -> DataFrame:
    """A table of n rows, to be broadcast if they are few."""
    return F.broadcast(rows) if n <= MANY else rows


def _mixed(rows: DataFrame, found: list[tuple], names: list[str], name: str, hash_: str) -> DataFrame:
    """rows(..., source, hash, size) with source_size, target and taken by plan's rows; source and hash, called name and hash_, are dropped."""
    spark = rows.sparkSession
    size, source_size, target, taken = names
    again, at, u, part = fresh([*rows.columns, *names], "again", "at", "u", "part")
    per = _small(spark.createDataFrame(found, _PLAN), len(found)).alias("b")
    both = rows.alias("a").join(per, F.col(f"a.{name}").eqNullSafe(F.col("b.source")))
    edge = F.coalesce((F.col("b.more") > 0) & (F.col(f"a.{hash_}") == F.col("b.edge")), F.lit(False))
    keep = [F.col(f"a.`{c}`") for c in rows.columns if c not in (name, hash_, size)]

    def out(df: DataFrame, times: Column) -> DataFrame:
        return df.select(*keep, F.col(f"a.{size}"), F.col("b.source_size").alias(source_size), F.col("b.target").alias(target), (F.col(f"a.{size}") * (F.col("b.copies") + F.when(times, 1).otherwise(0))).alias(taken))

    below = F.col(f"a.{hash_}") <= F.col("b.threshold")
    if not any(r[-1] for r in found):
        return out(both, below)
    alike = Settled(both.filter(edge).select("a.*").withColumn(u, F.monotonically_increasing_id())).df.withColumn(part, F.shiftright(u, 33))
    sizes = alike.groupBy(name, part).agg(F.count(F.lit(1)).alias(again))
    ahead = sizes.select(F.col(name).alias("ahead_source"), F.col(part).alias("ahead_part"), F.coalesce(F.sum(again).over(W.partitionBy(name).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(again))
    alike = alike.withColumn(at, F.row_number().over(W.partitionBy(name, part).orderBy(u)))
    alike = alike.join(ahead, alike[name].eqNullSafe(ahead["ahead_source"]) & (alike[part] == ahead["ahead_part"]))
    few = alike.alias("a").join(per, F.col(f"a.{name}").eqNullSafe(F.col("b.source")))
    return out(both.filter(~edge), below).unionByName(out(few, F.col(f"a.{at}") + F.col(f"a.{again}") <= F.col("b.more")))


def mix(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, drop_text: bool = False) -> DataFrame:
    """df with size, source_size, target and taken (words that the mix takes) for every row; names get underscores where df has them.

    Texts are read once for the sizes, which are settled in a small table, and not at all by the thresholds.  Without the text
    in the result they aren't read again.
    """
    text, key, source = (F.col(f"`{c}`") for c in (text_col, key_col, source_col))
    kept = [c for c in df.columns if not (drop_text and c == text_col)]
    names = fresh(kept, "size", "source_size", "target", "taken")
    name, hash_ = fresh([*kept, *names], "mix_source", "mix_hash")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], source.cast("string").alias(name), digits(key, text).alias(hash_), words(text).alias(names[0]))
    settled = Settled(rows if drop_text else rows.select(name, hash_, names[0]))
    found = plan(settled.df.select(F.col(name).alias("source"), F.col(hash_).alias("hash"), F.col(names[0]).alias("size")), weights, cap)
    if not drop_text:
        settled.drop()
    return _mixed(settled.df if drop_text else rows, found, names, name, hash_)


def sample(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: each row of df as often as it is taken, with df's columns."""
    mixed = mix(df, text_col, key_col, source_col, weights, cap)
    size, _, _, taken = (F.col(f"`{c}`") for c in mixed.columns[-4:])
    # rows without words cost no budget and are not taken
    times = F.when(size > 0, F.expr("0") + (taken / size)).otherwise(0).cast("int")
    again = fresh(mixed.columns, "again")[0]
    return mixed.withColumn(again, F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in df.columns])


QUERY_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null')), 1, 16) AS hash
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS n,
         [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w
  FROM sized GROUP BY source),
-- the share of a unit of weight rises until no source's target is above its cap
lam AS (
  SELECT 0 AS step, (SELECT sum(n) FROM src)::DOUBLE / (SELECT sum(w) FROM src) AS share
  UNION ALL
  SELECT step + 1, (SELECT sum(n) - sum(CASE WHEN lam.share * w >= 3 * n THEN 3 * n ELSE 0 END) FROM src)::DOUBLE
         / (SELECT sum(CASE WHEN lam.share * w >= 3 * n THEN 0 ELSE w END) FROM src)
  FROM lam WHERE step < 40),
goal AS (
  SELECT source, n, CASE WHEN share * w >= 3 * n THEN (3 * n)::DOUBLE ELSE share * w END AS target
  FROM src, (SELECT share FROM lam ORDER BY step DESC LIMIT 1)),
part AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE floor(target / n)::BIGINT END AS copies FROM goal),
run AS (
  SELECT s.doc_id, s.size, p.n, p.target, p.copies, floor(p.target - p.copies * p.n)::BIGINT AS budget,
         -- rows that agree in key and text are alike, and as many as fit are taken
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN part p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, n AS source_size, round(target, 4) AS target,
       size * (copies + CASE WHEN budget > 0 AND upto <= budget THEN 1 ELSE 0 END) AS taken
FROM run
"""
