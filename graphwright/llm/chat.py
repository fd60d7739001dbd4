"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The prompt is the longest common prefix of turns (role and text equal, nulls equal to nulls), rendered once; what
follows in each conversation is its completion.  A mask says which characters of a completion are trained on: those
of assistant turns, with the mark that ends them, and none of the other turns' or of the marks that open a turn.
Masks are spans (start, length) in code points.

All of it is array expressions on the row that holds the pair.  ``conversations`` gathers turns into rows: one shuffle
of the turns by conversation.  A conversation is one row and its rendered text one cell, so the longest must fit in memory.

Null roles and texts are rendered as empty and compare as themselves.  Null or empty conversations have no turns.
Turns without a conversation's key are a conversation with a null key.  Turns are in order of their numbers, then role
and text; repeated turn rows are repeated turns.  Texts are rendered whole, however long.  Equal conversations have an
empty completion each.  Empty tables give no rows.  Extra columns of pairs pass through ``format_pairs``, and its own
get underscores where they clash; ``conversations`` doesn't read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.words import fresh

#: How a turn is rendered: open, role, mid, text, close.
OPEN, MID, CLOSE = "<|", "|>\n", "<|end|>\n"
#: The role whose turns are trained on.
TRAINED = "assistant"


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(MID), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def common_turns(a: Column, b: Column) -> Column:
    """The length of the longest common prefix of two arrays of turns."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(n).cast("int")


def after(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def mask(turns: Column) -> Column:
    """Spans (start, length) of the rendered turns that are trained on."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        size = F.length(render(t)).cast("long")
        head = F.length(F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MID))).cast("long")
        span = F.array(F.struct((a["at"] + head).alias("start"), (size - head).alias("length")))
        trained = t["role"].eqNullSafe(F.lit(TRAINED))
        return F.struct((a["at"] + size).alias("at"), F.when(trained, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its key and turns, an array of (turn, role, text)."""
    row = F.struct(F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    return turns.groupBy(F.col(f"`{key}`").alias(key)).agg(F.sort_array(F.collect_list(row)).alias("turns"))


#: What format_pairs adds.
ADDED = ["n_common", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask"]


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with the ADDED columns at the end instead of the two arrays; names get underscores where pairs has them."""
    none = F.array().cast(pairs.schema[chosen].dataType)
    kept = [c for c in pairs.columns if c not in (chosen, rejected)]
    names = fresh(kept, *ADDED)
    common = fresh(pairs.columns, "n")[0]
    a, b, n = F.coalesce(F.col(f"`{chosen}`"), none), F.coalesce(F.col(f"`{rejected}`"), none), F.col(common)
    made = [n, rendered(F.slice(a, 1, n)), *[x for turns in (after(a, n), after(b, n)) for x in (rendered(turns), mask(turns))]]
    out = pairs.withColumn(common, common_turns(a, b))
    return out.select(*[F.col(f"`{c}`") for c in kept], *[x.alias(name) for x, name in zip(made, names, strict=True)])


def replayed(talks: DataFrame, key: str = "conv_id") -> DataFrame:
    """Preference pairs from conversations: chosen as it is, rejected with an earlier reply instead of the last one.

    The last assistant turn is exchanged for the first assistant turn of the conversation that reads differently, or
    emptied where there is none.  Conversations without an assistant turn are their own rejected.
    """
    turns = F.col("turns")
    last = F.aggregate(F.transform(turns, lambda t, i: F.when(t["role"].eqNullSafe(F.lit(TRAINED)), i)), F.lit(-1), lambda a, i: F.greatest(a, F.coalesce(i, F.lit(-1))))
    out = talks.select(F.col(f"`{key}`").alias("key"), "turns").withColumn("last", last)
    reply = F.get(turns, F.col("last"))["text"]
    other = F.get(F.filter(turns, lambda t: t["role"].eqNullSafe(F.lit(TRAINED)) & ~t["text"].eqNullSafe(reply)), F.lit(0))["text"]
    out = out.withColumn("other", F.coalesce(F.when(F.col("last") >= 0, other), F.lit("")))
    swapped = F.transform(turns, lambda t, i: F.when(i == F.col("last"), F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("other").alias("text"))).otherwise(t))
    return out.select(F.col("key").alias(key), turns.alias("chosen"), swapped.alias("rejected"))


def summary(pairs: DataFrame) -> DataFrame:
    """format_pairs' rows with masks as text (start+length, comma-joined), and the number of trained characters of each side."""
    *kept, n, prompt, chosen, chosen_mask, rejected, rejected_mask = pairs.columns
    trained = fresh(pairs.columns, "chosen_trained", "rejected_trained")

    def joined(m: str) -> Column:
        return F.array_join(F.transform(F.col(f"`{m}`"), lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string"))), ",").alias(m)

    def total(m: str, name: str) -> Column:
        return F.aggregate(F.col(f"`{m}`"), F.lit(0).cast("long"), lambda a, s: a + s["length"]).alias(name)

    plain = [F.col(f"`{c}`") for c in (*kept, n, prompt)]
    sides = [F.col(f"`{chosen}`"), joined(chosen_mask), F.col(f"`{rejected}`"), joined(rejected_mask)]
    return pairs.select(*plain, *sides, total(chosen_mask, trained[0]), total(rejected_mask, trained[1]))


QUERY_SQL = r"""
WITH talks AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS a FROM conversations GROUP BY conv_id),
-- 1-based place of the last reply, 0 for none
placed AS (
  SELECT *, coalesce(list_max(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant')), 0) AS last FROM talks),
told AS (
  SELECT *, CASE WHEN last = 0 THEN '' ELSE coalesce(list_filter(a, lambda t: t.role = 'assistant' AND t.text IS DISTINCT FROM a[last].text)[1].text, '') END AS other FROM placed),
pairs AS (
  SELECT conv_id, a, list_transform(a, lambda t, i: CASE WHEN i = last THEN struct_pack(turn := t.turn, role := t.role, text := other) ELSE t END) AS b FROM told),
cut AS (
  SELECT *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i].role IS DISTINCT FROM b[i].role OR a[i].text IS DISTINCT FROM b[i].text)) - 1, len(a)) AS n FROM pairs),
sides AS (
  SELECT *, list_transform(a, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)) AS ra,
         list_transform(b, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)) AS rb FROM cut),
spans AS (
  SELECT *,
    list_transform(list_filter(range(n + 1, len(a) + 1), lambda i: a[i].role = 'assistant'), lambda i:
      struct_pack(s := list_sum(list_concat([0], list_transform(range(n + 1, i), lambda j: length(ra[j])))) + 4 + 1 + length(a[i].role), l := length(ra[i]) - 5 - length(a[i].role))) AS ma,
    list_transform(list_filter(range(n + 1, len(b) + 1), lambda i: b[i].role = 'assistant'), lambda i:
      struct_pack(s := list_sum(list_concat([0], list_transform(range(n + 1, i), lambda j: length(rb[j])))) + 4 + 1 + length(b[i].role), l := length(rb[i]) - 5 - length(b[i].role))) AS mb
  FROM sides)
SELECT conv_id, n::INT AS n_common, array_to_string(ra[1 : n], '') AS prompt,
       array_to_string(ra[n + 1 :], '') AS chosen_completion,
       array_to_string(list_transform(ma, lambda m: m.s::BIGINT || '+' || m.l::BIGINT), ',') AS chosen_mask,
       array_to_string(rb[n + 1 :], '') AS rejected_completion,
       array_to_string(list_transform(mb, lambda m: m.s::BIGINT || '+' || m.l::BIGINT), ',') AS rejected_mask,
       coalesce(list_sum(list_transform(ma, lambda m: m.l)), 0)::BIGINT AS chosen_trained,
       coalesce(list_sum(list_transform(mb, lambda m: m.l)), 0)::BIGINT AS rejected_trained
FROM spans
"""
