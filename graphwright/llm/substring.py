"""Substring deduplication by seed and extend.

A window is ``WINDOW`` consecutive words of a document; one whose words start anywhere else too is a repeat, and every
word inside a repeat is removed.  Overlapping repeats join to maximal repeats over the threshold, which are an output too.

*Seeds.*  Of the ``WINDOW - ANCHOR + 1`` n-grams of ``ANCHOR`` words in a window, the leftmost smallest hash is selected
(winnowing).  The choice depends on the window's words alone, so equal windows have equal anchors at equal offsets, and
each window belongs to exactly one anchor.  The neighbouring windows of one anchor form its span: all words to which
the anchor may have to be extended, left and right.

*Join.*  Anchors are joined with anchors by hash, never with each other's occurrences in pairs: rows are counted by
(anchor, span), with partial counts before the shuffle.  A span that occurs twice matches to both its ends, and all
its windows are repeats.

*Extend.*  What is left are anchors that occur again, but in different spans: there a match ends inside the span.
One text with each such span lists its windows, the anchor extended to the left and right by every split of the
remaining words, and windows that two spans share are repeats.  So the work is linear in the occurrences, however many
share an anchor; the join back to occurrences has one row on the other side and is split by adaptive execution.
Extending pairs of occurrences word by word gives the same windows, but there are as many pairs as the square of a group.

Texts are compared by hashes: spans by 128 bits (their own and their anchor's), windows by 128 bits (a polynomial and a
sum).  Rows are known by a hash of their text (equal texts fare equally), which stays the same if a lost executor's scan
is repeated under other splits.  Null and empty texts, and texts of fewer words than a window, lose nothing.  Whole texts
are read, however long; a task holds one at a time.  Repeated rows are repeats of each other.  Empty tables give no rows.
Only the named columns are read, so extra ones don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwright.llm.words import SPACED, Piece, Sums, cover, mix, pieces
from graphwright.plans.scratch import Settled

#: Words in a window, and in the n-grams from which its anchor is selected.
WINDOW, ANCHOR = 35, 8


def anchors(p: Piece, sums: Sums, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, span hash, first window and number of windows of each anchor occurrence."""
    none = np.zeros(0, np.uint64)
    if len(p.hash) < window:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    gram = sums.gram
    best, width, choose = np.arange(len(gram)), 1, window - anchor + 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(gram[b] < gram[a], b, a)  # the left one of equals

    while 2 * width <= choose:
        best = better(best[:-width], best[width:])
        width *= 2
    if width < choose:
        best = better(best[: len(best) - (choose - width)], best[choose - width :])
    start = np.flatnonzero(p.doc[: len(p.doc) - window + 1] == p.doc[window - 1 :])
    owner = best[start]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))) if len(start) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(start)))
    low, owner = start[new], owner[new]
    span = mix(sums.of(low, count + window - 1) + mix((owner - low).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)))
    return gram[owner], span, low, count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to a row per anchor occurrence."""
    for b in pieces(batches, "text"):
        p = Piece(b.column("text"), SPACED)
        anchor, span, low, count = anchors(p, Sums(p.hash, ANCHOR))
        doc = p.doc[low]
        yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(span), b.column("key").take(pa.array(doc)), pa.array((low - p.first[doc]).astype(np.int32)), pa.array(count.astype(np.int32))], names=["anchor", "span", "key", "low", "n"])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, spans to extend) to a row per window of those spans; a task extends one of several equal texts."""
    seen: set[int] = set()
    for batch in batches:
        first = [k not in seen and not seen.add(k) for k in batch.column("key").to_pylist()]
        for b in pieces(iter([batch.filter(pa.array(first, pa.bool_()))]), "text"):
            p = Piece(b.column("text"), SPACED)
            spans = b.column("spans")
            doc = np.repeat(np.arange(p.n), pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False))
            flat = pa.compute.list_flatten(spans)
            low, n = (pa.compute.struct_field(flat, f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("low", "n"))
            once = pa.compute.struct_field(flat, "once").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(low)), n)
            low = low[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
            start = low + p.first[doc[row]]
            total = np.concatenate([[np.uint64(0)], np.cumsum(p.hash, dtype=np.uint64)])
            window, check = Sums(p.hash, ANCHOR).of(start, WINDOW), total[start + WINDOW] - total[start]
            yield pa.RecordBatch.from_arrays([_signed(window), _signed(check), b.column("key").take(pa.array(doc[row])), pa.array(low.astype(np.int32)), pa.array(once[row].astype(bool))], names=["window", "check", "key", "low", "once"])


def repeats(docs: DataFrame) -> Settled:
    """From docs(key, text, ...): the settled table (key, ranges), ranges of windows that are repeats."""
    seeds = Settled(docs.select("key", "text").filter("text is not null").mapInArrow(_seeds, "anchor long, span long, key long, low int, n int"))
    spans = seeds.df.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("first"))
    shared = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    # a span that occurs twice is a repeat; one that shares its anchor with another kind of span is to be extended
    known = spans.join(shared.select("anchor", "kinds"), "anchor", "left").filter("c > 1 or kinds > 1").select("anchor", "span", (F.col("c") > 1).alias("whole"), F.col("kinds").isNotNull().alias("mixed"), "first")
    # the text with the smallest key extends a span for all that have it
    found = Settled(seeds.df.join(known, ["anchor", "span"]).select("key", "low", "n", "whole", (F.col("mixed") & (F.col("first") == F.col("key"))).alias("extend")))
    seeds.drop()
    # rows with equal texts have equal spans, which are listed once
    # settled, so that the join has the dealt rows alone on its sides and the partition of many copies can be split
    todo = Settled(found.df.filter("extend").groupBy("key").agg(F.collect_set(F.struct("low", "n", (~F.col("whole")).alias("once"))).alias("spans")))
    windows = docs.join(todo.df, "key").select("key", "text", "spans").mapInArrow(_extended, "window long, check long, key long, low int, once boolean")
    windows = Settled(windows.distinct())
    todo.drop()
    twice = windows.df.groupBy("window", "check").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("window", "check")
    extended = windows.df.filter("once").join(twice, ["window", "check"]).select("key", "low", F.lit(1).alias("n"))
    ranges = found.df.filter("whole").select("key", "low", "n").unionByName(extended)
    out = Settled(ranges.groupBy("key").agg(F.collect_set(F.struct("low", "n")).alias("ranges")))
    found.drop()
    windows.drop()
    return out


def _flags(p: Piece, ranges: pa.Array) -> np.ndarray:
    """Which words of the piece are inside repeats."""
    doc = np.repeat(np.arange(p.n), pa.compute.list_value_length(ranges).fill_null(0).to_numpy(zero_copy_only=False))
    flat = pa.compute.list_flatten(ranges)
    low, n = (pa.compute.struct_field(flat, f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("low", "n"))
    return cover(low + p.first[doc], n + WINDOW - 1, len(p.doc))


def kept_text(p: Piece, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of the kept words of all texts, joined by one space in each, and the texts' offsets in it."""
    words = np.flatnonzero(~gone)
    inner = words[:-1][p.doc[words[:-1]] == p.doc[words[1:]]]  # kept words that another one follows
    edge = np.zeros(len(p.bytes) + 1, np.int8)
    edge[p.start[words]] += 1
    edge[p.end[words]] -= 1
    keep = np.cumsum(edge[:-1]).astype(bool)
    out = p.bytes.copy()
    out[p.end[inner]] = 0x20
    keep[p.end[inner]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[p.at]


def maximal(p: Piece, gone: np.ndarray) -> pa.Array:
    """The maximal repeats of each text, (first word, words)."""
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    inner = p.first[1:-1][(p.first[1:-1] > 0) & (p.first[1:-1] < len(gone))]
    inner = np.unique(inner[gone[inner] & gone[inner - 1]])  # texts meet inside a run
    first = np.sort(np.concatenate([np.flatnonzero(edge > 0), inner]))
    last = np.sort(np.concatenate([np.flatnonzero(edge < 0), inner]))
    rows = pa.StructArray.from_arrays([pa.array(first - p.first[p.doc[first]]), pa.array(last - first)], names=["first", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, p.first).astype(np.int32)), rows)


_REPEATS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("n", T.LongType())]))


def dedup(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",), texts: bool = False) -> DataFrame:
    """One row per row of docs: the keys, n_words, n_removed, kept_sha256, and with texts the kept words as kept_text and the maximal repeats."""
    text = F.col(f"`{text_col}`")
    small = docs.select(*[F.col(f"`{k}`").alias(f"id{i}") for i, k in enumerate(keys)], F.xxhash64(text).alias("key"), text.alias("text"))
    ranges = repeats(small)
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept_text", T.StringType()), T.StructField("repeats", _REPEATS)] * texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            p = Piece(b.column("text"), SPACED, hashed=False)
            gone = _flags(p, b.column("ranges"))
            data, at = kept_text(p, gone)
            data = data.tobytes()
            parts = [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            columns = [*(b.column(f"id{i}") for i in range(len(keys))), pa.array(p.counts.astype(np.int64)), pa.array(p.per_doc(gone).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([x.decode() for x in parts], pa.string()), maximal(p, gone)][: 2 * texts], names=schema.names)

    return small.join(ranges.df, "key", "left").mapInArrow(run, schema)


QUERY_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (
  SELECT row_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS s
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs)),
twice AS (SELECT s FROM spots GROUP BY s HAVING count(*) > 1),
gone AS (
  SELECT row_id, list(DISTINCT p) AS p
  FROM (SELECT row_id, unnest(range(i, i + 35)) AS p FROM spots JOIN twice USING (s)) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN gone USING (row_id)
"""
