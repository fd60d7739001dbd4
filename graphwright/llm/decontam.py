"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

Records are the windows of the benchmark items (``WINDOW`` consecutive words; a shorter item is one
window), read as sets of shingles.  The join asks for containment 1 of such a window in an item-sized
window of a document.  By the prefix-filter bound, |w| - ceil(1 * |w|) + 1 = 1 shingle of each window is
a necessary prefix under any global order, and the order by rarity makes it the shingle that fewest
document positions have.  So: (1) one pass counts the items' shingles over all documents, (2) each
window keeps its rarest shingle, and (3) a second pass finds the prefixes in the documents.  A hit
fixes where the window would have to lie (positional bound), the document must be long enough on both
sides (length bound), and what is left is verified word by word over that window.

The items are the stated query set, taken in blocks of about ``BLOCK`` bytes of text: each block's index is
bounded (arrays of some 40 bytes a word) and sent to the executors, and each costs two passes over the
documents.  Documents are never shuffled, so skew in sources or copies doesn't matter, and each row is judged
by itself; rows of a shingle that is common in documents and items are looked up a bounded number at a time.

Words are compared by 64-bit hashes, all words of a window at once.  Null and empty texts have no words;
null or empty items have no windows.  Repeated rows are judged alike; items with the same id count once, and an
item without an id counts for hits but not as an item.  Of equally rare shingles (ties) the smallest hash is the
prefix.  Whole texts are read, however long.  Empty tables give no rows or no hits.  Only the named columns are
read; other columns pass through, whatever their names, and new ones get underscores where they clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwright.llm.words import ALNUM, LOWER, Piece, among, cover, fresh, mix, pieces, rolling

#: Words in a window, and in the shingles that the prefix is taken from.
WINDOW, SHINGLE = 13, 4
#: Bytes of item text that are indexed at a time.
BLOCK = 4 << 20
#: Places that are compared at a time.
COMPARED = 1 << 17
#: A document is contaminated if at least one in so many words is hit.
ONE_IN = 20

_HITS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())]))
_IDS = T.ArrayType(T.StringType())


def _words(texts: pa.Array) -> Piece:
    return Piece(texts, ALNUM, LOWER)


class Windows:
    """The distinct windows of some items: all items' words, where each window begins, its length, and its owners."""

    def __init__(self, ids: list[str], texts: pa.Array):
        p = _words(texts)
        self.ids, self.words = ids, p.hash
        size = np.minimum(p.counts, WINDOW)
        many = np.where(size > 0, p.counts - size + 1, 0)
        item = np.repeat(np.arange(p.n, dtype=np.int32), many)
        start = (p.first[item] + np.arange(len(item)) - (np.cumsum(many) - many)[item]).astype(np.int32)
        length = size[item].astype(np.int32)
        whole = np.zeros(len(item), np.uint64)
        for n in np.unique(length):
            own = length == n
            whole[own] = mix(rolling(self.words, n)[start[own]])
        order = np.lexsort((start, whole, length))
        item, start, length, whole = item[order], start[order], length[order], whole[order]
        new = np.append(True, (whole[1:] != whole[:-1]) | (length[1:] != length[:-1]))[: len(item)]
        for n in np.unique(length):
            again = np.flatnonzero(~new & (length == n))
            for i in range(0, len(again), COMPARED):  # equal hashes, other words
                at = again[i : i + COMPARED]
                new[at] = (self.take(start[at], n) != self.take(start[at - 1], n)).any(axis=1)
        self.start, self.length = start[new], length[new]
        named = np.array([x is not None for x in ids], bool)
        pair = np.unique((np.cumsum(new) - 1)[named[item]].astype(np.int64) << 32 | item[named[item]])
        self.owner = (pair & 0xFFFFFFFF).astype(np.int32)
        self.owners = np.searchsorted(pair >> 32, np.arange(len(self.start) + 1)).astype(np.int32)

    def take(self, start: np.ndarray, n: int) -> np.ndarray:
        """The words of windows of length n."""
        return self.words[start[:, None] + np.arange(n)]

    def shingles(self) -> dict[int, np.ndarray]:
        """By shingle length, the sorted shingles of all windows; a window shorter than SHINGLE is one shingle."""
        found: dict[int, list[np.ndarray]] = {}
        for n in np.unique(self.length):
            s = min(SHINGLE, int(n))
            gram, start = mix(rolling(self.words, s)), self.start[self.length == n]
            found.setdefault(s, []).extend(np.unique(gram[start + j]) for j in range(n - s + 1))
        return {s: np.unique(np.concatenate(x)) for s, x in found.items()}


class Prefixes:
    """Each window's rarest shingle; how to look it up."""

    def __init__(self, windows: Windows, wanted: dict[int, np.ndarray], counts: dict[int, np.ndarray]):
        self.windows = windows
        self.tables = {}
        rows: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for n in np.unique(windows.length):
            s = min(SHINGLE, int(n))
            own = np.flatnonzero(windows.length == n).astype(np.int32)
            gram, start = mix(rolling(windows.words, s)), windows.start[own]
            token, offset, rare = gram[start], np.zeros(len(own), np.int32), counts[s][np.searchsorted(wanted[s], gram[start])]
            for j in range(1, n - s + 1):
                t = gram[start + j]
                c = counts[s][np.searchsorted(wanted[s], t)]
                better = (c < rare) | ((c == rare) & (t < token))
                token[better], rare[better], offset[better] = t[better], c[better], j
            there = rare > 0  # else no document has the window
            rows.setdefault(s, []).append((token[there], offset[there], own[there]))
        for s, found in rows.items():
            token, offset, k = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((k, offset, token))
            token, offset, k = token[order], offset[order], k[order]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
            self.tables[s] = (token[first], first, np.diff(np.append(first, len(token))), offset, k)

    def find(self, p: Piece) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence in the piece's documents."""
        starts, found = [], []
        for s, (token, first, many, offsets, windows) in self.tables.items():
            if len(p.hash) < s or not len(token):
                continue
            gram = mix(rolling(p.hash, s))
            places = among(gram, token)
            which = np.searchsorted(token, gram[places])
            total = np.cumsum(many[which])
            low = 0
            while low < len(places):
                high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + COMPARED, "right")))
                at, t = places[low:high], which[low:high]
                low = high
                row = np.repeat(first[t] - np.cumsum(many[t]) + many[t], many[t])
                at = np.repeat(at, many[t])
                row = row + np.arange(len(row))
                k, start = windows[row], at - offsets[row]
                length, doc = self.windows.length[k], p.doc[at]
                fits = (start >= p.first[doc]) & (start + length <= p.first[doc + 1])  # positional and length bounds
                k, start, length = k[fits], start[fits], length[fits]
                for n in np.unique(length):
                    a, b = k[length == n], start[length == n]
                    for i in range(0, len(a), COMPARED):
                        c, d = a[i : i + COMPARED], b[i : i + COMPARED]
                        same = (self.windows.take(self.windows.start[c], n) == p.hash[d[:, None] + np.arange(n)]).all(axis=1)
                        starts.append(d[same])
                        found.append(c[same])
        return np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.int32)])

    def hits(self, p: Piece) -> tuple[dict[int, list[dict]], dict[int, set[str]]]:
        """By document with occurrences, the ranges of words inside them, and the items."""
        w = self.windows
        start, k = self.find(p)
        inside = cover(start, w.length[k], len(p.doc))
        edge = inside & ~np.append(False, inside[:-1]) | inside & np.append(True, p.doc[1:] != p.doc[:-1])[: len(inside)]
        first = np.flatnonzero(edge)
        run = np.cumsum(edge) - 1
        size = np.bincount(run[inside], minlength=len(first))
        ranges: dict[int, list[dict]] = {}
        for a, n in zip(first.tolist(), size.tolist(), strict=True):
            d = int(p.doc[a])
            ranges.setdefault(d, []).append({"at": a - int(p.first[d]), "n": n})
        pair = np.unique(p.doc[start] << 32 | k)
        doc, k = pair >> 32, pair & 0xFFFFFFFF
        many = w.owners[k + 1] - w.owners[k]
        ids: dict[int, set[str]] = {d: set() for d in ranges}
        at = np.repeat(w.owners[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pair = np.unique(np.repeat(doc, many) << 32 | w.owner[at])
        for d, i in zip((pair >> 32).tolist(), (pair & 0xFFFFFFFF).tolist(), strict=True):
            ids[d].add(w.ids[i])
        return ranges, ids


def _rarity(docs: DataFrame, text_col: str, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How many document positions have each of the items' shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(x), np.int64) for n, x in shared.value.items()}
        for b in pieces(batches, text_col):
            p = _words(b.column(text_col))
            for n, x in shared.value.items():
                if len(p.hash) >= n:
                    at, gram = p.grams(n)
                    hit = among(gram, x)
                    total[n] += np.bincount(np.searchsorted(x, gram[hit]), minlength=len(x))
        for n, x in total.items():
            k = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, np.int32)), pa.array(k.astype(np.int32)), pa.array(x[k])], names=["n", "k", "c"])

    out = {n: np.zeros(len(x), np.int64) for n, x in wanted.items()}
    if out:
        rows = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "n int, k int, c long").groupBy("n", "k").agg(F.sum("c").alias("c")).toArrow()
        n, k, c = (rows.column(x).to_numpy() for x in "nkc")  # no more rows than the block has shingles
        for s, x in out.items():
            x[k[n == s]] = c[n == s]
    shared.destroy()
    return out


def occurrences(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", finish=None, final: T.StructType | None = None) -> DataFrame:
    """docs with three more columns at the end: n_words, hits (ranges of words) and items (ids of items with occurring windows).

    Their names get underscores where docs has such columns.  finish turns the last pass's batches into rows of final.
    """
    names = fresh(docs.columns, "n_words", "hits", "items")
    items = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BLOCK))
    source = docs
    out = docs.select("*", *(x.alias(n) for n, x in zip(names, (F.lit(None).cast("long"), F.array().cast(_HITS), F.array().cast(_IDS)), strict=True)))
    schema = out.schema
    for block in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == block).toArrow().combine_chunks()
        windows = Windows(part.column("id").to_pylist(), pa.concat_arrays(part.column("text").chunks or [pa.array([], pa.string())]))
        wanted = windows.shingles()
        index = docs.sparkSession.sparkContext.broadcast(Prefixes(windows, wanted, _rarity(source, text_col, wanted)))

        last = finish if block == n_blocks - 1 else None

        def run(batches: Iterator[pa.RecordBatch], index=index, last=last) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, text_col):
                p = _words(b.column(text_col))
                ranges, own = index.value.hits(p)
                hits, ids = (c.to_pylist() for c in b.columns[-2:])
                for d, x in ranges.items():
                    hits[d] = (hits[d] or []) + x
                    ids[d] = sorted({*(ids[d] or []), *own[d]})
                added = [pa.array(x, b.schema.field(i - 3).type) for i, x in enumerate((p.counts, hits, ids))]
                found = pa.RecordBatch.from_arrays([*b.columns[:-3], *added], schema=b.schema)
                yield last(found) if last else found

        out = out.mapInArrow(run, final if last else schema)
    return out


def _judged(b: pa.RecordBatch) -> tuple[list[int], list[int], list[bool]]:
    """Words, hit words and verdicts of a batch of occurrences()."""
    n, hit = b.columns[-3].to_pylist(), []
    for size, x in zip(n, b.columns[-2].to_pylist(), strict=True):
        hit.append(int(cover(np.array([r["at"] for r in x]), np.array([r["n"] for r in x]), size).sum()) if x else 0)
    return n, hit, [h > 0 and ONE_IN * h >= s for h, s in zip(hit, n, strict=True)]


def verdicts(docs: DataFrame, items: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", **names: str) -> DataFrame:
    """One row per document: the keys, n_words, n_hit, n_items, items_sha256 and contaminated."""
    small = docs.select(*dict.fromkeys([*keys, text_col]))
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")] + [T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])

    def finish(b: pa.RecordBatch) -> pa.RecordBatch:
        n, hit, bad = _judged(b)
        ids = b.columns[-1].to_pylist()
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in ids]
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_())], names=schema.names)

    return occurrences(small, items, text_col, finish=finish, final=schema, **names)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **names: str) -> DataFrame:
    """The documents that are not contaminated, with their columns."""

    def finish(b: pa.RecordBatch) -> pa.RecordBatch:
        kept = b.filter(pa.array([not x for x in _judged(b)[2]], pa.bool_()))
        return pa.RecordBatch.from_arrays(kept.columns[:-3], names=kept.schema.names[:-3])

    return occurrences(docs, items, text_col, finish=finish, final=docs.schema, **names)


QUERY_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
spots AS (
  SELECT row_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM sized))),
found AS (SELECT row_id, item_id, i, n FROM spots JOIN windows USING (n, s)),
hit AS (
  SELECT row_id, count(DISTINCT p) AS n_hit
  FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT row_id, i, n FROM found)) GROUP BY row_id),
ids AS (
  SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS joined
  FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (row_id) LEFT JOIN ids USING (row_id)
"""
