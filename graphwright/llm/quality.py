"""Quality rules by repetition coverage.

For each text, rolling hashes of several n-gram lengths mark the n-grams that the text already had,
and the share of its word characters that lie inside them is measured; the same is done for lines.
The shares are held against limits that fall with the n-gram's length.  One pass, no shuffle: a row
needs nothing but its own text, so skewed sources or groups of copies don't matter.

Null and empty texts have no words and fail the base rule.  Texts are used whole.  Repeated rows
are judged alike.  An empty table gives an empty table.  Only the named columns are read, so any
other columns, whatever their names, pass through or are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphwright.llm.words import SPACED, Piece, byte_class, cover, mix, pieces, rolling, same_in_doc

#: Largest share of word characters inside n-grams that the text had before, by n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters in lines that the text had before.  Lines are not merely counted:
#: one short line that opens and closes a text of three lines says nothing about it.
LINE_CHARS_LIMIT = 0.20
#: Base rule: fewest words, and the largest percentage of words in repeated windows of five.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

_SYMBOL = byte_class(lambda b: chr(b) in "#*$%&|<>")

REPORT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.DoubleType()) for n in ("dup_ngram_share", "dup_line_chars_share")]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The report's columns for an array of texts."""
    p = Piece(texts, SPACED)
    code_points = np.concatenate([[0], np.cumsum((p.bytes & 0xC0) != 0x80)])
    chars = code_points[p.end] - code_points[p.start]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[p.bytes])])
    out = {"n_words": p.counts, "word_chars": p.per_doc(chars), "n_symbols": symbols[p.at[1:]] - symbols[p.at[:-1]]}

    # lines: they begin at a text's start and after each line feed
    breaks = np.flatnonzero(p.bytes == 0x0A)
    begin = np.concatenate([p.at[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(p.n), np.searchsorted(p.at, breaks, "right") - 1])
    order = np.lexsort((begin, line_doc))
    begin, line_doc = begin[order], line_doc[order]
    stop = p.at[line_doc + 1]
    inner = np.flatnonzero(line_doc[1:] == line_doc[:-1])
    stop[inner] = begin[inner + 1] - 1
    w0, w1 = np.searchsorted(p.start, begin), np.searchsorted(p.start, stop)
    full = w1 > w0
    begin, stop, line_doc, w0, w1 = begin[full], stop[full], line_doc[full], w0[full], w1[full]
    _, dup_line = same_in_doc(line_doc, p.spans(begin, stop))
    out["n_dup_lines"] = np.bincount(line_doc, dup_line, p.n).astype(np.int64)
    words_to = np.concatenate([[0], np.cumsum(chars)])
    line_chars = np.bincount(line_doc, (words_to[w1] - words_to[w0]) * dup_line, p.n)

    total = np.maximum(out["word_chars"], 1)
    out["n_repeat_words"] = np.zeros(p.n, np.int64)
    worst, failed = np.zeros(p.n), np.zeros(p.n, bool)
    window = rolling(p.hash, min(NGRAM_LIMITS)) if len(p.hash) >= min(NGRAM_LIMITS) else None
    for n, limit in NGRAM_LIMITS.items():
        if len(p.hash) < n:
            break
        if n > min(NGRAM_LIMITS):  # the hash of n words from that of n - 1
            window = window[:-1] * np.uint64(0xD6E8FEB86659FD93) + p.hash[n - 1 :]
        at = np.flatnonzero(p.doc[: len(p.doc) - n + 1] == p.doc[n - 1 :])
        again, later = same_in_doc(p.doc[at], mix(window[at]))
        if n == 5:
            out["n_repeat_words"] = p.per_doc(cover(at[again], n, len(p.doc)))
        share = p.per_doc(chars * cover(at[later], n, len(p.doc))) / total
        worst = np.maximum(worst, share)
        failed |= share > limit
    out |= {"dup_ngram_share": worst, "dup_line_chars_share": line_chars / total}
    failed |= out["dup_line_chars_share"] > LINE_CHARS_LIMIT
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~(out["base_failed"] | failed)
    return out


def report(df: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of df: the keys, then REPORT."""
    kept = list(dict.fromkeys([*keys, text_col]))
    schema = T.StructType([df.schema[k] for k in keys] + REPORT.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            found = measure(b.column(text_col))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(found[f.name]) for f in REPORT], names=schema.names)

    return df.select(*kept).mapInArrow(run, schema)


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that the rules keep, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            yield b.filter(pa.array(measure(b.column(text_col))["kept"]))

    return df.mapInArrow(run, df.schema)
