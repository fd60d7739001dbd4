"""Words, rolling hashes and batches in numpy, shared by the text operators.

Texts reach Python as Arrow batches.  A batch is cut into pieces of at most ``PIECE`` bytes
(a longer text is a piece of its own), so that memory follows the piece and not the batch or the
table.  Within a piece everything is computed on the flat UTF-8 bytes of all its texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

#: Bytes of text that are handled at once.
PIECE = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def byte_class(is_word) -> np.ndarray:
    """256 flags, true for bytes that belong to words."""
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words are runs of anything but ASCII white space.
SPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of lower-case letters, digits and everything outside ASCII.
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: Ranges of more bytes are hashed one by one.
LONG = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time for all ranges, mixed after each step; XXH3 for long ranges."""
    size = end - start
    out = mix(size.astype(np.uint64) + _BASE)
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    own, at, left = np.flatnonzero(size <= LONG), start, size
    if len(own) < len(size):
        view = memoryview(np.ascontiguousarray(data))
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(view[start[i] : end[i]])
    at, left = start[own], size[own]
    while len(own):
        more = left > 0
        if not more.all():
            own, at, left = own[more], at[more], left[more]
            if not len(own):
                break
        out[own] = mix(out[own] ^ (eights[at] & _LOW[np.minimum(left, 8)]))
        at, left = at + 8, left - 8
    return out


_powers: dict[str, np.ndarray] = {}


def power(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of a base, modulo 2 ** 64."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, PIECE // 2 + 2)  # words of a piece, of one byte each
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size == PIECE // 2 + 2:
            _powers[key] = have
    return have[:n]


class Piece:
    """The words of some texts.

    ``start``/``end``: byte offsets of each word; ``doc``: the text it is in; ``first[d]`` and
    ``first[d + 1]`` bound the words of text ``d``; ``hash``: 64 bits of each word's (folded) bytes.
    """

    def __init__(self, texts: pa.Array, letters: np.ndarray = SPACED, fold: np.ndarray | None = None, hashed: bool = True):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2] if n else None
        flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.at = offsets - offsets[0]
        self.bytes = fold[flat] if fold is not None else flat
        self.n = n
        inside = letters[self.bytes]
        before, after = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cut = self.at[(self.at > 0) & (self.at < len(flat))]
        before[cut] = False
        after[cut - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)
        if hashed:
            self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        return hash_spans(self.bytes, start, end)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of n words that stay in one text."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        return at, mix(rolling(self.hash, n)[at])

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[self.first[1:]] - sums[self.first[:-1]]


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Polynomials over n neighbouring hashes, at every position (texts are not told apart)."""
    size = len(hashes) - n + 1
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= _STEP
        out += hashes[k : k + size]
    return out


class Sums:
    """Hashes of ranges of words, by running sums of their n-grams' hashes.

    The sums are polynomials; the n-grams are mixed before, so that words which repeat in a pattern don't cancel out.
    """

    def __init__(self, hashes: np.ndarray, n: int):
        self.n = n
        self.gram = mix(rolling(hashes, n)) if len(hashes) >= n else np.zeros(0, np.uint64)
        self.sums = np.zeros(len(self.gram) + 1, np.uint64)
        np.cumsum(self.gram * power(_BASE, len(self.gram)), out=self.sums[1:])
        self.inverse = power(_INVERSE, len(self.gram) + 1)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Of the ranges of length words, n at least, from start on."""
        return mix((self.sums[start + length - self.n + 1] - self.sums[start]) * self.inverse[start])


def cover(at: np.ndarray, length: np.ndarray | int, size: int) -> np.ndarray:
    """Flags of the positions inside any [at, at + length)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches' rows again, at most PIECE bytes of the column (or one row) at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(total, total[row] + PIECE, "right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of the keys that are in the sorted, distinct, mixed wanted; a bitmap spares most searches."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    bits = np.uint64(min(22, max(16, len(wanted).bit_length() + 3)))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    flags = np.zeros(int(mask) + 1, bool)
    flags[wanted & mask] = True
    at = np.flatnonzero(flags[keys & mask])
    place = np.minimum(np.searchsorted(wanted, keys[at]), len(wanted) - 1)
    return at[wanted[place] == keys[at]]


def same_in_doc(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of hashes that some other position of the same text has, and of those that an earlier one has."""
    again, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    key = mix(hashes + mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        at = among(key, twice)
        again[at] = True
        later[at] = True
        later[at[np.unique(key[at], return_index=True)[1]]] = False
    return again, later


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none of them is (but for case) among the columns."""
    have = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out
