"""Token counts by a unigram model, with dynamic programming shared along a trie.

A vocabulary gives every piece (a byte string) a log probability; a text is cut into pre-tokens, and a pre-token has as
many tokens as its most probable segmentation (the fewest, of equally probable ones).  The forward score of a prefix
doesn't depend on what follows, so the distinct pre-tokens of a batch are inserted in a trie and each node's score is
computed once, level by level for all nodes of a depth at a time: best(node) = max over pieces that end here of
best(ancestor before the piece) + log p(piece).  Terminal nodes store the counts, and documents add them up.

A task remembers the counts of at most ``KEPT`` words besides those of the texts at hand, so that a word that many texts have
is inserted once; when there are more, it forgets the others.

Which pieces end at a node is found by walking up from it along a trie of the reversed pieces; most walks end after
a few bytes, and those that go on are handled together.

The model is a parameter: pieces with scores.  ``read_ranks`` makes one from a public vocabulary file of ranked byte
pieces, with probabilities that fall with the rank (Zipf).  Bytes that are no piece cost ``UNKNOWN`` and one token.

Pre-tokens of more than ``LONG`` bytes (texts without spaces) aren't inserted in the trie, which would have a level for
each byte: they are cut one by one, by the same recurrence along their bytes.  The pieces that end at any of ``STRETCH``
bytes are found for all of them at once, and only the scores of as many bytes as the longest piece has are carried on.

One pass, no shuffle; memory follows a batch of PIECE bytes of text, or a longer text.  Null and empty texts have no
pre-tokens.  Whole texts are counted, pre-tokens of any length too.  Repeated rows count alike.  Equally probable
segmentations count as the one with the fewest tokens.  Empty tables give no rows.  Only the named columns are read, so
extra ones don't matter, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphwright.llm.words import SPACED, Piece, pieces

#: The log probability of a byte that is no piece.
UNKNOWN = -30.0
#: Longer pre-tokens are cut alone, and so many of their bytes at a time.
LONG, STRETCH = 256, 1 << 16
#: Words whose counts a task remembers.
KEPT = 1 << 18


@dataclass
class Model:
    """Pieces with log probabilities, as a trie of the reversed pieces."""

    scores: dict[bytes, float]

    def __post_init__(self):
        self.longest = max(map(len, self.scores), default=1)
        children: dict[tuple[int, int], int] = {}
        score = [-np.inf]
        for piece, s in self.scores.items():
            at = 0
            for byte in reversed(piece):
                nxt = children.get((at, byte))
                if nxt is None:
                    nxt = children[at, byte] = len(score)
                    score.append(-np.inf)
                at = nxt
            score[at] = s
        for byte in range(256):
            if (0, byte) not in children:
                children[0, byte] = len(score)
                score.append(UNKNOWN)
            elif score[children[0, byte]] == -np.inf:
                score[children[0, byte]] = UNKNOWN
        self.score = np.array(score)
        keys = np.array([n << 8 | b for n, b in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(children.values()), np.int64)[order]
        # the first two steps, which every walk takes, by a table
        self.two = np.zeros((256, 256), np.int64)
        one = np.zeros(256, np.int64)
        for (n, b), x in children.items():
            if n == 0:
                one[b] = x
        back = {x: b for b, x in enumerate(one)}
        for (n, b), x in children.items():
            if n in back:
                self.two[back[n], b] = x
        self.one = one

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte to the left; 0 where no piece goes on."""
        key = state << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], 0)


def read_ranks(path: str) -> Model:
    """A model from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    rank = {base64.b64decode(a): int(b) for a, b in rows}
    total = float(np.log(np.sum(1.0 / (np.arange(len(rank)) + 1.0))))
    return Model({p: -float(np.log(r + 1.0)) - total for p, r in rank.items()})


def count_long(word: bytes, model: Model) -> tuple[int, float]:
    """Tokens and log probability of one word, along its bytes."""
    data = np.frombuffer(word, np.uint8).astype(np.int64)
    reach = model.longest
    score, count = [0.0], [0]  # of the ends from base on
    base = 0
    for low in range(0, len(data), STRETCH):
        ends = np.arange(low, min(low + STRETCH, len(data)))
        state, at, found = np.zeros(len(ends), np.int64), ends, []
        for back in range(reach):
            own = at >= back
            if back and not own.all():
                at, state = at[own], state[own]
            state = model.one[data[at]] if back == 0 else model.step(state, data[at - back])
            on = state > 0
            at, state = at[on], state[on]
            if not len(at):
                break
            final = model.score[state] > -np.inf
            found.append((at[final], np.full(final.sum(), back + 1), model.score[state[final]]))
        end, size, value = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        first = np.searchsorted(end[order], np.append(ends, ends[-1] + 1)).tolist()
        size, value = size[order].tolist(), value[order].tolist()
        for i in range(len(ends)):
            top, few, here = -np.inf, 0, low + i + 1 - base
            for k in range(first[i], first[i + 1]):
                j = here - size[k]
                s, c = score[j] + value[k], count[j] + 1
                if s > top or (s == top and c < few):
                    top, few = s, c
            score.append(top)
            count.append(few)
        cut = max(0, len(score) - reach - 1)
        base, score, count = base + cut, score[cut:], count[cut:]
    return count[-1], score[-1]


def count_tokens(words: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and log probabilities of sorted, distinct, nonempty words, and so of the trie that they make."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    length = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    start = np.cumsum(length) - length
    tokens, best = np.zeros(len(words), np.int64), np.zeros(len(words))
    # nodes[d]: of the words that are longer than d, the trie's node at depth d + 1; words are sorted, so a node's are neighbours
    alive = np.arange(len(words))
    node = np.zeros(len(words), np.int64)  # of each word, its node on the level above
    parents: list[np.ndarray] = []  # by level, each node's parent on the level above
    bytes_: list[np.ndarray] = []
    scores, counts = [np.zeros(1)], [np.zeros(1, np.int64)]
    for depth in range(int(length.max())):
        alive = alive[length[alive] > depth]
        byte = flat[start[alive] + depth]
        up = node[alive]
        new = np.append(True, (up[1:] != up[:-1]) | (byte[1:] != byte[:-1]))
        node[alive] = np.cumsum(new) - 1
        parents.append(up[new])
        bytes_.append(byte[new])
        n = len(parents[-1])
        top, few = np.full(n, -np.inf), np.zeros(n, np.int64)
        who, at, state = np.arange(n), np.arange(n), None
        for back in range(depth + 1):
            level = depth - back
            letter = bytes_[level][at]
            if back == 0:
                first, state = letter, model.one[letter]
            elif back == 1:
                state = model.two[first[who], letter]
            else:
                state = model.step(state, letter)
            at = parents[level][at]
            on = state > 0
            if not on.all():
                who, at, state = who[on], at[on], state[on]
            if not len(who):
                break
            end = model.score[state]
            ends = np.flatnonzero(end > -np.inf)
            w = who[ends]
            score, count = scores[level][at[ends]] + end[ends], counts[level][at[ends]] + 1
            better = (score > top[w]) | ((score == top[w]) & (count < few[w]))
            top[w[better]], few[w[better]] = score[better], count[better]
        scores.append(top)
        counts.append(few)
        done = alive[length[alive] == depth + 1]
        tokens[done], best[done] = few[node[done]], top[node[done]]
    return tokens, best


def counts(df: DataFrame, model: Model, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of df: the keys, n_bytes, n_words, n_tokens and the log probability of the segmentation."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_words", "n_tokens")] + [T.StructField("log_prob", T.DoubleType())])

    def counted(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(words)), key=words.__getitem__)
        ranked = [words[i] for i in order]
        short = np.array([len(w) <= LONG for w in ranked], bool)
        tokens, best = np.zeros(len(ranked), np.int64), np.zeros(len(ranked))
        tokens[short], best[short] = count_tokens([w for w in ranked if len(w) <= LONG], shared.value)
        for i in np.flatnonzero(~short):
            tokens[i], best[i] = count_long(ranked[i], shared.value)
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return tokens[back], best[back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_tokens, known_best = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)  # sorted by hash
        for b in pieces(batches, text_col):
            p = Piece(b.column(text_col), SPACED)
            distinct, one, which = np.unique(p.hash, return_index=True, return_inverse=True)
            at = np.searchsorted(known, distinct)
            new = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != distinct) if len(known) else np.arange(len(distinct))
            if len(new):
                tokens, best = counted([p.word(i) for i in one[new]])
                if len(known) + len(new) > KEPT:  # of what is forgotten, this piece's words stay
                    own = np.delete(at, new)
                    known, known_tokens, known_best = known[own], known_tokens[own], known_best[own]
                place = np.searchsorted(known, distinct[new])
                known, known_tokens, known_best = (np.insert(x, place, y) for x, y in ((known, distinct[new]), (known_tokens, tokens), (known_best, best)))
                at = np.searchsorted(known, distinct)
            per = at[which]
            sums = [np.bincount(p.doc, x[per], p.n) if len(per) else np.zeros(p.n) for x in (known_tokens, known_best)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(np.diff(p.at)), pa.array(p.counts.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1])], names=schema.names)

    return df.select(*dict.fromkeys([*keys, text_col])).mapInArrow(run, schema)
