"""LM scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background (all documents), score every document: the mean over
its tokens of the target's loss less the background's.  Low scores read like the target.

The models are matched: they share one vocabulary, all words of all documents, and both are smoothed in proportion to
their own size.  p(w | v) = ORDER * count(v w) / count(v) + (1 - ORDER) * (count(w) + SMOOTH * N / V) / (N * (1 + SMOOTH)),
without the first term where v wasn't seen.  V is the number of words and two marks, of a text's begin and of the rest.

All counts are over all documents and whole texts, and exact for every word and bigram (by 64-bit hashes).  Documents are
dealt to chunks by a hash of id and text.  A chunk counts its distinct words, contexts and bigrams and asks for them:
packed rows, dealt by key, so that a bigram that all texts have comes once from each chunk.  A part adds up its keys' counts
and answers each chunk that has any of them; the answers are settled, and a chunk scores its documents with them.  The number
of chunks and parts grows with the texts, and the rows between them with the keys.  Of the models only their sizes reach the
driver; nothing is broadcast.  Target documents are known by a join of ids alone.  A vocabulary of the most
frequent words and hash slots for bigrams can be given instead; words outside the vocabulary are the rest then.

Words are runs of letters (ASCII lower-cased), digits and non-ASCII characters.  Texts without words (or null) have no
scores.  Whole texts count, however long; one longer than a chunk is in it with others, or alone.  Repeated rows count as
often as they are there and have the same scores (no ties are broken anywhere).  Rows without an id are background.  An empty
target gives a target model that is uniform; empty tables give no rows.  Only the named columns are read, so extra ones don't
matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwright.llm.words import ALNUM, LOWER, Piece, among, mix, pieces
from graphwright.plans.scratch import Settled

#: Bytes of text in a chunk, on average.
CHUNK = 8 << 20
#: Weight of the bigram term, and the smoothing mass as a share of the model's size.
ORDER, SMOOTH = 0.6, 0.05
#: Distinct words that a task holds before it passes their counts on.
HELD = 400_000


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (word, n), partial sums."""
    word, count, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        w, back = np.unique(np.concatenate([word, *waiting]), return_inverse=True)
        return w, np.bincount(back, np.concatenate([count, *(np.ones(len(x)) for x in waiting)]), len(w)).astype(np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], names=["word", "n"])

    for b in pieces(batches, "text"):
        waiting.append(Piece(b.column("text"), ALNUM, LOWER).hash)
        size += len(waiting[-1])
        if size > 2 * HELD:
            (word, count), waiting, size = merged(), [], 0
            if len(word) > HELD:
                yield rows()
                word, count = word[:0], count[:0]
    word, count = merged()
    yield rows()


class Bigrams:
    """Ids and keys of the words and bigrams in texts; ids are words' hashes, or places in a vocabulary (sorted word hashes)."""

    def __init__(self, vocabulary: np.ndarray | None = None, slots: int | None = None):
        self.vocabulary, self.slots = vocabulary, slots
        if vocabulary is not None:
            self.rest, self.begin = len(vocabulary), len(vocabulary) + 1
            self.size = len(vocabulary) + 2

    def of(self, p: Piece) -> list[np.ndarray]:
        """Of each word, the keys of itself, of the word before it as a context, and of the bigram; only words' keys are odd."""
        if self.vocabulary is None:
            ids, begin = p.hash, np.uint64(0)
        else:
            ids, begin = np.full(len(p.hash), self.rest, np.uint64), np.uint64(self.begin)
            at = among(p.hash, self.vocabulary)
            ids[at] = np.searchsorted(self.vocabulary, p.hash[at])
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[p.first[:-1][p.counts > 0]] = begin
        pair = mix(mix(before) + ids) if self.vocabulary is None else mix(before * np.uint64(self.size) + ids)
        if self.slots is not None:
            pair &= np.uint64(self.slots - 1)
        even = ~np.uint64(1)
        return [mix(ids + np.uint64(1)) | np.uint64(1), mix(mix(before) + np.uint64(2)) & even, mix(pair + np.uint64(3)) & even]


class Chunk:
    """Words per text, the distinct keys of a chunk's words, contexts and bigrams, in order of parts, and where each word's are."""

    def __init__(self, texts: pa.ChunkedArray, bigrams: Bigrams, parts: int):
        counts, keys = [], [[], [], []]
        for b in pieces(iter(pa.table({"text": texts}).to_batches()), "text"):
            p = Piece(b.column("text"), ALNUM, LOWER)
            counts.append(p.counts)
            for have, x in zip(keys, bigrams.of(p), strict=True):
                have.append(x)
        self.counts = np.concatenate([*counts, np.zeros(0, np.int64)])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        found, self.places, size = [], [], 0
        for x in keys:
            distinct, back = np.unique(np.concatenate([*x, np.zeros(0, np.uint64)]), return_inverse=True)
            found.append(distinct)
            self.places.append(back + size)
            size += len(distinct)
        self.keys = np.concatenate(found)
        part = (self.keys >> np.uint64(1)) % np.uint64(parts)
        self.order = np.argsort(part, kind="stable")
        self.edge = np.searchsorted(part[self.order], np.arange(parts + 1, dtype=np.uint64))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many words in flagged texts have each key, in order of parts."""
        own = flags[self.doc]
        return sum(np.bincount(x[own], minlength=len(self.keys)) for x in self.places)[self.order]


ASKED = "part int, chunk long, asks boolean, n int, keys binary, background binary, target binary"
#: Rows without a chunk have a part's totals.
ANSWERED = "chunk long, part int, background binary, target binary, words long, n_background long, n_target long"


CODEC = pa.Codec("zstd", compression_level=1)


def _packed(x: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs, compressed (most are small)."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + CODEC.compress(x.tobytes(), asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(CODEC.decompress(x[1:], n * x[0], asbytes=True), f"u{x[0]}").astype(np.int64)


def _packed_keys(x: np.ndarray) -> bytes:
    """Keys, sorted but for a few places, as steps with equal bytes side by side, of which the high ones are small."""
    steps = np.diff(x, prepend=np.uint64(0))
    return CODEC.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _unpacked_keys(x: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(CODEC.decompress(x, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _ask(shared, parts: int, counts: bool, asks: bool):
    """A chunk's rows (id, text) and its target ids to a row per part: keys, and their counts in the chunk."""

    def run(docs: pa.Table, flagged: pa.Table) -> pa.Table:
        c = Chunk(docs.column("text"), shared.value, parts)
        n = len(c.keys)
        flag = pa.compute.is_in(docs.column("id"), value_set=flagged.column("good").combine_chunks()).to_numpy(zero_copy_only=False).astype(bool)
        whole, own = (c.sums(np.ones(len(flag), bool)), c.sums(flag)) if counts else (np.zeros(n, np.int64),) * 2
        full = np.flatnonzero(np.diff(c.edge))
        cut = [slice(c.edge[x], c.edge[x + 1]) for x in full]
        keys = c.keys[c.order]
        chunk = docs.column("chunk")[0].as_py() if docs.num_rows else None
        columns = [pa.array(full.astype(np.int32)), pa.array([chunk] * len(full), pa.int64()), pa.array([asks] * len(full), pa.bool_()), pa.array(np.diff(c.edge)[full].astype(np.int32)), pa.array([_packed_keys(keys[x]) for x in cut], pa.binary())]
        columns += [pa.array([_packed(y[x]) for x in cut], pa.binary()) for y in (whole, own)]
        return pa.table(columns, names=["part", "chunk", "asks", "n", "keys", "background", "target"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a part to the whole counts of each row's keys, and a row of the part's words: distinct ones, and all in either corpus."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    keys = [_unpacked_keys(r["keys"], r["n"]) for r in rows]
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = []
    for c in ("background", "target"):
        sums = np.bincount(back, np.concatenate([_unpacked(r[c], len(k)) for r, k in zip(rows, keys, strict=True)]), len(distinct))
        total.append(sums.astype(np.int64))  # exact below 2^53
    word = (distinct & np.uint64(1)).astype(bool)
    known = [int((total[0][word] > 0).sum()), *(int(t[word].sum()) for t in total)]
    names = ["chunk", "part", "background", "target", "words", "n_background", "n_target"]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=names)

    yield row(None, rows[0]["part"], None, None, *known)
    at = 0
    for r, k in zip(rows, keys, strict=True):
        own, at = back[at : at + len(k)], at + len(k)
        if r["asks"]:
            yield row(r["chunk"], r["part"], *(_packed(t[own]) for t in total), None, None, None)


def _losses(word: np.ndarray, context: np.ndarray, pair: np.ndarray, total: int, size: int) -> np.ndarray:
    """One model's loss of each word, from its counts, all its words and the vocabulary's size."""
    n = max(1, total)
    single = (word + SMOOTH * n / size) / (total + SMOOTH * n)
    order = np.where(context > 0, ORDER, 0.0)
    return -np.log(order * np.minimum(1.0, pair / np.maximum(context, 1)) + (1 - order) * single)


def vocabulary(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """The sorted hashes of the most frequent words of all documents."""
    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()  # size rows
    return np.sort(top.column("word").to_numpy().view(np.uint64))


class Corpus(NamedTuple):
    """What the models are trained on: documents, the target documents' keys, and the columns."""

    docs: DataFrame
    target: DataFrame
    text_col: str
    key_col: str


def train(docs: DataFrame, target: DataFrame, text_col: str = "text", key_col: str = "doc_id", size: int | None = None, slots: int | None = None) -> tuple[Bigrams, Corpus]:
    """The models, which are counted as documents are scored; target: a table with the target documents' keys."""
    return Bigrams(None if size is None else vocabulary(docs, text_col, size), slots), Corpus(docs, target, text_col, key_col)


def _parts(docs: DataFrame, text_col: str) -> int:
    """Chunks of the documents, and parts of their keys."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // CHUNK))


def _chunked(docs: DataFrame, text_col: str, key_col: str, keys: tuple[str, ...], parts: int) -> DataFrame:
    """docs as (chunk, id, text, k0, k1, ...)."""
    key, text = F.col(f"`{key_col}`"), F.col(f"`{text_col}`")
    named = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    return docs.select(F.pmod(F.xxhash64(key, text), F.lit(parts)).cast("long").alias("chunk"), key.alias("id"), text.alias("text"), *named)


def score(docs: DataFrame, models: tuple[Bigrams, Corpus], text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the keys, n_tokens, the mean losses, and score, the target's less the background's."""
    bigrams, known = models
    shared = docs.sparkSession.sparkContext.broadcast(bigrams)  # a vocabulary only where a size was given
    same = docs is known.docs and text_col == known.text_col  # the same chunks are counted and scored
    parts = max(_parts(d, c) for d, c in {id(known.docs): (known.docs, known.text_col), id(docs): (docs, text_col)}.values())
    rows = _chunked(docs, text_col, known.key_col if same else keys[0], keys, parts)
    trained = rows if same else _chunked(known.docs, known.text_col, known.key_col, (), parts)
    flags = known.target.select(F.col(f"`{known.key_col}`").alias("id")).filter("id is not null").distinct()
    # labels grow with the documents: the same plan at every size, and no broadcast
    flagged = trained.select("chunk", "id").filter("id is not null").distinct().join(flags.hint("merge"), "id").select(F.col("chunk").alias("near"), F.col("id").alias("good"))

    # as many tasks as chunks, both times by one exchange of the texts
    dealt = rows.repartition(parts, "chunk")
    counted = dealt if same else trained.repartition(parts, "chunk")
    asked = counted.groupBy("chunk").cogroup(flagged.groupBy("near")).applyInArrow(_ask(shared, parts, True, same), ASKED)
    if not same:
        asked = asked.unionByName(dealt.groupBy("chunk").cogroup(flagged.limit(0).groupBy("near")).applyInArrow(_ask(shared, parts, False, True), ASKED))
    answered = Settled(asked.repartitionById(parts, "part").mapInArrow(_answer, ANSWERED))
    totals = answered.df.filter("chunk is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "n_background", "n_target")]).first().asDict()
    answers = answered.df.filter("chunk is not null").select("chunk", "part", "background", "target")
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField("n_tokens", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in ("target_loss", "background_loss", "score")])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(docs.column("text"), shared.value, parts)
        found = answers.to_pylist()
        size = (totals["words"] if shared.value.vocabulary is None else len(shared.value.vocabulary)) + 2
        losses = []
        for model in ("target", "background"):
            count = np.zeros(len(c.keys), np.int64)
            for r in found:
                at = c.order[c.edge[r["part"]] : c.edge[r["part"] + 1]]
                count[at] = _unpacked(r[model], len(at))
            losses.append(_losses(*(count[x] for x in c.places), totals[f"n_{model}"], size))
        t, g = losses
        none, n = c.counts == 0, np.maximum(c.counts, 1)
        mean = [pa.array(np.bincount(c.doc, x, len(n)) / n if len(x) else np.zeros(len(n)), mask=none) for x in (t, g, t - g)]
        return pa.table([*(docs.column(f"k{i}") for i in range(len(keys))), pa.array(c.counts.astype(np.int64)), *mean], names=schema.names)

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
