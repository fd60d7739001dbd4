"""N-gram Jaccard join with filters under several global orders.

A document's set is its distinct shingles of ``SHINGLE`` words; documents link when the sets' Jaccard similarity is at
least ``PERCENT`` percent.  Documents with equal sets are one class, and classes are joined.

*Orders.*  With n shingles, at least ceil(0.8 n) must be shared, so the first p = n - ceil(0.8 n) + 1 shingles of any global
order hold a shared one.  Three orders are used, which have nothing to do with each other: a hash, the rarity (the number
of classes that have a token), and another hash.  A pair is verified only if it shares a token of the whole prefixes under
all three.

*First order (hash), class by class.*  The first p + l - 1 shingles of any order hold l shared ones.  The zone of a class is
its p + l - 1 smallest hashes, l = n / 10: partners share l tokens of their zones.  In order of rarity among the zones, all
but the last l - 1 tokens of a zone must hold a shared one; tokens of one class alone come first, so most documents drop
out here, by a third of their tokens.

*Second order (rarity), candidates.*  The whole sets of those that are left are ordered by the number of such classes that
have a token.  Tokens that no other class has come first: a class with more than a fifth of them drops out, boilerplate
that many documents share comes last, and a pair can share no more tokens than either has in common with anyone.

*Candidates without all pairs.*  Every prefix token has a leader, the class with the fewest tokens of its own (of a group of
edited copies, the one nearest to the original); first, classes are verified against leaders only.  The components of what
holds are the groups of near copies.  Then, in the group of each leader, the classes outside the group's largest component
meet those of lengths that allow a link, in blocks, which are bounded and checked inside a task; of a block's links, one
comes out for every two components that it joins.  A pair that shares a prefix token is in the group of that token's leader,
so no link between components is lost; links inside one need not be listed, and no pairs are dealt.

*Verification* counts the intersection of the whole sets, of pairs that pass the first and third orders' prefixes too.

Tokens travel as packed arrays, dealt by token to as many parts as the counted tokens call for.  Tokens in more than a few
thousandths of all entries, and in ``HOT`` classes at least, are found beforehand (mergeable Misra-Gries summaries of all
documents, at most ``SUMMARY`` tokens) and aren't dealt at all: their rank is known everywhere.  Later joins on tokens have
one row per token on one side, or are split by adaptive execution.  Sets are computed twice for all documents, once more
for those with possible partners, and settled from there on.

Shingles and sets are compared by 64-bit hashes.  Null texts and texts without words have empty sets, link with nothing and
are their own component.  Fewer words than a shingle are one shingle.  Whole texts count, however long: the classes of a
block are fewer where their sets are larger.  Equal rows are in one class.  Rows with a null id link as others do, and
don't name a component.  Empty tables give no rows.  Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.words import LOWER, SPACED, Piece, among, fresh, mix, pieces, rolling
from graphwright.operators.components import components
from graphwright.plans.scratch import Settled

#: Words in a shingle, and the similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Tokens in a summary of frequent tokens.
SUMMARY = 8192
#: Classes that have a token which isn't dealt, at least.
HOT = 1000
#: Entries that a task packs at a time, and that a part holds on average.
PACK, PART = 500_000, 1_000_000
#: Classes on a side of a block, and tokens of their sets.
BLOCK, BLOCK_TOKENS = 500, 1_000_000


def sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted, distinct shingle hashes of each text."""
    p = Piece(texts, SPACED, LOWER)
    at, gram = p.grams(shingle)
    first = np.searchsorted(p.doc[at], np.arange(p.n + 1))
    out = [np.unique(gram[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    for d in np.flatnonzero((p.counts > 0) & (p.counts < shingle)):
        w = p.hash[p.first[d] : p.first[d + 1]]
        out[d] = mix(rolling(w, len(w)) + np.uint64(len(w)))
    return out


def class_id(s: np.ndarray) -> int:
    """A hash of the set; never that of another size but by chance."""
    return int(mix(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True) + np.uint64(len(s)))[0].view(np.int64))


def need(n):
    """The fewest tokens that a set of n shares with a partner."""
    return -(-PERCENT * n // 100)


def zone_need(n):
    """The tokens of its zone that a set of n shares with a partner at least as large."""
    return np.maximum(1, n // 10)


def zone_size(n):
    return n - need(n) + zone_need(n)


def prefix_size(n):
    """Tokens of the zone that must hold a shared one; a partner may have as few as need(n) tokens."""
    return zone_size(n) - zone_need(need(n)) + 1


def _whole(n):
    return n


def prefix(n):
    """Tokens of a whole set that must hold a shared one, in any order."""
    return n - need(n) + 1


def _merged(token: np.ndarray, count: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A summary of frequent tokens with more tokens, cut to SUMMARY (counts fall by what is cut)."""
    t, back = np.unique(np.concatenate([token, *waiting]), return_inverse=True)
    c = np.bincount(back, np.concatenate([count, *(np.ones(len(x), np.int64) for x in waiting)])).astype(np.int64)
    if len(t) > SUMMARY:
        c = c - np.partition(c, len(c) - SUMMARY - 1)[len(c) - SUMMARY - 1]
    return t[c > 0], c[c > 0]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) to (class, n, bag), the set's sorted tokens as bytes."""
    for b in pieces(batches, "text"):
        found = sets(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("class"), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["class", "n", "bag"])


def _opened(bags: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in bags]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bag) to rows (token, n) of a summary of frequent tokens; each bag is another class."""
    token, count, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    for b in pieces(batches, "bag"):
        waiting += [s.copy() for s in _opened(b.column("bag"))]
        size += sum(map(len, waiting[-b.num_rows :]))
        if size > PACK:
            (token, count), waiting, size = _merged(token, count, waiting), [], 0
    token, count = _merged(token, count, waiting)
    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], names=["token", "n"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) to (doc_id, key, class, n), and rows (token, n) of a summary of frequent tokens."""
    names = ["doc_id", "key", "class", "n", "token"]
    seen: set[int] = set()
    token, count, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    kind = None

    for b in pieces(batches, "text"):
        kind = b.column("doc_id").type
        found = sets(b.column("text"))
        n = [len(s) for s in found]
        ids = [class_id(s) if len(s) else None for s in found]
        for c, s in zip(ids, found, strict=True):
            if len(s) and c not in seen:
                seen.add(c)
                waiting.append(s[: zone_size(len(s))])
                size += len(waiting[-1])
        if size > PACK:
            (token, count), waiting, size = _merged(token, count, waiting), [], 0
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.nulls(b.num_rows, pa.int64())], names=names)
    if waiting or len(token):
        token, count = _merged(token, count, waiting)
        none = pa.nulls(len(token))
        yield pa.RecordBatch.from_arrays([none.cast(kind), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(count), pa.array(token.view(np.int64))], names=names)


NAMES = ["part", "kind", "class", "token", "value"]
PACKED = "part int, kind int, class binary, token binary, value binary"
#: Kinds of packed rows: class and token; class and its size; class, token and the token's number of classes.
POSTING, SIZE, RANKED = range(3)


def _pack(kind: int, parts: int, part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row per part, with the columns' values in it."""
    order = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(edge))
    dealt = [c[order].astype(np.int64, copy=False) if c.dtype != np.uint64 else c[order] for c in columns]
    arrays = [pa.array([c[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary()) for c in dealt]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32)), *arrays, *[pa.nulls(len(full), pa.binary())] * (3 - len(arrays))], names=NAMES)


def _unpack(batches: list[pa.RecordBatch], kind: int, column: str, dtype) -> np.ndarray:
    found = [np.frombuffer(x.as_buffer(), dtype) for b in batches for k, x in zip(b.column("kind").to_pylist(), b.column(column), strict=True) if k == kind]
    return np.concatenate([*found, np.zeros(0, dtype)])


def _by_token(token: np.ndarray, parts: int) -> np.ndarray:
    return (token >> np.uint64(8)) % np.uint64(parts)


def _by_class(ids: np.ndarray, parts: int) -> np.ndarray:
    return mix(ids.view(np.uint64)) % np.uint64(parts)


def _own(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The class and set of each row (text) or (class, bag)."""
    if "bag" in b.schema.names:
        yield from zip(b.column("class").to_pylist(), _opened(b.column("bag")), strict=True)
    else:
        for s in sets(b.column("text")):
            if len(s):
                yield class_id(s), s


def _deal(parts: int, token: np.ndarray, df: np.ndarray, part_of, column: str):
    """(text) or (class, bag) to packed rows: the first part_of(n) tokens by token; sizes, and the frequent tokens (token, df) with their rank, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        zones: list[np.ndarray] = []
        ids: list[int] = []
        sizes: list[int] = []

        def packed() -> Iterator[pa.RecordBatch]:
            t, c = np.concatenate(zones), np.array(ids, np.int64)
            owner = np.repeat(c, [len(z) for z in zones])
            hot = among(t, token)
            yield _pack(SIZE, parts, _by_class(c, parts), c, np.array(sizes, np.int64))
            yield _pack(RANKED, parts, _by_class(owner[hot], parts), owner[hot], t[hot], df[np.searchsorted(token, t[hot])])
            t, owner = np.delete(t, hot), np.delete(owner, hot)
            yield _pack(POSTING, parts, _by_token(t, parts), owner, t)

        held = 0
        for b in pieces(batches, column):
            for c, s in _own(b):
                if c in seen:
                    continue
                seen.add(c)
                ids.append(c)
                sizes.append(len(s))
                zones.append(s[: part_of(len(s))].copy())
                held += len(zones[-1])
            if held > PACK:
                yield from packed()
                zones, ids, sizes, held = [], [], [], 0
        if ids:
            yield from packed()

    return run


def _rank(parts: int):
    """The postings of a part to (class, token, df) of the tokens that several classes have; other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            posting = pa.compute.equal(b.column("kind"), POSTING)
            yield b.filter(pa.compute.invert(posting))
            held.append(b.filter(posting))
        t, c = _unpack(held, POSTING, "token", np.uint64), _unpack(held, POSTING, "class", np.int64)
        del held
        order = np.argsort(t)
        t, c = t[order], c[order]
        twice = np.zeros(len(t), bool)
        twice[1:] = t[1:] == t[:-1]
        twice[:-1] |= twice[1:]
        t, c = t[twice], c[twice]
        if not len(t):
            return
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        new = np.append(True, (t[1:] != t[:-1]) | (c[1:] != c[:-1]))  # several tasks may have had a class
        t, c = t[new], c[new]
        start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        df = np.diff(np.append(start, len(t)))
        df = np.repeat(df, df)
        t, c, df = t[df > 1], c[df > 1], df[df > 1]
        if len(t):
            yield _pack(RANKED, parts, _by_class(c, parts), c, t, df)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """A part's classes and sizes, the repeated tokens by class and rarity, and where each class's begin and end."""
    held = list(batches)
    c, n = _unpack(held, SIZE, "class", np.int64), _unpack(held, SIZE, "token", np.int64)
    owner, t, df = _unpack(held, RANKED, "class", np.int64), _unpack(held, RANKED, "token", np.uint64), _unpack(held, RANKED, "value", np.int64)
    del held
    c, at = np.unique(c, return_index=True)
    n = n[at]
    order = np.lexsort((t, df, owner))
    owner, t, df = owner[order], t[order], df[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (t[1:] != t[:-1]))[: len(owner)]  # frequent tokens come from several tasks
    owner, t, df = owner[new], t[new], df[new]
    return c, n, t, df, np.searchsorted(owner, c), np.searchsorted(owner, c, "right")


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All zone rows of a part's classes to the classes whose zone prefix has a repeated token."""
    c, n, _, _, a, b = _gathered(batches)
    yield pa.RecordBatch.from_arrays([pa.array(c[prefix_size(n) > zone_size(n) - (b - a)])], names=["class"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a part's classes to (token, class, n, common) of the tokens in the second order's prefix that several classes have."""
    c, n, t, _, a, b = _gathered(batches)
    common = b - a
    left = np.minimum(prefix(n) - (n - common), common)  # places in the prefix after the tokens of one class alone
    k = np.flatnonzero(left > 0)
    if not len(k):
        return
    many = left[k]
    row = np.repeat(a[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
    which = np.repeat(k, many)
    yield pa.RecordBatch.from_arrays([pa.array(t[row].view(np.int64)), pa.array(c[which]), pa.array(n[which]), pa.array(common[which])], names=["token", "class", "n", "common"])


def _third(s: np.ndarray) -> np.ndarray:
    """The prefix under the third order: another hash of the tokens (which is one to one)."""
    x = mix(s ^ np.uint64(0x9E6C63D0876A9A47))
    k = prefix(len(s))
    return np.sort(np.partition(x, k - 1)[:k])


def _meet(x: np.ndarray, y: np.ndarray) -> int:
    """How many of x are in y; both sorted and distinct."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets are similar enough; most pairs that aren't fall by the first and third orders' prefixes."""
    if not len(x) or not len(y) or not _meet(x[: prefix(len(x))], y[: prefix(len(y))]) or not _meet(_third(x), _third(y)):
        return False
    both = _meet(x, y)
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, bag_u, bag_v) to the pairs (u, v) whose sets are similar enough."""
    for b in batches:
        good = [alike(x, y) for x, y in zip(_opened(b.column("bag_u")), _opened(b.column("bag_v")), strict=True)]
        yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def _fits(x: str, y: str) -> str:
    """Length bound, and that each has enough tokens in common with anyone."""
    size = f"100 * least({x}.n, {y}.n) >= {PERCENT} * greatest({x}.n, {y}.n)"
    return f"{size} and {100 + PERCENT} * least({x}.common, {y}.common) >= {PERCENT} * ({x}.n + {y}.n)"


def classes(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> tuple[Settled, DataFrame]:
    """The settled table (doc_id, key, class, n, token), and docs(doc_id, key, text)."""
    small = docs.select(F.col(f"`{key_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    kind = small.schema["doc_id"].dataType.simpleString()
    return Settled(small.mapInArrow(_classes, f"doc_id {kind}, key long, class long, n long, token long")), small


def _ranked(rows: DataFrame, frequent: DataFrame, entries: int, part_of) -> DataFrame:
    """Packed rows by class, from rows(text) or (class, bag), a summary(token, n), and how many tokens there are."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // PART))
    hot = frequent.groupBy("token").agg(F.sum("n").alias("df")).filter((F.col("df") >= HOT) & (F.col("df") * (SUMMARY // 2) > entries))
    hot = hot.orderBy(F.desc("df"), "token").limit(SUMMARY).toArrow()  # no more than SUMMARY tokens reach so much
    token, df = hot.column("token").to_numpy().view(np.uint64), hot.column("df").to_numpy()
    order = np.argsort(token)
    dealt = rows.mapInArrow(_deal(parts, token[order], df[order], part_of, rows.columns[-1]), PACKED).repartitionById(parts, "part")
    return dealt.mapInArrow(_rank(parts), PACKED).repartitionById(parts, "part")


def survivors(small: DataFrame, found: Settled) -> Settled:
    """The settled sets (class, n, bag) of the classes that may have partners by the first order."""
    entries = found.df.filter("class is not null").agg(F.sum(F.expr(f"n div {100 // (100 - PERCENT)} + n div 10 + 1"))).first()[0] or 0
    left = _ranked(small.select("text"), found.df.filter("token is not null").select("token", "n"), entries, zone_size).mapInArrow(_survivors, "class long").distinct()
    one = found.df.filter("class is not null").groupBy("class").agg(F.min(F.struct("key", "doc_id")).alias("r")).join(left, "class").select("class", F.col("r.key").alias("key"), F.col("r.doc_id").alias("id"))
    texts = small.join(one, (small["key"] == one["key"]) & small["doc_id"].eqNullSafe(one["id"])).select("class", "text")
    bags = texts.mapInArrow(_bags, "class long, n long, bag binary")
    return Settled(bags.groupBy("class").agg(F.first("n").alias("n"), F.first("bag").alias("bag")))


def prefixes(bags: Settled) -> Settled:
    """The settled prefix tokens (token, class, n, common) of the classes that may have partners."""
    entries = bags.df.agg(F.sum("n")).first()[0] or 0
    ranked = _ranked(bags.df.select("class", "bag"), bags.df.select("bag").mapInArrow(_frequent, "token long, n long"), entries, _whole)
    return Settled(ranked.mapInArrow(_prefixes, "token long, class long, n long, common long"))


def verified(pairs: DataFrame, bags: Settled) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar enough."""
    with_u = pairs.join(bags.df.select(F.col("class").alias("u"), F.col("bag").alias("bag_u")), "u")
    both = with_u.join(bags.df.select(F.col("class").alias("v"), F.col("bag").alias("bag_v")), "v")
    return both.select("u", "v", "bag_u", "bag_v").mapInArrow(_similar, "u long, v long")


def _shared(x: list[np.ndarray], y: list[np.ndarray], ok: np.ndarray) -> np.ndarray:
    """ok, without the pairs of x and y that share no token: products of 0-1 matrices, some tokens at a time."""
    flat = [np.concatenate([*z, np.zeros(0, np.uint64)]) for z in (x, y)]
    owner = [np.repeat(np.arange(len(z)), [len(s) for s in z]) for z in (x, y)]
    both = np.intersect1d(*flat)
    hit = np.zeros(ok.shape, bool)
    found = []
    for t, o in zip(flat, owner, strict=True):
        at = among(t, both)
        place = np.searchsorted(both, t[at])
        order = np.argsort(place, kind="stable")
        found.append((place[order], o[at][order]))
    step = 2048
    for a in range(0, len(both), step):
        m = []
        for (place, o), n in zip(found, ok.shape, strict=True):
            own = slice(*np.searchsorted(place, [a, a + step]))
            z = np.zeros((n, min(step, len(both) - a)), np.float32)
            z[o[own], place[own] - a] = 1
            m.append(z)
        hit |= (m[0] @ m[1].T) > 0
    return ok & hit


def _block(table: pa.Table) -> pa.Table:
    """Links between the rows of a block's sides a and b: one for every two parts that they join."""
    table = table.combine_chunks()
    own = table.column("side").to_numpy(zero_copy_only=False) == "a"
    rows = [table.filter(pa.array(x)) for x in (own, ~own)]
    a, b = ({c: t.column(c).to_numpy(zero_copy_only=False) for c in ("class", "part", "n", "common")} for t in rows)
    low, high = np.minimum, np.maximum
    x, y, cx, cy = a["n"][:, None], b["n"][None, :], a["common"][:, None], b["common"][None, :]
    ok = (a["part"][:, None] != b["part"][None, :]) & (100 * low(x, y) >= PERCENT * high(x, y)) & ((100 + PERCENT) * low(cx, cy) >= PERCENT * (x + y))
    u, v = [], []
    if ok.any():
        ok = _shared(*([np.array(z, np.int64).view(np.uint64) for z in t.column("tokens").to_pylist()] for t in rows), ok)
    if ok.any():
        p, q = (_opened(pa.concat_arrays(t.column("bag").chunks)) for t in rows)
        ok = _shared([s[: prefix(len(s))] for s in p], [s[: prefix(len(s))] for s in q], ok)
        if ok.any():
            ok = _shared([_third(s) for s in p], [_third(s) for s in q], ok)
        root: dict[int, int] = {}

        def find(z: int) -> int:
            while (up := root.get(z, z)) != z:
                root[z] = root.get(up, up)
                z = up
            return z

        for i, j in np.argwhere(ok):
            f, g = find(int(a["part"][i])), find(int(b["part"][j]))
            if f != g and 100 * (both := _meet(p[i], q[j])) >= PERCENT * (len(p[i]) + len(q[j]) - both):
                root[f] = g
                u.append(int(a["class"][i]))
                v.append(int(b["class"][j]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


#: Lengths that may link are at most one step apart.
STEP = 1.05 * 100 / PERCENT
#: Places that the classes of a group are dealt to when they meet a row of the group's.
SALTS = 16


def _dealt(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """rows(class, ...) joined with a table that has one row for each key; a key that many rows have is dealt to SALTS places, and nothing is broadcast."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS))).join(one.withColumn("salt", each).hint("merge"), [*keys, "salt"]).drop("salt")


def _across(labelled: DataFrame, leaders: DataFrame, bags: Settled) -> DataFrame:
    """Links between classes that share a second-order token, and so its leader's group, but aren't in one part.

    In each group the classes outside its largest part (side a) meet all of similar length (side b), in blocks.  Sets join the
    classes when their blocks are known.
    """
    rows = labelled.join(leaders, "token").withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(STEP))))
    members = Settled(rows.groupBy("leader", "class", "part", "n", "common", "step").agg(F.collect_list("token").alias("tokens")))
    parts = members.df.groupBy("leader", "part").agg(F.count(F.lit(1)).alias("c"))
    torn = parts.groupBy("leader").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "part")).alias("most")).filter("parts > 1").select("leader", F.col("most.part").alias("largest"))
    member = Settled(_dealt(members.df, torn, ["leader"]))
    members.drop()
    outer = F.col("part") != F.col("largest")

    def blocks(n: Column, tokens: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK, tokens / BLOCK_TOKENS))

    count = F.count(F.lit(1))
    sizes = Settled(member.df.groupBy("leader", "step").agg(blocks(F.count(F.when(outer, 1)), F.sum(F.when(outer, F.col("n")).otherwise(0))).alias("na"), blocks(count, F.sum("n")).alias("nb")))
    placed = _dealt(member.df, sizes.df, ["leader", "step"]).withColumn("with", F.explode(F.array(*[F.col("step") + d for d in (-1, 0, 1)])))
    other = sizes.df.select("leader", F.col("step").alias("with"), F.col("na").alias("other_a"), F.col("nb").alias("other_b"))
    place = F.xxhash64("class")
    keep = ["class", "part", "n", "common", "tokens"]
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = _dealt(placed.filter(outer), other, ["leader", "with"])
    a = a.select("leader", F.col("step").alias("of_a"), F.col("with").alias("of_b"), F.pmod(place, F.col("na")).alias("i"), each("other_b").alias("j"), F.lit("a").alias("side"), *keep)
    b = _dealt(placed, other.filter("other_a > 0"), ["leader", "with"])
    b = b.select("leader", F.col("with").alias("of_a"), F.col("step").alias("of_b"), each("other_a").alias("i"), F.pmod(place, F.col("nb")).alias("j"), F.lit("b").alias("side"), *keep)
    filled = a.unionByName(b).join(bags.df.select("class", "bag"), "class")
    out = Settled(filled.groupBy("leader", "of_a", "of_b", "i", "j").applyInArrow(_block, "u long, v long"))
    member.drop()
    sizes.drop()
    return out


def groups(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, key (a hash of the text), n, class and part, the component's smallest class.

    Rows without shingles have neither class nor part.
    """
    found, small = classes(docs, text_col, key_col)
    bags = survivors(small, found)
    heads = prefixes(bags)
    nearest = F.min(F.struct((F.col("n") - F.col("common")).alias("own"), "class", "n", "common"))
    leaders = heads.df.groupBy("token").agg(nearest.alias("l"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    star = heads.df.join(leaders, "token").filter(F.col("class") != F.col("l.class"))
    star = star.select(F.struct(*heads.df.columns[1:]).alias("x"), F.col("l").alias("y")).filter(_fits("x", "y"))
    star = star.select(F.greatest("x.class", "y.class").alias("u"), F.least("x.class", "y.class").alias("v")).distinct()
    links = Settled(verified(star, bags))
    group = components(links.df)

    labelled = heads.df.join(group.df, F.col("class") == F.col("node"), "left").select("token", "class", "n", "common", F.coalesce("component", "class").alias("part"))
    across = _across(labelled, leaders.select("token", F.col("l.class").alias("leader")), bags)
    for t in (group, heads, bags):
        t.drop()
    group = components(links.df.unionByName(across.df))
    links.drop()
    across.drop()

    rows = found.df.filter("token is null")
    return rows.join(group.df, F.col("class") == F.col("node"), "left").select("doc_id", "key", "n", "class", F.coalesce("component", "class").alias("part"))


def join(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id, the smallest id that links reach."""
    rows = groups(docs, text_col, key_col)
    # settled, so that the join has the dealt rows alone on its sides and the partition of a large component can be split
    named = Settled(rows.filter("part is not null").groupBy("part").agg(F.min("doc_id").alias("component_id"))).df
    out = rows.join(named, "part", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """The rows of docs, one of each component (that of the smallest id, ids before nulls); rows without words stay."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    keep = groups(docs, text_col, key_col).filter("part is not null").groupBy("part").agg(first.alias("r"))
    row = fresh(docs.columns, "row")[0]
    keep = keep.select(F.xxhash64("r.doc_id", "r.key").alias(row))
    text = F.col(f"`{text_col}`")
    full = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(full).withColumn(row, F.xxhash64(F.col(f"`{key_col}`"), F.xxhash64(text)))
    one = rows.join(keep, row, "left_semi").dropDuplicates([row]).drop(row)  # dealt by the same column: one shuffle
    return one.unionByName(docs.filter(~full))


QUERY_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
links AS (
  SELECT a.r AS u, b.r AS v
  FROM grams a JOIN grams b USING (s) JOIN sizes x ON x.r = a.r JOIN sizes y ON y.r = b.r
  WHERE a.r <> b.r GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
  SELECT r, r AS to_r FROM docs
  UNION
  SELECT reach.r, links.v FROM reach JOIN links ON links.u = reach.to_r)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(t.doc_id) AS component_id
FROM reach JOIN docs d USING (r) JOIN docs t ON t.r = reach.to_r LEFT JOIN sizes s ON s.r = reach.r
GROUP BY reach.r
"""
