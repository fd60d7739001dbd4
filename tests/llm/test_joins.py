"""Operators over many rows, against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from graphwright.llm import chat, mixing, ngram_join, sharding, substring
from graphwright.operators import components
from tests.llm.common import CLASHES, corpus, frame, with_clashes

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = SPACES.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(ids[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("block", [500, 2])
def test_ngram_join(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [r for s in range(2) for r in corpus(s, 25)]
    rows = [(None if r[0] is None else r[0] + 1000 * (i > len(rows) // 2), *r[1:]) for i, r in enumerate(rows)]
    got = ngram_join.join(with_clashes(frame(spark, rows))).collect()
    assert order([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == order(brute_components(rows))


def test_ngram_chain(spark):
    """Near copies of near copies: neighbours link, the ends don't."""
    base = [f"t{i}" for i in range(100)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(base), "", "", 0))
        base = list(base)
        base[8 * k + 3] = f"new{k}"
    rows.reverse()
    got = ngram_join.join(frame(spark, rows)).collect()
    want = brute_components(rows)
    assert order([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == order(want) and len({x[2] for x in want}) == 1


@pytest.mark.parametrize("size", [14, 18])
def test_ngram_join_of_overlapping_crops(spark, size):
    """A pair's shared tokens of the two orders may have different leaders."""
    text = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(text[i : i + size]), None, None, None) for i in range(400 - size + 1)]
    got = ngram_join.join(frame(spark, rows)).collect()
    assert order([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == order(brute_components(rows))


@pytest.mark.parametrize(("hot", "summary", "block"), [(1, 8192, 3), (1, 64, 500), (10**9, 8192, 500), (10**9, 8192, 2)])
def test_ngram_join_of_many_small_corpora(spark, hot, summary, block, monkeypatch):
    """Sets by hand, words of each corpus apart; tokens that many classes have take either way."""
    import random

    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "SUMMARY", summary)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rnd = random.Random(hot + block)
    rows, want = [], []
    for k in range(400):
        text = [f"c{k}w{i}" for i in range(40)]
        own = []
        for _ in range(rnd.randrange(2, 14)):
            way, a = rnd.randrange(5), rnd.randrange(25)
            n = rnd.randrange(9, 26)
            if way == 0:
                t = text[a : a + n]
            elif way == 1 and own:
                t = [*rnd.choice(own)[1].split()]
                t[rnd.randrange(len(t))] = f"c{k}x{rnd.randrange(50)}"
            elif way == 2 and own:
                t = rnd.choice(own)[1].split()[rnd.randrange(2) :] + [f"c{k}x{rnd.randrange(50)}"] * rnd.randrange(2)
            elif way == 3:
                t = [f"c{k}y{rnd.randrange(50)}"] + text[a : a + rnd.randrange(4, 9)]  # short ones that share a shingle or two
            else:
                t = text[a : a + 6] + text[rnd.randrange(20) :][:12]
            own.append((len(rows) + len(own), " ".join(t), "", "", 0))
        rows += own
        want += brute_components(own)
    ballast = [f"b{i}" for i in range(20_000)]
    own = [(len(rows) + i, " ".join([*ballast, f"last{i}"]), "", "", 0) for i in range(2)]
    got = ngram_join.join(frame(spark, rows + own)).collect()
    assert order([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == order(want + brute_components(own))


def test_ngram_join_near_the_limit(spark, monkeypatch):
    """Two sets at 80 percent whose shared prefix tokens have other leaders, beside long texts that outnumber all tokens."""
    monkeypatch.setattr(ngram_join, "HOT", 10**9)
    u = [f"u{i}" for i in range(13)]
    texts = [u, ["other", *u[1:]]]
    texts += [u[i : i + 5] for i in range(1, 9)] + [[f"z{i}", *u[i : i + 5]] for i in range(1, 9)]
    ballast = [f"b{i}" for i in range(30_000)]
    texts += [[*ballast, "one"], [*ballast, "two"]]
    rows = [(i, " ".join(t), "", "", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in ngram_join.join(frame(spark, rows)).collect()}
    assert got == {d: c for d, _, c in brute_components(rows)} and got[1] == 0


def test_ngram_join_keeps_links_between_length_steps(spark, monkeypatch):
    """Chains of sets that grow by a quarter at a time: the farthest lengths that link."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    rows = []
    for k in range(30):
        n = 8 + k
        while n < 300:
            rows.append((len(rows), " ".join(f"k{k}t{i}" for i in range(n + 4)), "", "", 0))
            n = n * 5 // 4
    rnd = __import__("random").Random(3)
    rnd.shuffle(rows)
    got = ngram_join.join(frame(spark, rows)).collect()
    assert order([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == order(brute_components(rows))


def test_keep_one(spark):
    rows = corpus()
    kept = ngram_join.keep_one(with_clashes(frame(spark, rows)))
    assert kept.columns[-len(CLASHES) :] == CLASHES
    got = kept.collect()
    want = brute_components(rows)
    groups = {c for d, n, c in want if n and c is not None}
    lone = [r for r, (d, n, c) in zip(rows, want, strict=True) if n and c is None]
    empty = [r for r, (d, n, c) in zip(rows, want, strict=True) if not n]
    assert Counter(r.doc_id for r in got if shingles(r.text)) == Counter([*groups, *[r[0] for r in lone]])
    assert sum(not shingles(r.text) for r in got) == len(empty)
    assert ngram_join.keep_one(frame(spark, [])).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (3, 1), (10, 11), (11, 12), (12, 13), (13, 14), (20, 14)]
    got = components.components(spark.createDataFrame(links, "u long, v long")).df.collect()
    assert {(r.node, r.component) for r in got} == {(n, 1) for n in (1, 2, 3)} | {(4, 4), (5, 4)} | {(n, 10) for n in (10, 11, 12, 13, 14, 20)}
    assert components.components(spark.createDataFrame([], "u long, v long")).df.count() == 0


def brute_substring(rows):
    docs = [SPACES.findall(r[1] or "") for r in rows]
    c = Counter(tuple(w[i : i + 35]) for w in docs for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, docs, strict=True):
        gone = {k for i in range(len(w) - 34) if c[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        out.append((r[0], len(w), len(gone), sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def test_substring(spark):
    rows = corpus()
    got = substring.dedup(with_clashes(frame(spark, rows)), texts=True).collect()
    want = brute_substring(rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got)) == sorted((d is None, d or 0, *x) for d, *x in want)
    assert all(sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert all(sum(x.n for x in r.repeats) == r.n_removed and all(x.n >= substring.WINDOW for x in r.repeats) for r in got)
    text = {(r[0], len(SPACES.findall(r[1] or ""))): SPACES.findall(r[1] or "") for r in rows}
    for r in got:
        w = text[r.doc_id, r.n_words]
        gone = {i for x in r.repeats for i in range(x.first, x.first + x.n)}
        assert r.kept_text == " ".join(x for i, x in enumerate(w) if i not in gone) or r.doc_id is None
    assert substring.dedup(frame(spark, [])).count() == 0


def test_substring_partial_overlaps(spark):
    """Passages that end at different words, alone and inside each other."""
    p = [f"p{i}" for i in range(200)]
    cut = lambda a, b, tag: " ".join([f"{tag}{i}" for i in range(7)] + p[a:b] + [f"{tag}z{i}" for i in range(9)])
    spans = [(0, 60), (20, 90), (50, 86), (100, 135), (100, 134), (101, 150), (60, 200), (0, 35), (0, 34), (165, 200)]
    rows = [(i, cut(a, b, f"q{i}_"), "", "", 0) for i, (a, b) in enumerate(spans)]
    got = substring.dedup(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute_substring(rows))


def test_targets():
    t = mixing.targets([100, 100, 100])
    assert [float(x) for x in t] == [187.5, 75.0, 37.5]
    t = mixing.targets([10, 1000, 10])
    assert float(t[0]) == 30 and float(sum(t)) == 1020 and all(x <= 3 * n for x, n in zip(t, [10, 1000, 10], strict=True))
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    assert float(sum(mixing.targets([0, 5]))) == 5


def test_mixing(spark):
    rows = [r for r in corpus(1, 200) if r[0] is not None]
    df = with_clashes(frame(spark, rows))
    got = mixing.mix(df).select("doc_id", "source", "text", "size_", "source_size_", "target_", "taken_").collect()
    size = {s: sum(len(SPACES.findall(r[1] or "")) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    names = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(names, mixing.targets([size[n] for n in names]), strict=True))
    longest = max(len(SPACES.findall(r[1] or "")) for r in rows)
    for s in names:
        own = [r for r in got if r.source == s]
        assert {(r.source_size_, r.target_) for r in own} == {(size[s], float(want[s]))}
        assert float(want[s]) - 3 * longest <= sum(r.taken_ for r in own) <= float(want[s])
    assert all(r.size_ == len(SPACES.findall(r.text or "")) and r.taken_ <= 3 * r.size_ for r in got)
    again = {(r.doc_id, r.text, r.taken_) for r in mixing.mix(df.repartition(7)).select("doc_id", "text", "taken_").collect()}
    assert again == {(r.doc_id, r.text, r.taken_) for r in got}
    sample = mixing.sample(df)
    assert sample.columns == df.columns
    times = Counter((r.doc_id, r.text) for r in sample.collect())
    want_times = Counter()
    for r in got:
        want_times[r.doc_id, r.text] += r.taken_ // r.size_ if r.size_ else 0
    assert times == +want_times
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.sample(frame(spark, [])).count() == 0


def test_mixing_is_exact_at_the_boundary(spark):
    rows = [(i, "x " * 3, "", "a" if i % 2 else "b", 0) for i in range(2000)]
    got = mixing.mix(frame(spark, rows)).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert all(0 <= r.t - r.n < 3 for r in got)


@pytest.mark.parametrize(("way", "drop_text", "many"), [("null", False, 10_000), ("same", True, 10_000), ("same", False, 0), ("third", True, 10_000)])
def test_mixing_with_repeated_keys_and_rows(spark, way, drop_text, many, monkeypatch):
    """Each source is within one document of its target, however many rows agree in key, or in key and text."""
    monkeypatch.setattr(mixing, "MANY", many)
    rnd = __import__("random").Random(way)
    rows = []
    for i in range(3000):
        n = rnd.randrange(1, 30)
        text = "w " * 10 if way != "null" and rnd.random() < 0.5 else f"t{i} " * n
        key = None if way == "null" and i % 2 else 7 if way == "same" else i if i % 3 else 5
        rows.append((key, text, str(i % 5), [None, "s", "t"][i * i % 3], i))
    rnd.shuffle(rows)
    df = frame(spark, rows).withColumnRenamed("source", "the.source").repartition(5)
    got = mixing.mix(df, source_col="the.source", drop_text=drop_text).collect()
    assert len(got) == len(rows) and ("text" in got[0].asDict()) != drop_text
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((r[0], r[4]) for r in rows)
    for s in {r[3] for r in rows}:
        own = [r for r in got if r["the.source"] == s]
        longest = max(r["size"] for r in own)
        assert sum(r["size"] for r in own) == own[0].source_size
        assert 0 <= own[0].target - sum(r.taken for r in own) <= longest
        assert all(r.taken <= 3 * r["size"] for r in own)
    again = mixing.mix(df.repartition(3), source_col="the.source", drop_text=drop_text).collect()
    key = lambda r: (r.doc_id, r["the.source"], r["size"], r.taken)
    assert Counter(map(key, got)) == Counter(map(key, again))


def test_sharding(spark):
    rows = corpus(2, 300) + [(10**12 + i, f"copy {i % 3}", "", "", 0) for i in range(300)]
    got = sharding.numbered(with_clashes(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    have = Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert have == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32(r[1].encode()) if r[1] is not None else None) for r in rows)
    place = {r.doc_id: r.shard for r in got}
    assert all(place[r.doc_id] == r.shard for r in got)
    assert sharding.numbered(frame(spark, [])).count() == 0


def test_sharding_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 7)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    rows = [(3, "same", "", "", 0)] * 500 + [(None, None, "", "", 0)] * 15 + [(i, f"text {i % 4}", "", "", 0) for i in range(200)]
    got = sharding.numbered(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_follow_weights(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.Tree((((1.0, 3.0), (2.0,)), ((2.0,),)))
    n = Counter(r.shard for r in sharding.assign(keys, "doc_id", tree).collect())
    assert [n[i] / 20_000 for i in range(4)] == pytest.approx([1 / 8, 3 / 8, 2 / 8, 2 / 8], abs=0.02)


def test_movement_is_confined(spark):
    keys = spark.range(5000).withColumnRenamed("id", "doc_id")
    old = sharding.Tree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    heavier = sharding.Tree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 3.0))))
    a = sharding.place(keys, F.col("doc_id"), old, "was")
    both = sharding.place(a, F.col("doc_id"), heavier, "now").filter("was <> now").collect()
    assert both and all(r.now >= 4 for r in both)  # only into the region whose weight rose
    grown = sharding.place(sharding.place(keys, F.col("doc_id"), old.grow(), "was"), F.col("doc_id"), old.grow().grow(), "now")
    assert {r.now for r in grown.filter("was <> now").collect()} == {9}


def test_native_plans(spark):
    """The operators asked for as native run no Python."""
    docs = frame(spark)
    talks = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    for df in (sharding.assign(docs), chat.format_pairs(chat.replayed(chat.conversations(talks)))):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


TURNS = "array<struct<turn: bigint, role: string, text: string>>"


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for _, r, t in turns)


def test_preferences(spark):
    u, a, b, s = (0, "user", "hi"), (1, "assistant", "yes é"), (1, "assistant", "no"), (2, None, None)
    cases = [
        ([u, a], [u, b], 1),
        ([u, a], [u, a], 2),
        ([u], [u, a, u, b], 1),
        ([], [u], 0),
        (None, [u, a], 0),
        (None, None, 0),
        ([s, a], [(5, None, None), b], 1),
        ([u, a, u, b], [b, a], 0),
    ]
    rows = spark.createDataFrame([(i, x, y, n, "extra") for i, (x, y, n) in enumerate(cases)], f"id int, chosen {TURNS}, rejected {TURNS}, want int, key string")
    for r in chat.format_pairs(rows).collect():
        x, y, n = cases[r.id]
        x, y = x or [], y or []
        assert r.n_common == n == r.want and r.key == "extra"
        assert r.prompt == render(x[:n])
        for side, rest in (("chosen", x[n:]), ("rejected", y[n:])):
            text = r[f"{side}_completion"]
            assert r.prompt + text == render((x if side == "chosen" else y)[:n] + rest) or side == "rejected"
            assert text == render(rest)
            assert [text[m.start : m.start + m.length] for m in r[f"{side}_mask"]] == [f"{t or ''}<|end|>\n" for _, role, t in rest if role == "assistant"]


def test_preferences_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, [(0, "user", "a")], [(0, "user", "b")], "p", 5, "m", "t")], f"`the.id` int, chosen {TURNS}, rejected {TURNS}, prompt string, n_common int, chosen_mask string, n string")
    out = chat.summary(chat.format_pairs(rows))
    assert out.columns == ["the.id", "prompt", "n_common", "chosen_mask", "n", "n_common_", "prompt_", "chosen_completion", "chosen_mask_", "rejected_completion", "rejected_mask", "chosen_trained", "rejected_trained"]
    r = out.first()
    assert (r.prompt, r.n_common, r.n, r.n_common_, r.prompt_) == ("p", 5, "t", 0, "") and r.chosen_completion == render([(0, "user", "a")])


def test_conversations(spark):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 3, "assistant", "c"), (1, 2, "user", "a"), (2, 0, "user", "x"), (None, 0, "assistant", None), (3, 0, "assistant", "q"), (3, 0, "assistant", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    pairs = {r.conv_id: r for r in chat.replayed(chat.conversations(df)).collect()}
    assert [t.text for t in pairs[1].chosen] == ["a", "b", "a", "c"] and [t.text for t in pairs[1].rejected] == ["a", "b", "a", "b"]
    assert pairs[2].chosen == pairs[2].rejected
    assert [t.text for t in pairs[None].rejected] == [""]
    assert [t.text for t in pairs[3].rejected] == ["q", ""]
    assert chat.conversations(df.limit(0)).count() == 0
