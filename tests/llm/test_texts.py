"""Operators that read each text by itself, against brute force."""

import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from graphwright.llm import decontam, licenses, lm_score, quality, tokens, words
from tests.llm.common import CLASHES, SCHEMA, corpus, frame, with_clashes

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_quality(text):
    w = SPACES.findall(text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if SPACES.search(line):
            lines += line in seen
            seen.add(line)
    chars = sum(map(len, w))
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    bad, seen = failed, set()
    for n, limit in quality.NGRAM_LIMITS.items():
        had, covered = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in had:
                covered |= set(range(i, i + n))
            had.add(g)
        bad |= sum(len(w[k]) for k in covered) > limit * max(chars, 1)
    again, had = 0, set()
    for line in (text or "").split("\n"):
        if SPACES.search(line):
            again += sum(map(len, SPACES.findall(line))) if line in had else 0
            had.add(line)
    bad |= again > quality.LINE_CHARS_LIMIT * max(chars, 1)
    return len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), lines, len(inside), failed, not bad


def test_quality(spark):
    got = quality.report(frame(spark)).collect()
    want = sorted((r[0] is None, r[0] or 0, *brute_quality(r[1])) for r in corpus())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
    kept = quality.keep_good(with_clashes(frame(spark)))
    assert kept.columns[-len(CLASHES) :] == CLASHES and kept.count() == sum(x[-1] for x in want)
    assert quality.report(frame(spark, [])).count() == 0


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_decontam(text, items):
    w = item_words(text)
    hit, ids = set(), set()
    for item, x in items:
        v = item_words(x)
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                ids |= {str(item)} if item is not None else set()
    return len(w), len(hit), len(ids), sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_decontamination(spark, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", block)
    docs = corpus()
    long = next(r[1] for r in docs if r[1] and len(r[1].split()) == 150)
    items = [(1, " ".join(long.split()[10:40])), (2, long.upper()), (3, "One"), (4, "w1 w2"), (5, None), (6, ""), (7, "--"), (8, docs[-3][1]), (8, "ñandú"), (10, "Straße 42"), (None, "the of"), (11, "w1 " * 20)]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.verdicts(frame(spark), df).collect()
    want = sorted((r[0] is None, r[0] or 0, *brute_decontam(r[1], items)) for r in docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert any(x[-1] for x in want) and not all(x[-1] for x in want)
    clean = decontam.keep_clean(with_clashes(frame(spark)), df)
    assert clean.columns[-len(CLASHES) :] == CLASHES and clean.count() == sum(not x[-1] for x in want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.verdicts(frame(spark), none).filter("contaminated").count() == 0
    assert decontam.verdicts(frame(spark, []), df).count() == 0


def test_decontamination_index_is_bounded():
    """Bytes of the index a word, and common shingles that many windows share."""
    import pickle
    import random

    rnd = random.Random(0)
    text = [f"w{rnd.randrange(5000)}" for _ in range(200_000)]
    items = [" ".join(text[i : i + 400]) for i in range(0, len(text), 400)] + ["the same words in all of them again and again for ever and ever"] * 300
    windows = decontam.Windows([str(i) for i in range(len(items))], pa.array(items))
    wanted = windows.shingles()
    index = decontam.Prefixes(windows, wanted, {n: np.ones(len(x), np.int64) for n, x in wanted.items()})
    assert len(pickle.dumps(index)) < 60 * len(windows.words)
    monkey = decontam.COMPARED
    docs = ["x " + items[3] + " y", "of " + items[-1] + " " + items[-1], "nothing"]
    p = decontam._words(pa.array(docs))
    whole = index.hits(p)
    decontam.COMPARED = 5
    try:
        assert index.hits(p) == whole
    finally:
        decontam.COMPARED = monkey
    assert whole[0] == {0: [{"at": 1, "n": 400}], 1: [{"at": 1, "n": 28}]}
    assert whole[1][0] == {"3"} and len(whole[1][1]) == 300


def brute_tokens(word, scores):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        found = []
        for start in range(end):
            piece = word[start:end]
            s = scores.get(piece, tokens.UNKNOWN if end - start == 1 else None)
            if s is not None:
                found.append((best[start][0] + s, -(best[start][1] + 1)))
        best[end] = (max(found)[0], -max(found)[1])
    return best[-1][1], best[-1][0]


@pytest.mark.parametrize("kept", [1 << 18, 5])
def test_token_counts(spark, kept, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", kept)
    scores = {b"w": -2.0, b"w1": -2.5, b"edit": -3.0, b"1": -1.0, b"12": -1.5, b"the": -1.0, b"x": -1.0, b"\xc3\x9f": -4.0, b"tra": -2.0, b"ame": -2.0, b"same": -2.0}
    model = tokens.Model(scores)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_words, r.n_tokens, round(r.log_prob, 6)) for r in tokens.counts(with_clashes(frame(spark)), model).collect())
    want = []
    for r in corpus():
        found = [brute_tokens(w.encode(), scores) for w in SPACES.findall(r[1] or "")]
        want.append((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(found), sum(n for n, _ in found), round(sum(s for _, s in found), 6)))
    assert got == sorted(want)
    assert tokens.counts(frame(spark, []), model).count() == 0


def test_token_counts_of_many_pieces(spark, monkeypatch):
    """Words that are forgotten and counted again count alike."""
    import random

    rnd = random.Random(5)
    some = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 12))) for _ in range(3000)]
    rows = [(i, " ".join(rnd.choice(some[i * 300 :]) for _ in range(90_000))) for i in range(6)]
    model = tokens.Model({x.encode(): -float(len(x)) / 3 for x in some[::40]} | {b"a": -1.0, b"b": -2.0})
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = []
    for kept in (1 << 18, 100):
        monkeypatch.setattr(tokens, "KEPT", kept)
        found.append(sorted((r.doc_id, r.n_tokens, round(r.log_prob, 4)) for r in tokens.counts(df, model).collect()))
    distinct = sorted({w.encode() for _, t in rows for w in t.split()})
    n = dict(zip(distinct, tokens.count_tokens(distinct, model)[0].tolist(), strict=True))
    assert found[0] == found[1] and [x[1] for x in found[0]] == [sum(n[w.encode()] for w in t.split()) for _, t in rows]


def test_token_count_of_one_long_word(spark):
    df = spark.createDataFrame([(1, "ab" * 3000), (2, "ab" * 400_000 + " ab")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.counts(df, tokens.Model({b"ab": -1.0})).collect()}
    assert got == {1: 3000, 2: 400_001}


def test_long_words_are_cut_as_short_ones(monkeypatch):
    import random

    monkeypatch.setattr(tokens, "STRETCH", 7)
    rnd = random.Random(2)
    model = tokens.Model({bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 9))): -rnd.randrange(1, 12) / 2 for _ in range(200)})
    for _ in range(200):
        w = bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 60)))
        assert tokens.count_long(w, model) == tuple(x[0] for x in tokens.count_tokens([w], model)) == brute_tokens(w, model.scores)


def test_word_hashes():
    """Patterns that cancel out in polynomials, long words and words that differ in their last byte."""

    def thue(a, b, n):
        return a if n == 0 else thue(a, b, n - 1) + thue(b, a, n - 1)

    texts = [thue(a, b, n) for n in range(12) for a, b in ("ab", "ba")] + ["x" * k + "y" for k in range(200)]
    p = words.Piece(pa.array([f"{t} {t}" for t in texts]))
    assert len(set(p.hash.tolist())) == len(texts) and (p.hash[::2] == p.hash[1::2]).all()
    s = words.Sums(words.Piece(pa.array([" ".join(thue("a", "b", 6) + thue("b", "a", 6))])).hash, 8)
    assert len(set(s.of(np.arange(0, 94), 35).tolist())) > 60 and s.of(np.array([0]), 64)[0] != s.of(np.array([64]), 64)[0]


def test_rank_file(tmp_path):
    import base64

    p = tmp_path / "v"
    p.write_bytes(b"\n".join(base64.b64encode(x) + b" %d" % i for i, x in enumerate([b"a", b"b", b"ab"])))
    m = tokens.read_ranks(str(p))
    assert m.scores[b"a"] > m.scores[b"b"] > m.scores[b"ab"] and abs(sum(np.exp(s) for s in m.scores.values()) - 1) < 1e-9


def test_alignment():
    t = "permission is hereby granted free of charge to any person".split()
    assert len(licenses.align(t, t)) == len(t)
    noisy = "x y permission is now hereby granted , free of any charge to each person z".split()
    pairs = licenses.align(noisy, t)
    assert [noisy[b] for _, b in pairs] == [t[a] for a, _ in pairs]
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) == len(t) - 1  # "any" is out of order
    assert licenses.align("a a a".split(), "b c".split()) == []
    assert licenses._increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_license_scan(spark):
    filler = "lorem ipsum the of under to any license dolor " * 40
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, f"{filler}\n{mit}\n{filler}"), (2, filler), (3, mit + "\n" + mit), (4, "Licensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, licenses.TEMPLATES["MIT-text"].replace("without limitation", "w/o any limits").upper()), (8, f"{mit} {filler} {licenses.TEMPLATES['Apache-2.0']}"), (1, f"{filler}\n{mit}\n{filler}"), (None, mit)]
    got = licenses.scan(with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r.doc_id or 0, r.licenses) for r in got) == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (2, ""), (3, "MIT"), (4, "CC-BY-NC-4.0"), (5, ""), (6, ""), (7, "MIT-text"), (8, "Apache-2.0,MIT")]
    spot = next(r for r in got if r.doc_id == 8)
    assert [s.license for s in spot.spans] == ["MIT", "Apache-2.0"] and spot.spans[0].first_word == 0 and spot.spans[0].last_word == 4
    assert next(r for r in got if r.doc_id == 2).best is None
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_scan_finds_every_notice(spark):
    t = licenses.TEMPLATES
    mit, cc, gpl, lgpl = t["MIT"], t["CC-BY-4.0"], t["GPL-3.0"], t["LGPL-3.0"]
    rows = [(1, f"{mit} {mit}"), (2, "\n".join([cc] * 100)), (3, f"{lgpl} {gpl}"), (4, f"{gpl} {lgpl} {gpl}"), (5, f"{t['MIT-text']}\n{t['MIT-text']} x {t['ISC-text']} {mit}"), (6, "by " + " y ".join([mit] * 40))]
    got = {r.doc_id: [(s.license, s.first_word, s.last_word) for s in r.spans] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = {k: len(item_words(x)) for k, x in t.items()}
    ends = lambda *names: [(k, sum(n[x] for x in names[:i]), sum(n[x] for x in names[: i + 1]) - 1) for i, k in enumerate(names)]
    assert got[1] == ends("MIT", "MIT") and got[2] == ends(*["CC-BY-4.0"] * 100)
    assert got[3] == ends("LGPL-3.0", "GPL-3.0") and got[4] == ends("GPL-3.0", "LGPL-3.0", "GPL-3.0")
    assert [x[0] for x in got[5]] == ["MIT-text", "MIT-text", "ISC-text", "MIT"]
    assert got[6] == [("MIT", 1 + 6 * i, 5 + 6 * i) for i in range(40)]


def test_license_scan_tells_versions_and_variants_apart(spark):
    texts = [
        "GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under CC BY-ND 4.0.", "Licensed under CC BY 3.0.", "Licensed under the Apache License, Version 1.1.", "all your rights are not reserved",
        "This work is not licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        licenses.TEMPLATES["GPL-3.0-text"].replace("version 3", "version 2"), licenses.TEMPLATES["GPL-3.0-text"].replace("General", "Lesser General"),
        "Licensed under CC BY-ND 4.0. Licensed under CC BY 4.0.", "licensed under the apache license version 1.1 or the Apache License, Version 2.0",
        licenses.TEMPLATES["GPL-3.0-text"].replace("you can", "anyone can"),
    ]
    want = ["", "", "", "", "", "", "", "", "", "", "LGPL-3.0", "CC-BY-4.0", "", "GPL-3.0-text"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.licenses for r in sorted(got)] == want


def test_license_scan_of_generated_texts(spark):
    """Every notice that was put in is found where it is, and nothing else."""
    import random

    rnd = random.Random(4)
    filler = [f"f{i}" for i in range(50)] + ["of", "the", "to", "under", "license", "software", "version"]
    rows, want = [], []
    for d in range(150):
        words_, spans = [], []
        for _ in range(rnd.randrange(6)):
            words_ += [rnd.choice(filler) for _ in range(rnd.choice([0, 1, 5, 60]))]
            name = rnd.choice(list(licenses.TEMPLATES))
            notice = item_words(licenses.TEMPLATES[name])
            if len(notice) > 20 and rnd.random() < 0.5:  # a word that decides nothing is exchanged
                i = rnd.choice([i for i in range(1, len(notice) - 1) if notice[i] not in licenses.DECIDING.get(name, [])])
                notice[i] = "exchanged"
            spans.append((name, len(words_), len(words_) + len(notice) - 1))
            words_ += notice
        words_ += [rnd.choice(filler[:50]) for _ in range(rnd.choice([0, 3, 80]))]
        rows.append((d, rnd.choice([" ", "\n", ", "]).join(words_)))
        want.append(spans)
    got = {r.doc_id: [(s.license, s.first_word, s.last_word) for s in r.spans] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d in range(150)] == want


def brute_lm(rows, target, size, bigrams):
    """The models again, with counters; bigrams that share a slot are counted together, as documented."""
    ids = {w: i for i, w in enumerate(bigrams.vocabulary.tolist())}
    of = {w: ids[int(words.Piece(pa.array([w])).hash[0])] for r in rows for w in item_words(r[1]) if int(words.Piece(pa.array([w])).hash[0]) in ids}

    def slot(a, b):
        x = bigrams.begin if a == "<s>" else of.get(a, bigrams.rest)
        return int(words.mix(np.array([x * bigrams.size + of.get(b, bigrams.rest)], np.uint64))[0]) & (bigrams.slots - 1)

    toks = [item_words(r[1]) for r in rows]
    vocabulary = dict(sorted(Counter(w for t in toks for w in t).items(), key=lambda x: -x[1])[:size])
    docs = [[w if w in vocabulary else None for w in t] for t in toks]
    models = []
    for own in ([r[0] in target for r in rows], [True] * len(rows)):
        uni, con, big = Counter(), Counter(), Counter()
        for d, o in zip(docs, own, strict=True):
            if o:
                for a, b in zip(["<s>", *d], d, strict=False):
                    uni[b] += 1
                    con[a] += 1
                    big[slot(a, b)] += 1
        models.append((uni, con, big))
    out = []
    for r, d in zip(rows, docs, strict=True):
        mean = []
        for uni, con, big in models:
            n, v = sum(uni.values()), len(vocabulary) + 2
            loss = 0.0
            for a, b in zip(["<s>", *d], d, strict=False):
                single = (uni[b] + lm_score.SMOOTH * max(n, 1) / v) / (n + lm_score.SMOOTH * max(n, 1))
                o = lm_score.ORDER if con[a] else 0.0
                loss -= np.log(o * min(1, big[slot(a, b)] / max(con[a], 1)) + (1 - o) * single)
            mean.append(loss / len(d) if d else None)
        out.append((r[0] is None, r[0] or 0, len(d), *(round(m, 6) if m is not None else None for m in mean)))
    return out


def test_lm_scores(spark):
    rows = corpus()
    n = len({w for r in rows for w in item_words(r[1])})
    good = spark.createDataFrame([(i,) for i in (1, 2, 3, 3, 40, 10**6)] + [(None,)], "doc_id long")
    models = lm_score.train(with_clashes(frame(spark)), good, size=n, slots=1 << 16)
    got = lm_score.score(with_clashes(frame(spark)), models).collect()
    key = lambda r: tuple(-1.0 if x is None else x for x in r)
    have = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, *(round(x, 6) if x is not None else None for x in (r.target_loss, r.background_loss))) for r in got), key=key)
    for a, b in zip(have, sorted(brute_lm(rows, {1, 2, 3, 40}, n, models[0]), key=key), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-5)
    assert all(r.score is None or r.score == pytest.approx(r.target_loss - r.background_loss) for r in got)


def test_lm_counts_are_exact(spark):
    """As many words and bigrams as no fixed table holds: all are counted by themselves."""
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(700))) for i in range(110)]
    rows += [(1000 + i, "u1x0 u1x1 u1x0") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.score(df, lm_score.train(df, df.filter("doc_id = 3").select("doc_id"))).collect()
    toks = {r[0]: item_words(r[1]) for r in rows}
    models = []
    for own in ([3], list(toks)):
        big = Counter(p for d in own for p in zip(["", *toks[d]], toks[d], strict=False))
        models.append((Counter(w for d in own for w in toks[d]), Counter(a for d in own for a in ["", *toks[d]][:-1]), big))
    v = len(models[1][0]) + 2
    assert v > 1 << 16 and len(got) == len(rows)
    for r in got:
        for (uni, con, big), have in zip(models, (r.target_loss, r.background_loss), strict=True):
            n, loss = sum(uni.values()), 0.0
            for a, b in zip(["", *toks[r.doc_id]], toks[r.doc_id], strict=False):
                o = lm_score.ORDER if con[a] else 0.0
                loss -= np.log(o * big[a, b] / max(con[a], 1) + (1 - o) * (uni[b] + lm_score.SMOOTH * n / v) / (n + lm_score.SMOOTH * n))
            assert have == pytest.approx(loss / r.n_tokens, abs=1e-9)


def test_lm_scores_are_the_same_in_many_chunks(spark, monkeypatch):
    """Chunks and parts that share no keys send each other nothing."""
    good = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    found = []
    for chunk in (8 << 20, 400):
        monkeypatch.setattr(lm_score, "CHUNK", chunk)
        rows = lm_score.score(frame(spark), lm_score.train(frame(spark), good)).collect()
        found.append(sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, *(None if x is None else round(x, 9) for x in (r.target_loss, r.background_loss))) for r in rows if r.n_tokens))
    assert found[0] == found[1] and len(found[0]) > 40


def test_lm_separates(spark):
    import random

    rnd = random.Random(3)
    cheap, dear = [f"c{i}" for i in range(60)], [f"d{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(dear if i % 2 else cheap) for _ in range(50))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.filter("doc_id % 2 = 1 and doc_id < 100").select("doc_id")
    held = lm_score.score(df, lm_score.train(df, labels)).filter("doc_id >= 100").collect()
    middle = np.median([r.score for r in held])
    assert np.mean([(r.score < middle) == (r.doc_id % 2 == 1) for r in held]) > 0.95


def test_lm_without_rows(spark):
    none = frame(spark, [])
    models = lm_score.train(none, none.select("doc_id"), size=100, slots=1 << 10)
    assert lm_score.score(none, models).count() == 0
    assert lm_score.score(frame(spark), models).count() == len(corpus())


def test_pieces_and_hashes():
    texts = pa.array(["a b", None, "", "b a", "a  b"])
    p = words.Piece(texts)
    assert p.counts.tolist() == [2, 0, 0, 2, 2] and p.hash[0] == p.hash[3] == p.hash[4] and p.hash[0] != p.hash[1]
    assert p.grams(2)[1][0] == p.grams(2)[1][2] != p.grams(2)[1][1]
    b = pa.record_batch({"text": ["x" * 10] * 7})
    old, words.PIECE = words.PIECE, 25
    try:
        assert [x.num_rows for x in words.pieces(iter([b]), "text")] == [2, 2, 2, 1]
    finally:
        words.PIECE = old
    assert words.fresh(["A", "a_"], "a", "b") == ["a__", "b"]


def test_schema():
    assert SCHEMA.split(", ")[0] == "doc_id long"
