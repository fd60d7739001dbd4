import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the operators use themselves.
CLASHES = ["key", "row", "hits", "items", "n_words", "size", "target", "taken", "source_size", "shard", "grown_shard", "slot", "region", "rack", "again", "token", "span", "part", "order", "bucket"]


def corpus(seed=0, n=40):
    """Documents with copies, edited copies, shared passages, repeats, junk, long texts, nulls and repeated rows."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "Straße", "ñandú", "don't", "#tag", "a|b"]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage = text(60)
    base = text(120).split(" ")
    rows = [text(rnd.choice([3, 12, 40, 150])) for _ in range(n)]
    rows += [" ".join(base)] * 3
    for k in range(6):
        edited = list(base)
        for _ in range(k):
            edited[rnd.randrange(len(edited))] = f"edit{rnd.randrange(10**6)}"
        rows.append("  ".join(edited) if k % 2 else " ".join(edited))
    rows += [text(30) + "\n" + passage + " \t" + text(20) for _ in range(3)]
    rows += [passage + " " + passage, "x " * 90, "same line here ok\n" * 30, text(3000), None, "", " \t\n ", "One", "a b c", "A B C", "#*$%&|<>"]
    rows += ["ÀÉ 12 Straße-42 " * 3, rows[0]]
    out = [(i, t, "en", f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(rows)]
    return out + [out[5], out[5], (None, text(40), "en", "src0", 0), (None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
