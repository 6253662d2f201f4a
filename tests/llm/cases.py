"""Small tables with the awkward rows every operator must take."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id string, key string, score double, size long, items string, gram long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def docs(spark, rows):
    """Documents with further columns named as operators name theirs."""
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", None, 0.5, 1, "y", 3) for i, t in rows], SCHEMA)


def awkward():
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, "Same Text here, twice over and over"),
            (7, "Same Text here, twice over and over"), (7, "Same Text here, twice over and over"), (None, "no id but some words in it"),
            (None, None), (8, LONG), (9, "x" * 5000), (10, "ünïcödé 中文 \x00 text 😀 and words")]


def corpus(seed=5, groups=12, copies=4, words=60):
    """Texts with exact copies and near copies of several strengths."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(rng.randrange(3, words))]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = f"n{rng.randrange(1000)}"
            out.append(" ".join(text))
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]
