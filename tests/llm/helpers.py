"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, row long, key long, words string"


def crc(number, modulus):
    return zlib.crc32(("" if number is None else str(number)).encode()) % modulus


def corpus(seed=1, size=60):
    """``(doc_id, text)`` rows: invented sentences, copies, near copies, shared lines and the awkward ones."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeéßñ") for _ in range(draw.randint(1, 7))) for _ in range(400)]
    sentence = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    shared = [sentence(30) for _ in range(3)]
    rows = []
    for i in range(size):
        lines = [sentence(draw.randint(3, 25)) for _ in range(draw.randint(1, 6))]
        if draw.random() < 0.4:
            lines.insert(draw.randrange(len(lines) + 1), draw.choice(shared))
        rows.append((i, "\n".join(lines)))
    for i in range(10):  # copies and near copies
        text = rows[draw.randrange(size)][1]
        rows.append((200 + i, text))
        words = (text + " " + sentence(60)).split(" ")
        base = " ".join(words)
        words[draw.randrange(len(words))] = "other"
        rows += [(300 + i, base), (400 + i, " ".join(words))]
    return rows + [
        (900, None), (901, ""), (902, "\n\n"), (903, "a"), (904, "!? ..."), (905, "One, two THREE four"), (906, "one two three FOUR"),
        (907, "ab " * 3000), (908, " Padded Line here \n\tpadded line HERE"), (909, "É Σ ΑΣ ǅ İK\x00end"), (None, "no id here, but ten words or more of text follow"),
        (None, "no id here, but ten words or more of text follow"), (905, "One, two THREE four"), (910, "x" * 5000),
    ]


def frame(spark, rows):
    """The rows with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 7, 8, "w") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
