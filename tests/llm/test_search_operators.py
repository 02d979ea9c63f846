"""Fingerprints, ranked search and spelling variants against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from helpers import corpus, empty, frame
from pyspark.sql import functions as F

from tallyforge.llm.fingerprints import as_text, containment, distinct_shingles, fingerprint, fingerprint_edits, from_text, merge_fingerprints, resemblance
from tallyforge.llm.lexical_search import search, terms_of
from tallyforge.llm.spelling import Trie, _moves, count_words, near, near_words, spelling_variants

WORD, TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LONG = [(700, "word " * 200_000), (701, "longtoken" * 100_000), (702, " " * 500_000)]
CLASHING = ["row", "chunk", "copy", "next", "sketch", "head", "target", "key", "at", "item", "score", "rank", "term", "n", "df", "places", "word", "form", "counts", "length"]


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def clashing(spark, rows):
    return frame(spark, rows).drop("row", "key").withColumns({c: F.lit("x") for c in CLASHING})


def hashes(text, k):
    words = [""] * 4 + WORD.findall(lower(text))
    return sorted({int(hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:15], 16) for i in range(len(words) - 4)})[:k]


def alike(a, b, k):
    union = sorted({*a, *b})[:k]
    return len({*union} & {*a} & {*b}) / len(union) if union else 1.0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_of_edits(spark, parts):
    k = 16
    rows = [(i, t) for i, t in corpus() + LONG if i != 905 and i is not None] + [(None, "no id here")]
    texts = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for (i, t), (_, following) in zip(texts, texts[1:] + texts[:1]):
        t, following = t or "", following or ""
        m = len(t) // 3
        want[i] = (len(t), t[: len(t) - m] + following[:m], hashes(t, k), hashes(following, k))
    got = {r.doc_id: r for r in fingerprint_edits(clashing(spark, rows), k=k, parts=parts).collect()}
    assert got.keys() == want.keys()
    for i, (n, edited, own, following) in want.items():
        assert (got[i].n_chars, got[i].edited, got[i].sketch, got[i].next_sketch) == (n, edited, own, following)
        assert got[i].edited_sketch == hashes(edited, k)
    assert fingerprint_edits(empty(spark)).collect() == []


def test_repeated_ids_stand_in_a_fixed_order(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other words stand here now"), (4, "last")]
    got = fingerprint_edits(frame(spark, rows), parts=4).collect()
    assert Counter(r.doc_id for r in got) == {5: 3, 4: 1}
    assert [r.edited for r in got if r.doc_id == 4] and len(fingerprint_edits(frame(spark, rows[:1]), parts=4).collect()) == 1


def test_estimates_follow_the_sets(spark):
    k, draw = 64, random.Random(3)
    texts = [" ".join(str(draw.randrange(10_000)) for _ in range(n)) for n in (3, 30, 400, 3000)]
    texts += [texts[2] + " " + texts[3], texts[3][: len(texts[3]) // 2], ""]
    pairs = [(a, b) for a in texts for b in texts]
    sketches = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprint(F.col("a"), k=k).alias("x"), fingerprint(F.col("b"), k=k).alias("y"))
    got = sketches.select("a", "b", "x", from_text(as_text(F.col("x"))).alias("again"), distinct_shingles(F.col("x"), k).alias("n"), resemblance(F.col("x"), F.col("y"), k).alias("r"), containment(F.col("x"), F.col("y"), k).alias("c")).collect()
    for r in got:
        a, b = {*hashes(r.a, None)}, {*hashes(r.b, None)}
        assert r.x == r.again == hashes(r.a, k)
        assert r.n == len(a) if len(a) < k else abs(r.n / len(a) - 1) < 0.4
        assert r.r == alike(hashes(r.a, k), hashes(r.b, k), k) and abs(r.r - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
        assert r.c is None or abs(r.c - (len(a & b) / len(a) if a else 1)) < 0.35


def test_parts_merge_to_the_whole(spark):
    k, texts = 32, [t for _, t in corpus() if t]
    rows = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)] + [(9, "")], "key int, text string").select("key", fingerprint(F.col("text"), k=k).alias("sketch"))
    got = {r.key: r.sketch for r in merge_fingerprints(rows, ["key"], k=k).collect()}
    assert got == {j: sorted({h for t in texts[j::3] for h in hashes(t, None)})[:k] for j in range(3)} | {9: []}


def brute_search(docs, items, k):
    terms = [(i, t, Counter(TERM.findall(lower(t)))) for i, t in docs]
    terms = [x for x in terms if x[2]]
    n_docs, length, df = len(terms), sum(x[2].total() for x in terms), Counter(t for x in terms for t in x[2])
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, t, own in terms:
            m = 10 + 90 * own.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * own[w] // (1000 * own[w] + 8 * m)) for w in set(TERM.findall(lower(text))) if w in own)
            scores += [(score, i)] if score > 0 else []
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1]))
        out += [(item, rank, i, s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("width", "first", "block", "bits"), [(1 << 16, 40, 1 << 16, 1 << 20), (16, 1, 1 << 16, 1 << 20), (64, 3, 20, 16)])
def test_search(spark, width, first, block, bits):
    docs = corpus() + LONG
    draw = random.Random(5)
    texts = [t for _, t in docs if t]
    items = [(f"q{i}", " ".join(draw.sample(TERM.findall(draw.choice(texts[:80])), 3))) for i in range(20)]
    items += [("q0", "One two"), ("q1", None), ("q2", "?!"), ("same", "one two three"), ("same", "one two three"), ("none", "zzzz"), (None, "THREE x\x00end")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, item int")
    got = search(clashing(spark, docs), asked, k=10, first=first, width=width, block_terms=block, flags=bits).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == brute_search(docs, items, 10)


def test_search_of_empty_tables(spark):
    asked = spark.createDataFrame([("a", "one")], "item_id string, text string")
    for docs, items in ((empty(spark), asked), (frame(spark, corpus()), asked.limit(0)), (frame(spark, [(1, None)]), asked), (frame(spark, [(1, "two")]), asked)):
        got = search(docs, items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


def test_terms_split_at_every_other_ascii_sign():
    text = "".join(map(chr, range(0x250))) + "Az09 é×"
    assert [t.decode() for t in terms_of(text.encode())] == TERM.findall(lower(text))


def brute_spelling(docs, modulus):
    counted = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counted[run[: h % len(run)] + run[h % len(run) + 1 :] if h % modulus == 0 else run] += 1
    words = {w: n for w, n in counted.items() if len(w) >= 6 and n >= 5}

    def distance_one(a, b):
        edits = {b[:i] + b[i + 1 :] for i in range(len(b))}
        return a != b and (a in edits or b in {a[:i] + a[i + 1 :] for i in range(len(a))} or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)

    out = {}
    for w, n in words.items():
        found = sorted(((-words[x], x) for x in words if abs(len(x) - len(w)) < 2 and distance_one(w, x)))
        fits = found and -found[0][0] >= 5 * n
        out[w] = (found[0][1] if fits else None, n, len(found), -found[0][0] if fits else None)
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return {(w, form, root(w), n, n_near, form_n) for w, (form, n, n_near, form_n) in out.items()}


def spelled(seed):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abcdeéß×") for _ in range(draw.randint(5, 12))) for _ in range(40)]
    rows = []
    for i in range(150):
        own = []
        for _ in range(40):
            w = draw.choice(stems[: draw.choice([3, 10, 40])])
            at, roll = draw.randrange(len(w)), draw.random()
            w = w[:at] + w[at + 1 :] if roll < 0.1 else w[:at] + draw.choice("abß") + w[at:] if roll < 0.2 else w[:at] + "x" + w[at + 1 :] if roll < 0.3 else w
            own.append(w.title() if draw.random() < 0.1 and w.isascii() else w)
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, "chainword " * 20 + "chainwordd " * (3 * (i % 2)) + "chainworddd " * (i % 5 == 0)) for i in range(60)]
    return rows + [(None, "no Ids here " * 6), (3, None), (3, ""), (4, "repeated rowsss " * 7), (4, "repeated rowsss " * 7), (5, "aaaaaaa" * 50_000), (6, "verylongword " * 100_000)]


@pytest.mark.parametrize(("groups", "most"), [(16, 4096), (5, 20), (2, 1)])
def test_spelling_variants(spark, groups, most):
    rows = spelled(2)
    got = spelling_variants(clashing(spark, rows), modulus=7, groups=groups, most=most).collect()
    want = brute_spelling(rows, 7)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(f and r != f for _, f, r, *_ in want)
    assert spelling_variants(empty(spark)).collect() == []


def test_trie_moves_and_edits():
    assert near("abcdef", "abcdeg") and near("abcdef", "abcdefg") and near("babcdef", "abcdef") and not near("abcdef", "abcdef") and not near("abcdef", "badcef")
    for depth in (1, 2, 4):
        moves = {tuple(m) for m in _moves(depth)}
        assert len(moves) == len(_moves(depth))
        want = set()
        for up in range(-1, depth + 1):  # place ``depth`` stands for the groups below the key
            for down in range(-1, depth + 1):
                counts = [(i == up) - (i == down) for i in range(depth + 1)]
                want.add(((up >= 0) - (down >= 0), *counts[:depth]))
        assert moves == want
    words = [("abcabc", 5, (6, 0)), ("abcabd", 6, (5, 1))]
    found = []
    Trie(words, 0).search("abcabc", (6, 0), 0, True, True, found)
    assert found == [("abcabd", 6)]


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        spelling_variants(empty(spark), least_chars=5)
    words = count_words(frame(spark, [(1, "abcdef abcdef abcdeg")]), 6, 1)
    assert {r.word: (r.n_near, r.best) for r in near_words(words).collect()} == {"abcdef": (1, "abcdeg"), "abcdeg": (1, "abcdef")}
