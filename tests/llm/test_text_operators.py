"""The n-gram join, repeated strings, packing, language-model, classifier and language operators against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from helpers import corpus, empty, frame
from test_native_operators import words

from tallyforge.llm.language import identify_languages
from tallyforge.llm.lm_ppm import adaptive_log10, adaptive_scores, build_trie, score_bytes, score_documents
from tallyforge.llm.ngram_join import _roots, connected, least_matches, ngram_join, one_of_each_group
from tallyforge.llm.packing import difference, encoder, near_equal, pack_documents
from tallyforge.llm.queries import op10_lm_scoring
from tallyforge.llm.quality import Ftrl, features, fit_quality, score_quality
from tallyforge.llm.suffix_dedup import remove_repeats

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def grams(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("block", [512, 4])
def test_ngram_join(spark, block):
    rows = corpus()
    sets = [grams(t) for _, t in rows]
    links, parent = Counter(), list(range(len(rows)))
    find = lambda k: k if parent[k] == k else find(parent[k])
    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or 100 * len(x & y) >= 80 * len(x | y):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    groups, copies = defaultdict(list), defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
        copies[sets[k]].append(i)
    want = Counter((i, least(groups[find(k)]), least(copies[sets[k]]), links[k]) for k, (i, _) in enumerate(rows))
    got = ngram_join(frame(spark, rows), block=block).collect()
    assert Counter((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in got) == want
    if block == 512:
        kept = one_of_each_group(frame(spark, rows))
        assert kept.columns == frame(spark, rows).columns
        assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted({least(g) for g in groups.values()} - {None})
        assert ngram_join(empty(spark)).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    needed = least_matches(16, 96, 0.8, 1e-6)
    draw = np.random.RandomState(3)
    matches = (draw.rand(100_000, 96) < 0.8).cumsum(axis=1)[:, 15::16]
    assert (matches >= np.array(needed)).all(axis=1).mean() > 0.9999
    low = (draw.rand(10_000, 96) < 0.3).cumsum(axis=1)[:, 15::16]
    assert (low >= np.array(needed)).all(axis=1).mean() < 0.001


def test_connected(spark):
    chain = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (103, 102), (50, 50)]
    got = dict(tuple(r) for r in connected(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 104)}}
    assert list(_roots(5, np.array([4, 3]), np.array([3, 1]))) == [0, 1, 2, 1, 1]


def brute_repeats(rows, length):
    """Removed bytes of each distinct (id, text), in order of the id, nulls last."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                cover[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        spans = sum(1 for k, c in enumerate(cover) if c and (not k or not cover[k - 1]))
        out[i, t] = (len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("length", [100, 40])
def test_repeats(spark, length):
    rows = corpus() + [(950, "abcdefghij" * 60), (951, "z" * 99), (952, "z" * 100), (953, "z" * 101)]
    want = brute_repeats(rows, length)
    got = remove_repeats(frame(spark, rows), length=length, gram=10).collect()
    shown = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.text_sha256 if r.kept is None else hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert shown == Counter((i, *want[i, t]) for i, t in rows)
    if length == 100:
        assert remove_repeats(empty(spark)).collect() == []
        with pytest.raises(ValueError):
            remove_repeats(frame(spark, rows), length=50)


def test_differencing():
    draw = random.Random(5)
    for _ in range(20):
        sizes = [draw.randint(1, 300) for _ in range(draw.randint(0, 200))]
        for dealt in (difference(sizes, 7), near_equal(sizes, 1024)):
            assert sorted(i for w in dealt for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 1024 for w in near_equal(sizes, 1024))
    sums = [sum(w) for w in ([[8, 7, 6, 5, 4][i] for i in group] for group in difference([8, 7, 6, 5, 4], 2))]
    assert sorted(sums) == [14, 16]  # the textbook case
    assert near_equal([1024] * 3, 1024) and len(near_equal([600] * 4, 1024)) == 4


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    rows = corpus() + [(960, "<|endoftext|> is text"), (961, "  \n\n x‍👩‍👩‍👧 I'll 123")]
    pieces = pack_documents(frame(spark, rows).repartition(3), TOKENIZER, capacity=64, grain=16, group_tokens=3000).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append([*plain.encode(t or "", add_special_tokens=False).ids, 0])
    found, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        found[p.doc_id].append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist(), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, wanted in texts.items():  # a text that repeats has its pieces as often
        flat = sorted((s, tuple(ids), n) for s, ids, n in found[i])
        assert len(flat) % len(wanted) == 0
        whole = flat[:: len(wanted)] if len(wanted) > 1 else flat
        assert [x for _, ids, _ in whole for x in ids] == wanted[0] and all(n == len(wanted[0]) for _, _, n in whole)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 64
    total = sum(p.length for p in pieces)
    assert 64 * len(sequences) < 1.1 * total
    assert pack_documents(empty(spark), TOKENIZER).collect() == []
    encode = encoder(TOKENIZER)
    assert all(encode(t or "").tolist() == plain.encode(t or "", add_special_tokens=False).ids for _, t in rows)


def test_packing_of_added_tokens(spark, monkeypatch):
    """The query and the pipeline's last stage give the ids of the library's default call."""
    import corpus_pipeline
    from tallyforge.llm import queries
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(TOKENIZER)
    texts = ["<|endoftext|> is text", "a <|endoftext|>  b<|endoftext|><|endoftext|>\n", "x <|endoftext|>\n\n y", "<|<|endoftext|>|>", "<|endoftext|", None]
    wanted = {i: [*default.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert wanted[0] == [50256, 318, 2420, 0]
    for sign in " \n\t":  # more white space than the fast library's pattern engine takes
        wanted[len(texts)] = [*default.encode(f"a{sign * 3_000_000}b", add_special_tokens=False).ids, 0]
        texts.append(f"a{sign * 3_000_000}b")
    docs = frame(spark, list(enumerate(texts)))
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    flat = {i: np.array(ids, "<u4") for i, ids in wanted.items()}
    for p in queries.op6_packing(spark, "").collect():
        own = flat[p.doc_id][p.start : p.start + p.length]
        assert (len(own), p.doc_tokens, p.ids_crc32) == (p.length, len(flat[p.doc_id]), zlib.crc32(own.tobytes()))
    found = defaultdict(list)
    for p in corpus_pipeline.packing(spark, docs, "").collect():
        found[p.doc_id].append((p.start, bytes(p.ids)))
    assert {i: b"".join(b for _, b in sorted(parts)) for i, parts in found.items()} == {i: ids.tobytes() for i, ids in flat.items()}


def test_language_model_base_and_trie(spark):
    rows = corpus()
    docs = frame(spark, rows)
    training = docs.filter("doc_id is null or doc_id % 5 <> 0")
    taught = [(t or "").encode() for i, t in rows if i is None or i % 5]
    counts = Counter(w for t in taught for w in t.lower().split())
    counts[None] = len(taught)
    total = sum(counts.values())
    below = np.log10(total + 0.1 * (len(counts) + 1))
    for frequent in (5, 1 << 18):  # few and all words travel; the result is the same
        got = score_documents(docs, training, order=3, contexts=500, frequent=frequent).collect()
        assert len(got) == len(rows)
        base = {}
        for i, t in rows:
            tokens = [*(t or "").encode().lower().split(), None]
            base[i] = (len(tokens), sum(w in counts for w in tokens), sum(np.log10(counts[w] + 0.1) - below for w in tokens))
        for r in got:
            n, known, score = base[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - score) < 1e-6
            assert np.isfinite(r.score) and r.score < 0
    untaught = score_documents(docs, empty(spark), order=2).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in untaught)
    lone = {r.doc_id: r.score for r in untaught}
    assert abs(lone[901] - np.log10(1 / 257)) < 1e-5
    assert score_documents(empty(spark), training, order=2).collect() == []


def test_trie_is_a_distribution():
    """Chances of all symbols sum to 1 after any context, and follow escapes with exclusion."""
    text, order = [b + 2 for b in b"abracadabra"], 2
    past = [0, 0, *text, 1]
    tables = defaultdict(Counter)
    for k in range(order, len(past)):
        for o in range(order + 1):
            tables[o, sum(c << 9 * (o - 1 - j) for j, c in enumerate(past[k - o : k]))][past[k]] += 1
    flat = [(o, c, s, n) for (o, c), own in tables.items() for s, n in own.items()]
    model = build_trie(*map(np.array, zip(*flat)), order)
    logs = (model.steps & 0xFFFFFFFF).astype(np.uint32).view(np.float32).reshape(-1, model.width)
    lacking = 257 - (model.width - 2)
    chances = 10.0 ** logs[:, 1:].astype(float)
    assert np.allclose(chances[:, :-1].sum(1) + lacking * chances[:, -1], 1, atol=1e-4)
    # after "br" only a was seen (twice): 1.5 / 2; after "ra" come c and the end
    assert abs(score_bytes([b"abra"], model)[0] - score_bytes([b"abr"], model)[0]) < 10
    assert len(score_bytes([], model)) == 0 and score_bytes([b"", b"a"], model)[0] < 0


@pytest.mark.parametrize("order", [0, 3, 5])
def test_whole_trie_at_any_broadcast_size(spark, order):
    """However few grams travel, all contexts count: the scores are those of the whole trie in memory."""
    rows = corpus()
    docs = frame(spark, rows)
    tables = defaultdict(Counter)
    for i, t in rows:
        if i is None or i % 5:
            past = [0] * order + [b + 2 for b in (t or "").encode()] + [1]
            for k in range(order, len(past)):
                for o in range(order + 1):
                    tables[o, sum(c << 9 * (o - 1 - j) for j, c in enumerate(past[k - o : k]))][past[k]] += 1
    whole = build_trie(*map(np.array, zip(*[(o, c, s, n) for (o, c), own in tables.items() for s, n in own.items()])), order)
    wanted = sorted(score_bytes([(t or "").encode() for _, t in rows], whole))
    for contexts in (1, 300, 1 << 20):
        got = score_documents(docs, docs.filter("doc_id is null or doc_id % 5 <> 0"), order=order, contexts=contexts).collect()
        assert np.allclose(sorted(r.score for r in got), wanted, rtol=1e-5, atol=1e-4)


def plain_ppm(text, tables, order):
    """The log10 chance of a text by a dictionary of contexts: half a count of each seen symbol escapes, longer contexts' symbols are left out below."""
    past, total = (None,) * order, 0.0
    for symbol in [*text, "end"]:
        left_out = set()
        for o in range(order, -1, -1):
            own = tables.get(past[order - o :])
            fresh = {s: n for s, n in (own or {}).items() if s not in left_out}
            if not fresh:
                continue
            size, off = sum(fresh.values()), 0.5 if len(own) < 257 else 0
            if symbol in fresh:
                total += np.log10((fresh[symbol] - off) / size)
                break
            total += np.log10(off * len(fresh) / size)
            left_out |= own.keys()
        else:
            total -= np.log10(257 - len(left_out))
        past = (*past, symbol)[1:]
    return total


def test_language_model_query(spark):
    """The query's columns over the smallest driver table, against dictionaries."""
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    counts, tables, order = Counter(), defaultdict(Counter), 5
    for i in docs.keys() - held:
        counts.update([*docs[i].lower().split(), None])
        past = [None] * order + [*docs[i], "end"]
        for k in range(order, len(past)):
            for o in range(order + 1):
                tables[tuple(past[k - o : k])][past[k]] += 1
    total, asked = sum(counts.values()), {*sorted(held)[:15], *sorted(docs.keys() - held)[:15]}
    got = op10_lm_scoring(spark, folder).collect()
    assert {r.doc_id for r in got} == docs.keys() and len(got) == len(docs)
    for r in got:
        own = [*docs[r.doc_id].lower().split(), None]
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(own), sum(w in counts for w in own), total) and abs(r.base_score - base) < 1e-6
        if r.doc_id in asked:
            assert abs(r.score - plain_ppm(docs[r.doc_id], tables, order)) < 1e-4 * len(own)


def test_adaptive(spark):
    assert abs(adaptive_log10(b"", 2) - np.log10(1 / 257)) < 1e-12
    assert adaptive_log10(b"ab" * 200) > adaptive_log10(bytes(random.Random(1).choices(range(256), k=400)))
    got = adaptive_scores(frame(spark, [(1, "abab"), (2, None)]), order=2).collect()
    assert {r.doc_id: round(r.score, 9) for r in got} == {1: round(adaptive_log10(b"abab", 2), 9), 2: round(adaptive_log10(b"", 2), 9)}


def test_quality(spark):
    draw = random.Random(2)
    good = lambda: " ".join(draw.choice(["calm", "river", "of", "the", "stone"]) for _ in range(30))
    bad = lambda: " ".join(draw.choice(["BUY!!", "now!!", "click!!"]) for _ in range(30))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)] + [(500, None), (501, ""), (None, good()), (502, "word " * 20_000)]
    labels = spark.createDataFrame([(i, i % 2 if i != 7 else None, 1) for i in range(0, 100)] + [(None, 1, 0), (999, 0, 0)], "doc_id long, quality int, row int")
    weights = fit_quality(frame(spark, rows), labels, dims=1 << 12)
    got = score_quality(frame(spark, rows), weights)
    assert got.columns == [*frame(spark, rows).columns, "_score"]
    scores = {r.doc_id: r._score for r in got.collect()}
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(100, 200))
    assert not fit_quality(frame(spark, rows), labels.limit(0), dims=64).any()
    assert fit_quality(frame(spark, rows), labels, max_rows=10, dims=64).shape == (65,)
    assert score_quality(empty(spark), weights).collect() == []


def test_ftrl_and_features():
    index, value = features("spam spam, spam", 1 << 18)
    assert abs((value**2).sum() - 1) < 1e-9 and (np.diff(index) > 0).all()
    assert set(features("eggs eggs", 1 << 18)[0]) & set(features("spam spam", 1 << 18)[0])
    rows = [(*features(t, 256), y) for t, y in [("a b", 1.0), ("c d", 0.0)] * 30]
    z, n = Ftrl().fit(rows, 256)
    w = Ftrl().weights(z, n)
    assert w[rows[0][0]] @ rows[0][1] + w[-1] > 0 > w[rows[1][0]] @ rows[1][1] + w[-1]


def test_language(spark):
    docs = spark.createDataFrame([("en", "the quick brown fox and the lazy dog"), ("fr", "le renard brun et le chien paresseux"), (None, "no language"), ("en", None)] * 5, "lang string, text string")
    pages = [
        (1, "http://a.example.org/x", '<html lang="en"><body><p>the brown dog and the fox</p></body></html>'),
        (2, "http://b.example.fr/x", "<html lang=fr><body>le chien et le renard</body></html>"),
        (3, "http://b.example.fr/y", "<HTML LANG='fr'><body></body></html>"),  # no text: markup, suffix and host speak
        (4, None, None), (5, "not an address", ""), (None, "http://b.example.fr/z", "<p>le renard</p>"), (2, "http://b.example.fr/x", "<html lang=fr><body>le chien et le renard</body></html>"),
        (6, "http://u@a.example.org:80/", "<script>le renard le chien</script><p>the dog" + " the dog" * 5000),
    ]
    table = spark.createDataFrame([(*p, "zz", "h") for p in pages], "page_id long, url string, html string, lang string, host string")
    got = identify_languages(table, docs).collect()
    named = {r.page_id: r for r in got}
    assert len(got) == len(pages)
    assert [named[k].lang for k in (1, 2, 3, 6)] == ["en", "fr", "fr", "en"]
    assert named[3].declared == "fr" and named[2].suffix == "fr" and named[6].host == "a.example.org" and named[5].host == ""
    assert all(0 < r.confidence <= 1 for r in got)
    assert all(r.lang is None for r in identify_languages(table, docs.limit(0)).collect())
    assert identify_languages(table.limit(0), docs).collect() == []


def test_ids_are_ready_for_crc(spark):
    one = pack_documents(frame(spark, [(1, "a b c")]), TOKENIZER).selectExpr("crc32(ids) AS c", "ids").first()
    assert one.c == zlib.crc32(bytes(one.ids))
