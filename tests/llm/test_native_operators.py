"""Exact dedup, line dedup, decontamination and sharding against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import corpus, empty, frame
from pyspark.sql import functions as F

from tallyforge.llm import queries
from tallyforge.llm.decontaminate import clean_documents, contamination, phrase_matches, proximity_matches
from tallyforge.llm.exact_dedup import drop_copies, exact_dedup
from tallyforge.llm.line_dedup import line_dedup
from tallyforge.llm.ngram_join import one_of_each_group
from tallyforge.llm.quality import good_documents
from tallyforge.llm.sharding import find_splitters, shard_by_bytes

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def words(text):
    return LETTERS.findall(lower(text or ""))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, keep):
    rows = corpus()
    got = exact_dedup(frame(spark, rows), keep=keep, fan_in=3, rounds=2).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    best = {t: pick((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        exact_dedup(frame(spark, rows), keep="first")


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    rows = corpus()
    kept = drop_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t in rows})


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup(spark, least):
    rows = corpus()
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(key(x), ())) >= least and i != min((d for d in h if d is not None), default=None) for x in lines]
        want[i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)] += 1
    got = line_dedup(frame(spark, rows), min_docs=least).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == want
    assert line_dedup(empty(spark)).collect() == []


def phrases(spark, rows):
    texts = [t for _, t in rows if t]
    own = [(i, " ".join(words(t)[2:40])) for i, t in enumerate(texts[:8])]
    own += [(90, None), (91, ""), (92, "TWO three"), (93, "two THREE"), (None, "ab ab ab"), (94, own[0][1]), (95, "never seen words stand here"), (96, "σ ας")]
    return spark.createDataFrame([(i, t, 1) for i, t in own], "item_id long, text string, row int"), own


def test_phrases_and_contamination(spark):
    rows = corpus()
    bench, own = phrases(spark, rows)
    want = Counter()
    for i, t in rows:
        w = words(t)
        hit, items = set(), set()
        for name, text in own:
            p = words(text)
            n = min(13, len(p))
            for s in range(len(p) - n + 1) if p else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == p[s : s + n]:
                        hit |= set(range(at, at + n))
                        if name is not None:
                            items.add(str(name))
        want[i, len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    got = contamination(frame(spark, rows), bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == want
    clean = clean_documents(frame(spark, rows), bench)
    assert clean.columns == frame(spark, rows).columns
    assert clean.count() == sum(n for k, n in want.items() if not k[4])
    none = bench.limit(0)
    assert all(r.n_hit == 0 and not r.contaminated for r in contamination(frame(spark, rows), none).collect())
    assert phrase_matches(empty(spark), bench).collect() == []


def test_proximity(spark):
    docs = frame(spark, [(1, "alpha x x beta y gamma"), (2, "gamma x x x x x x alpha beta"), (3, "beta Gamma ALPHA"), (4, None)])
    asked = spark.createDataFrame([("q", "alpha beta gamma"), ("none", "delta"), ("void", None)], "item_id string, text string")
    got = {(r.item_id, r.doc_id) for r in proximity_matches(docs, asked, within=6).collect()}
    assert got == {("q", 1), ("q", 3)}


def test_splitters_meet_their_shares():
    keys = {k * 7919 % (1 << 40): 1 + k % 5 for k in range(20_000)}
    total = sum(keys.values())
    rounds = []

    def count(ranges):
        rounds.append(len(ranges))
        out = Counter()
        for lo, cell in ranges:
            for k, m in keys.items():
                if lo <= k < lo + 256 * cell:
                    out[lo + (k - lo) // cell * cell] += m
        return out

    shares = [0.1, 0.25, 0.5, 0.9]
    bounds = find_splitters(count, total, shares, 256, 40)
    for share, bound in zip(shares, bounds):
        assert abs(sum(m for k, m in keys.items() if k < bound) - share * total) <= 40
    assert 1 < len(rounds) < 9


def test_shards(spark):
    rows = corpus(size=400)
    docs = frame(spark, rows)
    got = shard_by_bytes(docs, shards=6, tolerance=0.01, blocks=4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    homes = defaultdict(set)
    for r in got:
        homes[r.text].add(r.shard)
        assert r.size == len((r.text or "").encode()) + 8
    assert all(len(h) == 1 for h in homes.values())
    load = Counter()
    slots = defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(load) == set(range(6)) and max(load.values()) < 1.1 * sum(load.values()) / 6
    assert shard_by_bytes(empty(spark), shards=6).collect() == []
    hot = frame(spark, [(i, "same text" * 20) for i in range(50)] + [(100 + i, f"text {i} " * 20) for i in range(50)])
    home = {r.shard for r in shard_by_bytes(hot, shards=4).filter(F.col("doc_id") < 50).collect()}
    assert len(home) == 1


AWKWARD = ["whole", "id", "sha", "hash", "kept", "_row", "_sha", "_again", "_text_row", "_score", "stays", "marked", "bad", "n", "score", "group", "first"]


def test_filtering_stages_keep_columns_and_unlinked_rows(spark):
    """Whatever the columns are called; equal or lacking ids lose no row of their own."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "one text of its own that stands here alone"), (1, "quite another text under the very same number"), (2, "a third text nobody copied from anywhere"), (3, text), (None, text + " tail"), (4, text + " end"),
            (None, "nameless words that come twice in this table"), (None, "nameless words that come twice in this table"), (5, None), (None, "")]
    docs = frame(spark, rows).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string"), F.col("text")) for c in AWKWARD})
    marks = lambda df: Counter((r.doc_id, r.text, *(r[c] for c in AWKWARD)) for r in df.collect())
    given = marks(docs)
    phrases = spark.createDataFrame([(1, "a third text nobody copied from anywhere")], "item_id long, text string")
    want = {
        "copies": {(i, t): 1 for i, t in rows if (i, t) not in [(None, "")]},
        "near": {(i, t): 1 for i, t in rows if i not in (4,) and t not in (text + " tail", "")},
        "clean": {**Counter((i, t) for i, t in rows if i != 2)},
        "good": {**Counter(rows)},
    }
    found = {"copies": drop_copies(docs), "near": one_of_each_group(docs), "clean": clean_documents(docs, phrases), "good": good_documents(docs, np.zeros(65, np.float32))}
    for name, df in found.items():
        got = marks(df)
        assert df.columns == docs.columns and got.keys() <= given.keys()
        assert {k[:2]: n for k, n in got.items()} == want[name], name
    lacking = frame(spark, [(None, text), (None, text), (None, text + " tail")])
    assert one_of_each_group(lacking).count() == 1 and good_documents(lacking, np.zeros(65, np.float32), 0.6).count() == 0


def test_shards_query(spark, monkeypatch):
    rows = corpus() + [(2000 + i, "hot text") for i in range(300)] + [(3000, "long " * 200_000)]
    docs = frame(spark, rows)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.op7_sharding(spark, "").collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    shards, homes = defaultdict(list), defaultdict(set)
    for r in got:
        shards[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values()) and shards.keys() <= set(range(24))
    assert all(len(s) == 1 for s in homes.values()) and {r.law for r in got} == {"bytes"}
    plan = shard_by_bytes(docs)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 2  # the rows, and the few rows of the blocks' first slots
    small = shard_by_bytes(docs, shards=3, blocks=1, block_bytes=1000).collect()
    assert all(sorted(r.slot for r in small if r.shard == s) == list(range(sum(r.shard == s for r in small))) for s in range(3))
