"""The registered queries on the smallest driver tables: against SQL, or against the promises of their results."""

import os
import re
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from oracle import compare, connect  # noqa: E402
from test_native_operators import words  # noqa: E402
from test_text_operators import brute_repeats, grams  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.mark.parametrize("name", ["op1_ngram_join", "op2_decontamination", "op8_exact_dedup", "op9_line_dedup", "op11_fingerprints", "op12_lexical_search", "op13_spelling_variants"])
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None


def test_repeats_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = brute_repeats(docs, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op3_suffix_dedup"](spark, FOLDER).collect()}
    assert got == {i: want[i, t] for i, t in docs}


def test_pipeline(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    after = []
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, FOLDER).cache()
        after.append({r.doc_id for r in table.collect()})
    quality, exact, near, clean, packed = after
    assert exact == {max(i for i in quality if docs[i] == docs[k]) for k in quality}
    sets = {i: grams(docs[i]) for i in exact}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert near == {i for i in exact if i == min(_reach(i, exact, linked))}
    bench = [words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(b[s : s + 13]) for b in bench for s in range(max(1, len(b) - 12)) if b}
    for i in near:
        w = words(docs[i])
        hit = {p for n in {len(x) for x in windows} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for p in range(s, s + n)}
        assert (i in clean) == (not hit or 20 * len(hit) < len(w))
    assert packed == clean and corpus_pipeline.run(spark, FOLDER).count() == table.count()


def _reach(start, ids, linked):
    found, todo = {start}, [start]
    while todo:
        a = todo.pop()
        new = {b for b in ids - found if linked(a, b)}
        found |= new
        todo += new
    return found


MORE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_quality_query_on_held_out_labels(spark):
    docs = [r.doc_id for r in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    rows = QUERIES["op4_quality"](spark, MORE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in held if y == 1], [s for s, y, _ in held if y == 0]
    assert len(good) > 10 and len(bad) > 10
    above = sum((a > b) + 0.5 * (a == b) for a in good for b in bad)
    assert above / (len(good) * len(bad)) > 0.98
    assert sum(p == y for _, y, p in held) / len(held) > 0.95


def test_language_query_against_the_language_in_the_path(spark):
    """The generator names a page's language in its path, which the operator never reads."""
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{MORE}/pages.parquet").collect()}
    rows = QUERIES["op5_language"](spark, MORE).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    truth = {k: found.group(1) for k, u in pages.items() if (found := re.search(r"://[^/]+/(de|en|es|fr)/", u or ""))}
    assert len(truth) > 0.9 * len(pages)
    assert sum(r.lang == truth[r.page_id] for r in rows if r.page_id in truth) / len(truth) > 0.95
    assert sum(r.text_lang == truth[r.page_id] for r in rows if r.page_id in truth) / len(truth) > 0.9
