"""One query for each operator over the driver tables, and its SQL where SQL can express it."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import crc_mod
from tallyforge.llm.decontaminate import contamination
from tallyforge.llm.exact_dedup import exact_dedup
from tallyforge.llm.fingerprints import as_text, distinct_shingles, fingerprint_edits, resemblance
from tallyforge.llm.language import identify_languages
from tallyforge.llm.lexical_search import search
from tallyforge.llm.line_dedup import line_dedup
from tallyforge.llm.lm_ppm import score_documents
from tallyforge.llm.ngram_join import ngram_join
from tallyforge.llm.packing import pack_documents
from tallyforge.llm.quality import fit_quality, score_quality
from tallyforge.llm.sharding import shard_by_bytes
from tallyforge.llm.spelling import spelling_variants
from tallyforge.llm.suffix_dedup import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lower(text: str) -> str:
    return f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


_WORDS = "regexp_extract_all(" + _lower("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register(
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS s FROM d WHERE len(w) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b, met = x.n AND met = y.n AS same FROM pairs JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * met >= 80 * (x.n + y.n - met)
              UNION ALL SELECT a.doc_id, b.doc_id, true FROM d a JOIN d b ON len(a.w) = 0 AND len(b.w) = 0 AND a.doc_id <> b.doc_id),
    reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a)
    SELECT d.doc_id, (SELECT min(other) FROM reach WHERE reach.doc_id = d.doc_id) AS class_id,
           least(d.doc_id, (SELECT min(b) FROM links WHERE a = d.doc_id AND same)) AS copy_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links
    FROM d
    """
)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), words=5, threshold=0.8).drop("row")


@register(
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
    cut AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
    iw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM cut)),
    dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM cut) WHERE len(w) >= n)),
    hit AS (SELECT doc_id, item, s, dw.n AS n FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
    places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
    """
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@register()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce(F.sha2("kept", 256), F.col("text_sha256")).alias("kept_sha256"))


@register()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, fit_quality(docs, labels.filter(crc_mod("doc_id", 5) != 0)))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


@register()
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@register()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, added_tokens=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register()
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return dealt.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register(
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@register(
    f"""
    WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, i, l[i] AS line, {_lower("trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
              FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM parts)),
    repeated AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    marked AS (SELECT lines.*, first IS NOT NULL AND lines.doc_id <> first AS dropped FROM lines LEFT JOIN repeated ON lines.key = repeated.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"), min_chars=10, min_docs=2)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register()
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, docs.filter(crc_mod("doc_id", 10) != 0))
    return scored.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _padded(text: str) -> str:
    return "list_concat(['', '', '', ''], regexp_extract_all(" + _lower(text) + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"


def _sketch(words: str) -> str:
    """SQL for the 128 smallest hashes, as hex, of the five-word shingles of a padded list of words."""
    return f"list_sort(list_distinct(list_transform(range(1, len({words}) - 3), lambda i: substr(md5(array_to_string({words}[i:i + 4], ' ')), 1, 15))))[1:128]"


def _alike(a: str, b: str) -> str:
    union = f"list_sort(list_distinct(list_concat({a}, {b})))[1:128]"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({union}, list_intersect({a}, {b})))::DOUBLE / len({union}) END"


@register(
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
    n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM d),
    e AS (SELECT doc_id, n_chars, text, next, substr(text, 1, n_chars - n_chars // 3) || substr(next, 1, n_chars // 3) AS edited FROM n),
    w AS (SELECT doc_id, n_chars, edited, {_padded("text")} AS own, {_padded("edited")} AS new, {_padded("next")} AS following FROM e),
    s AS (SELECT doc_id, n_chars, edited, {_sketch("own")} AS a, {_sketch("new")} AS b, {_sketch("following")} AS c FROM w)
    SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
           {_alike("a", "b")} AS near_edited, {_alike("a", "c")} AS near_next,
           CASE WHEN len(a) < 128 THEN len(a)::DOUBLE ELSE 127 / (('0x' || a[128])::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE) END AS n_shingles
    FROM s
    """
)
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_edits(table(spark, sf_dir, "documents"), words=5, k=128)
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )


_TERMS = "regexp_extract_all(" + _lower("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@register(
    f"""
    WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
    size AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d),
    tf AS (SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    met AS (SELECT item_id, doc_id, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))) AS part
            FROM asked JOIN df USING (term) JOIN tf USING (term), size),
    scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM met GROUP BY ALL HAVING sum(part) > 0)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores QUALIFY rank <= 10
    """
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@register(
    f"""
    WITH RECURSIVE step AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs FROM range(256) r(i)),
    runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_lower("coalesce(text, '')")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
    hexed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
    hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
                                            lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, step),
    cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM words, unnest(range(1, length(word) + 1)) r(i)),
    near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
             UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.short = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.short = b.word),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
    forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON walk.at = f.word WHERE f.form IS NOT NULL)
    SELECT forms.word, forms.form, walk.at AS root, forms.n, forms.n_near, forms.form_n
    FROM forms JOIN walk USING (word) JOIN forms f ON walk.at = f.word AND f.form IS NULL
    """
)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), least_chars=6, least_n=5, ratio=5, modulus=199)
