"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import ascii_lower, carried, row_hash, whole_text, written

#: What separates words, as a pattern and as characters. Letters of either case are word characters here.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR_CHARS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words_of(text: Column) -> Column:
    """The words of a text as they are written; no words for a null or empty one."""
    inner = F.btrim(text, F.lit(SEPARATOR_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATORS))


def term_of(word: Column) -> Column:
    """What the index is keyed by: a 64-bit hash of the word in lower case, of all scripts. Words equal after A-Z are lower-cased share a term."""
    return F.xxhash64(F.lower(word))


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).withColumn("row", row_hash("text"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``term, doc_id, row, pos`` of all terms, or of those in the column ``term`` of ``terms``, as a written table sorted by term.

    ``row`` hashes the text, so that rows sharing an id stay apart.
    """
    postings = _tokens(docs, id_col, text_col).select("doc_id", "row", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    postings = postings.select("doc_id", "row", "pos", term_of(F.col("word")).alias("term"))
    if terms is not None:
        postings = postings.join(written(terms.select("term").distinct(), "asked"), "term")
    return written(postings.select("term", "doc_id", "row", "pos").sortWithinPartitions("term"), "postings")


def _anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """The words to look up: of every window the two rarest, as rows ``item, at, term, windows``.

    ``windows`` lists the places of each window's rarest words. Windows on the same words share them, so an item needs few.
    """
    placed = items.select("item", F.posexplode("words").alias("at", "word")).withColumn("term", term_of(F.col("word")))
    placed = placed.join(counts, "term", "left").fillna(0, ["n"])
    ranked = placed.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "term", "n"))).alias("places"))
    n = F.size("places")
    need = F.least(n, F.lit(window))
    starts = F.transform(F.sequence(F.lit(0), n - need), lambda s: F.struct(s.alias("from"), F.slice("places", s + 1, need).alias("in")))
    rarest = F.transform(
        starts,
        lambda w: F.transform(F.slice(F.array_sort(F.transform(w["in"], lambda p: F.struct(p["n"].alias("n"), F.xxhash64(p["term"]).alias("tie"), p["at"].alias("at")))), 1, 2), lambda p: p["at"]),
    )
    chosen = ranked.select("item", "places", F.array_distinct(rarest).alias("windows"))
    looked = chosen.select("item", "windows", "places", F.explode(F.array_distinct(F.flatten("windows"))).alias("at"))
    return looked.select("item", "windows", "at", F.get("places", F.col("at"))["term"].alias("term"))


def phrase_matches(docs: DataFrame, phrases: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every document with the exact occurrences of ``window`` consecutive words of the phrases.

    First the phrases' terms are counted over all documents. Then the postings of each window's two rarest terms are
    stored, moved by the term's place in its phrase, and intersected: both must point at the same start. What is left is
    compared word by word with the whole document. A phrase of fewer words, but not none, is one window.

    Returns one row per document row: ``doc_id, row`` (a hash of the text), ``n_words, spans`` (of struct ``item_id, start, length``, one for each
    window that occurs). Nulls have no words; equal ids with other texts stay apart; extra columns are ignored; items that
    repeat or share a text each count, and one without an id is not named. Either table may be empty.
    """
    items = phrases.select(F.col(item_col).cast("string").alias("item"), words_of(ascii_lower(whole_text(item_text_col))).alias("words")).filter(F.size("words") > 0)
    # A phrase is named by its words, so that repeated ids and texts are looked up once each.
    items = items.groupBy("words").agg(F.collect_set("item").alias("names")).withColumn("item", F.sha2(F.array_join("words", " "), 256))
    unnamed = F.array(F.lit(None).cast("string"))
    items = written(items.select("item", F.when(F.size("names") == 0, unnamed).otherwise(F.col("names")).alias("names"), "words"), "phrases")
    terms = written(items.select(F.explode("words").alias("word")).select(term_of(F.col("word")).alias("term")).distinct(), "terms")
    tokens = _tokens(docs, id_col, text_col)
    counts = tokens.select(F.explode(words_of(F.col("text"))).alias("word")).select(term_of(F.col("word")).alias("term"))
    counts = counts.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    anchors = written(_anchors(items, written(counts, "term-counts"), window), "anchors")
    index = build_index(docs, anchors, id_col, text_col)

    lists = index.join(anchors.select("item", "at", "term"), "term").select("doc_id", "row", "item", (F.col("pos") - F.col("at")).alias("start"), "at")
    both = lists.groupBy("doc_id", "row", "item", "start").agg(F.collect_set("at").alias("found"))
    asked = anchors.select("item", "windows").dropDuplicates(["item"]).join(items, "item")
    both = both.join(written(asked, "windows"), "item")
    both = both.filter(F.exists("windows", lambda w: F.size(F.array_except(w, F.col("found"))) == 0))
    aimed = both.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_list(F.struct("names", "start", "words")).alias("aimed"))

    def runs(hit: Column) -> Column:
        """The starts of the windows of one phrase that hold, word by word."""
        size = F.size(hit["words"])
        need = F.least(size, F.lit(window))
        same = F.transform(hit["words"], lambda w, i: ascii_lower(F.get("words", hit["start"] + i)).eqNullSafe(w))
        starts = F.filter(F.sequence(F.lit(0), size - need), lambda s: F.forall(F.slice(same, s + 1, need), lambda x: x))
        return F.flatten(F.transform(starts, lambda s: F.transform(hit["names"], lambda name: F.struct(name.alias("item_id"), (hit["start"] + s).alias("start"), need.alias("length")))))

    out = tokens.join(aimed, tokens["doc_id"].eqNullSafe(aimed["_id"]) & (tokens["row"] == aimed["_row"]), "left").withColumn("words", words_of(F.col("text")))
    none = F.array().cast("array<struct<item_id:string,start:int,length:int>>")
    spans = F.coalesce(F.flatten(F.transform("aimed", runs)), none)
    # As a generator's output the spans are made once a row; a filter on them above cannot repeat the split within each comparison.
    return out.select("doc_id", "row", F.inline(F.array(F.struct(F.size("words").cast("long").alias("n_words"), spans.alias("spans")))))


def contamination(docs: DataFrame, phrases: DataFrame, window: int = 13, hit_share: int = 20, **columns: str) -> DataFrame:
    """Per document row: ``doc_id, row, n_words, n_hit, items, contaminated, spans``; contaminated when a word is hit and ``hit_share * n_hit >= n_words``."""
    found = phrase_matches(docs, phrases, window, **columns)
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    found = found.withColumns({"n_hit": F.size(F.array_distinct(places)).cast("long"), "items": F.array_sort(F.array_compact(F.array_distinct(F.transform("spans", lambda s: s["item_id"]))))})
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(hit_share) * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, phrases: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = contamination(docs, phrases, **options).filter("contaminated").select(F.col("doc_id").alias("bad"), F.col("row").alias("bad_hash")).distinct()
    rows = carried(docs, id=F.col(id_col), hash=F.xxhash64(whole_text(text_col)))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad")) & (F.col("hash") == F.col("bad_hash")), "left_anti").select("whole.*")


def proximity_matches(docs: DataFrame, phrases: DataFrame, within: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Places where all distinct terms of a phrase stand within ``within`` words, in any order, around its rarest term.
    Terms are compared in lower case.

    Rows ``item_id, doc_id, anchor`` (the word position of the rarest term). Each list is cut into blocks of ``within``
    words, and only neighbouring blocks meet. A phrase with more distinct terms than ``within`` has no match.
    """
    items = phrases.select(F.col(item_col).cast("string").alias("item_id"), F.explode(words_of(whole_text(item_text_col))).alias("word"))
    items = items.select("item_id", term_of(F.col("word")).alias("term")).distinct()
    index = build_index(docs, items, id_col, text_col)
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = items.join(counts, "term", "left").fillna(0, ["n"])
    sizes = terms.groupBy("item_id").agg(F.min_by("term", F.struct("n", "term")).alias("rarest"), F.count(F.lit(1)).alias("need"))
    doc = ["doc_id", "row"]
    near = index.withColumn("block", F.floor(F.col("pos") / within))
    anchors = near.join(sizes, near["term"] == sizes["rarest"]).select("item_id", "need", *doc, F.col("pos").alias("anchor"), F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    others = near.join(terms.select("item_id", "term"), "term").select("item_id", "term", *doc, "pos", "block")
    same = [anchors["item_id"] == others["item_id"], anchors["block"] == others["block"], anchors["row"] == others["row"], anchors["doc_id"].eqNullSafe(others["doc_id"]), F.abs(anchors["anchor"] - others["pos"]) < within]
    pairs = anchors.join(others, same).select(anchors["item_id"], "need", anchors["doc_id"], anchors["row"], "anchor", "term", (F.col("pos") - F.col("anchor")).alias("by"))
    # A span of `within` words that holds the anchor starts at one of `within` offsets; every term must fall into the same one.
    spans = pairs.select("*", F.explode(F.sequence(F.greatest(F.col("by") - within + 1, F.lit(1 - within)), F.least(F.col("by"), F.lit(0)))).alias("from"))
    full = spans.groupBy("item_id", "need", *doc, "anchor", "from").agg(F.size(F.collect_set("term")).alias("held")).filter("held = need")
    return full.select("item_id", "doc_id", "row", "anchor").distinct().drop("row")
