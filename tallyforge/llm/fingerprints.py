"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import ascii_lower, row_hash, whole_text, written
from tallyforge.llm.decontaminate import words_of

#: A shingle's hash is the first 15 hex digits of its MD5: 60 bits, the same number in any engine, never negative as a long.
DIGITS = 15
SPACE = float(16**DIGITS)


def fingerprint(text: Column, words: int = 5, k: int = 128) -> Column:
    """The ``k`` smallest distinct shingle hashes of a text, ascending, as an array of longs.

    A shingle ends at each word and holds it and the ``words`` - 1 words before it; before the first word stand empty ones, so that a text of
    fewer words has shingles too. Words are compared with A-Z lower-cased. A text without words has an empty fingerprint.
    """
    padded = F.concat(F.array(*[F.lit("")] * (words - 1)), words_of(ascii_lower(text))) if words > 1 else words_of(ascii_lower(text))
    # As an argument of a one-element transform the words are made once, not once a shingle.
    hashes = F.flatten(F.transform(F.array(padded), lambda w: F.transform(_places(F.size(w) - (words - 1)), lambda i: F.substring(F.md5(F.concat_ws(" ", *[F.get(w, i + j) for j in range(words)]).cast("binary")), 1, DIGITS))))
    return F.transform(F.slice(F.sort_array(F.array_distinct(hashes)), 1, k), lambda h: F.conv(h, 16, 10).cast("long"))


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def as_text(sketch: Column) -> Column:
    """A fingerprint as a string: its hashes in hex, ``DIGITS`` digits each."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), DIGITS, "0"))), "")


def from_text(text: Column) -> Column:
    """The fingerprint of its string."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(.{{{DIGITS}}})"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))


def distinct_shingles(sketch: Column, k: int = 128) -> Column:
    """How many distinct shingles were sketched: exact below ``k``, else ``(k - 1)`` over the share of the hash space up to the largest hash kept."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / (F.element_at(sketch, -1) / SPACE))


def union_sketch(a: Column, b: Column, k: int = 128) -> Column:
    """The fingerprint of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Jaccard likeness of two fingerprints: the share of the union's ``k`` smallest hashes that both hold. Two empty ones are alike."""
    union = union_sketch(a, b, k)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """The share of ``a``'s shingles that ``b`` holds, over the union's ``k`` smallest hashes. An empty ``a`` is contained; null where the sample holds none of ``a``."""
    union = union_sketch(a, b, k)
    own = F.size(F.array_intersect(union, a))
    return F.when(F.size(a) == 0, 1.0).when(own > 0, F.size(F.array_intersect(union, F.array_intersect(a, b))) / own)


def merge_fingerprints(rows: DataFrame, keys: list[str], sketch: str = "sketch", k: int = 128) -> DataFrame:
    """One fingerprint per key from those of its parts: ``keys, sketch``. Parts may overlap; a key whose parts are all empty has an empty one.

    Each task sends at most ``k`` hashes a key, so a key of any number of parts is merged by no more rows than there are tasks times ``k``.
    """
    hashes = rows.select(*keys, F.explode_outer(sketch).alias("h")).groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n"))
    ranked = hashes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("h").asc_nulls_last()))).filter(F.col("place") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def _below(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= value))


def _chunk(ids: DataFrame, id_col: str, parts: int) -> Column:
    """A number that never falls with the id, cut at its approximate quantiles into ``parts`` about equal chunks; null ids come first."""
    cuts = ids.agg(F.percentile_approx(id_col, [(i + 1) / parts for i in range(parts - 1)], 10_000).alias("cuts")).first()["cuts"] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.when(F.col(id_col).isNull(), -1).otherwise(0)
    width = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]  # two short searches in place of one long one
    block = _below(F.array(*[F.lit(b[0]) for b in blocks]), F.col(id_col))
    inside = _below(F.get(F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks]), block - 1), F.col(id_col))
    return F.when(F.col(id_col).isNull(), -1).when(block == 0, 0).otherwise((block - 1) * width + inside)


def closed_chunks(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (with ``doc_id`` and a tie ``row``) with ``chunk, copy``: chunks of descending ids, each closed by a copy of the row that follows it.

    The rows of a chunk and, last, the copy stand in order of ``copy``, descending ``doc_id`` and ``row``; after the last row of all follows the
    first. There are at most ``parts`` + 1 chunks, so the table of their first rows is that small whatever the input.
    """
    rows = rows.withColumn("chunk", _chunk(rows.select("doc_id"), "doc_id", parts))
    heads = rows.groupBy("chunk").agg(F.max(F.struct("doc_id", "row")).alias("head"))
    before, every = Window.partitionBy(F.lit(0)).orderBy(F.desc("chunk")), Window.partitionBy(F.lit(0))
    heads = heads.select(F.col("head.doc_id").alias("head_id"), F.col("head.row").alias("head_row"), F.coalesce(F.lag("chunk").over(before), F.min("chunk").over(every)).alias("target"))
    heads = written(heads, "chunk-heads")
    found = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["head_id"]) & (rows["row"] == heads["head_row"]))
    copies = found.select(*[c for c in rows.columns if c != "chunk"], F.col("target").alias("chunk"), F.lit(True).alias("copy"))
    return rows.withColumn("copy", F.lit(False)).unionByName(copies)


def fingerprint_edits(docs: DataFrame, words: int = 5, k: int = 128, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all documents, of each one edited, and of the next one by descending id.

    The edited text has the last third of the document's code points (rounded down) replaced by the first as many of the next document, or
    by all of it where it is shorter. Rows are dealt once, by chunks of ids (``parts``: the session's shuffle partitions), each with its own
    fingerprint, and meet their next one there.

    Returns one row per row: ``doc_id, n_chars, edited, sketch, edited_sketch, next_sketch``. Null texts count as empty. Null ids come last, and
    rows of one id stand in order of a hash of their texts; rows that repeat in both may follow each other in any order. The next row of
    a single row is itself. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).withColumn("row", row_hash("text"))
    placed = closed_chunks(rows, parts).withColumn("sketch", fingerprint(F.col("text"), words, k))
    order = Window.partitionBy("chunk").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("row"))
    met = placed.withColumn("next", F.lead(F.struct("text", "sketch")).over(order)).filter(~F.col("copy"))
    met = met.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("moved", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("moved")).cast("int")), F.substring("next.text", F.lit(1), F.col("moved")))
    met = met.select("doc_id", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    return met.withColumn("edited_sketch", fingerprint(F.col("edited"), words, k))
