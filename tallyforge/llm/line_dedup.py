"""Line deduplication across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import ASCII_SPACE, ascii_lower, row_hash, whole_text, written


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines whose key is found in ``min_docs`` documents or more, except in the smallest document that holds it.

    A key is the line without ASCII white space at both ends, A-Z lower-cased; keys below ``min_chars`` code points never
    count. Lines are exploded with their position and hashed to 128 bits; the documents of a hash are counted with map-side
    combine, the few repeated hashes meet their lines again in a join that adaptive execution can split, and each text is
    put together from the positions that stay.

    Returns one row per input row: ``doc_id, n_lines, n_dropped, kept_text``. A null or empty text is one empty line. Rows
    with equal ids are one document; rows with a null id count as one document that comes last. Other columns are ignored.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).withColumn("row", row_hash("text"))
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(ASCII_SPACE))).filter(F.char_length("line") >= min_chars)
    lines = lines.withColumn("key", ascii_lower(F.col("line")))
    lines = written(lines.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    if min_docs == 2:  # two documents hold a key when its smallest and largest id differ
        found = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("open"))
        repeated = found.filter((F.col("first") != F.col("last")) | (F.col("open") & F.col("first").isNotNull()))
    else:
        held = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        repeated = held.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("one").alias("n")).filter(F.col("n") >= min_docs)
    drops = lines.join(repeated.select("h1", "h2", "first"), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    drops = drops.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("pos").alias("drops"))
    out = rows.join(drops, rows["doc_id"].eqNullSafe(drops["_id"]) & (rows["row"] == drops["_row"]), "left")
    out = out.withColumn("lines", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("drops", F.array().cast("array<int>")))
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")).alias("kept_text"),
    )
