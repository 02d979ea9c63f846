"""Exact deduplication by a tree of digest runs that merge in binomial rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import carried, whole_text, written

DIGEST = ["sha", "check", "n_bytes"]


def _slot(run: Column, home: Column, fan_in: int, level: int) -> Column:
    """Where a digest of ``run`` lives after ``level`` rounds: the low digits come from the digest, the rest still from the run."""
    low = fan_in**level
    return (F.floor(run / low) * low + home % low).cast("long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8, rounds: int = 3) -> DataFrame:
    """Name the row that stays for every group of equal texts.

    Rows are dealt to ``fan_in ** rounds`` runs of (digest, best id, count). In round ``k`` the runs of a block of ``fan_in``
    exchange their digests, each taking one share of the digest range, and merge what they get; after the last round a run
    holds all rows of its share. A hot text is one row per run after the first map side, and stays spread over
    ``fan_in ** (rounds - k)`` runs after round ``k``. The winners of groups of two and more then go down the same tree.
    A digest counts as equal when SHA-256, a second 64-bit hash and the byte length all agree, at every level.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Null texts count as empty. Ids may be
    null or repeat: a null id loses to any other, and of rows with the same id and text one is kept. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    text, runs = whole_text(text_col), fan_in**rounds
    leaves = written(
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        .select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.xxhash64("text").alias("check"), F.octet_length("text").alias("n_bytes"))
        .withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    known = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
    best = F.max if keep == "largest" else F.min
    home, run = F.pmod(F.col("check"), F.lit(runs)), F.pmod(F.xxhash64("row"), F.lit(runs))
    leaves = leaves.select("doc_id", "row", *DIGEST, home.alias("home"), run.alias("slot"))
    leaves = leaves.withColumn("slot", _slot(F.col("slot"), F.col("home"), fan_in, 1))

    def merge(rows: DataFrame, level: int) -> DataFrame:
        """Round ``level``: the runs of a block meet in the slots that share all but one digit."""
        up = rows.withColumn("slot", _slot(F.col("slot"), F.col("home"), fan_in, level))
        return up.groupBy("slot", "home", *DIGEST).agg(best("best").alias("best"), F.sum("n").alias("n"))

    start = leaves.withColumns({"best": F.struct(known.alias("known"), "doc_id", "row"), "n": F.lit(1).cast("long")})
    levels = list(reduce(lambda done, k: [*done, merge(done[-1], k)], range(1, rounds + 1), [start]))[1:]

    won = levels[-1].filter("n > 1").select(*DIGEST, "slot", "best", "n")
    for level in range(rounds, 1, -1):  # down again: from the slots of a level to those of the one below
        lower = levels[level - 2].select(F.col("slot").alias("below"), "home", *DIGEST)
        lower = lower.withColumn("slot", _slot(F.col("below"), F.col("home"), fan_in, level))
        won = lower.join(won, ["slot", *DIGEST]).select(F.col("below").alias("slot"), *DIGEST, "best", "n")
    out = leaves.join(won, ["slot", *DIGEST], "left")
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row is left of each group of equal texts.

    A row is found again by id and text digest; rows repeated in both are cut to one.
    """
    verdict = exact_dedup(docs, id_col, text_col, keep)
    own = verdict.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marks = own.filter("not kept or n > 1").select(F.col("doc_id").alias("marked"), F.col("text_sha256").alias("marked_sha"), "kept")
    rows = carried(docs, id=F.col(id_col), sha=F.sha2(whole_text(text_col), 256))
    found = rows.join(marks, F.col("id").eqNullSafe(F.col("marked")) & (F.col("sha") == F.col("marked_sha")), "left")
    once, again = found.filter(F.col("kept").isNull()), found.filter("kept").dropDuplicates(["id", "sha"])
    return once.select("whole.*").unionByName(again.select("whole.*"))
