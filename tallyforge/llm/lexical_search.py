"""Ranked lexical search: hashed max-sketches bound every document's score, exact scores follow in descending order of the bounds."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import row_hash, whole_text, written

#: Separators become spaces and A-Z a-z; every other byte belongs to a term.
TERM_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: What an impact is counted in within a sketch, and counts a task holds.
STEP, HELD = 16, 400_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def impacts(tf: np.ndarray, n: int, documents: int, length: int) -> np.ndarray:
    """What a document of ``n`` terms gives for ``tf`` occurrences of a term, before the term's weight."""
    m = 100 - 90 + 90 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def term_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, df, n`` as a written table: documents that hold the term, its occurrences; under the empty term those of all terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: Counter, every: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(every), pa.binary()), pa.array([held[t] for t in every], pa.int64()), pa.array(list(every.values()), pa.int64())], ["term", "df", "n"])

        held, every = Counter(), Counter()
        for batch in batches:
            for text in batch.column("text"):
                own = Counter(terms_of(text.as_py()))
                if own:
                    held.update(own.keys())
                    every.update(own)
                    held[b""] += 1
                    every[b""] += own.total()
                if len(held) >= HELD:
                    yield rows(held, every)
                    held, every = Counter(), Counter()
        if held:
            yield rows(held, every)

    partial = docs.select(whole_text(text_col).cast("binary").alias("text")).mapInArrow(count, "term binary, df long, n long")
    return written(partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")), "search-terms")


def build_sketches(docs: DataFrame, documents: int, length: int, width: int = 1 << 16, text_col: str = "text") -> DataFrame:
    """``row, places, peaks`` as a written table: for each document with terms the coordinates its terms fall on and the largest impact on each.

    ``row`` hashes the text; places and peaks are little-endian 16-bit. A peak is the impact in steps of ``STEP``, rounded up, so
    that a weighted sum of peaks is never below the score.
    """
    rows = docs.select(whole_text(text_col).alias("text")).select(row_hash("text").alias("row"), F.col("text").cast("binary").alias("text"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                own = Counter(terms_of(text.as_py()))
                if own:
                    places, at = np.unique(np.fromiter((zlib.crc32(t) % width for t in own), np.int64, len(own)), return_inverse=True)
                    peaks = np.zeros(len(places), np.int64)
                    np.maximum.at(peaks, at, -(-impacts(np.fromiter(own.values(), np.int64, len(own)), own.total(), documents, length) // STEP))
                    out.append((row, places.astype("<u2").tobytes(), peaks.astype("<u2").tobytes()))
            if out:
                row, places, peaks = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(places, pa.binary()), pa.array(peaks, pa.binary())], ["row", "places", "peaks"])

    return written(rows.mapInArrow(fold, "row long, places binary, peaks binary"), "search-sketches")


@dataclass
class Block:
    """Items searched together: their terms one after the other, with weights and places, and where each item starts."""

    items: list[int]
    terms: list[bytes]
    weights: np.ndarray
    starts: np.ndarray
    width: int

    @staticmethod
    def of(rows: pa.Table, documents: int, width: int) -> Block:
        rows = rows.sort_by([("item", "ascending"), ("term", "ascending")])
        items, starts = np.unique(rows["item"].to_numpy(), return_index=True)
        return Block(items.tolist(), rows["term"].to_pylist(), np.array([weight(documents, df) for df in rows["df"].to_pylist()], np.int64), starts, width)

    @property
    def places(self) -> np.ndarray:
        return np.array([zlib.crc32(t) % self.width for t in self.terms], np.int64)


def _bounds(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some documents at a time their rows and an upper bound of each one's score for each item."""
    places, peak = block.places, np.zeros(block.width, np.int64)
    most = max(1, (1 << 21) // len(block.items))
    for batch in batches:
        for a in range(0, len(batch), most):
            part = batch.slice(a, most)
            bounds = np.empty((len(part), len(block.items)), np.int64)
            for i, (at, values) in enumerate(zip(part.column("places"), part.column("peaks"))):
                at = np.frombuffer(at.as_py(), "<u2")
                peak[at] = np.frombuffer(values.as_py(), "<u2")
                bounds[i] = np.add.reduceat(block.weights * peak[places], block.starts)
                peak[at] = 0
            yield part.column("row").to_numpy(), bounds * STEP


def highest_bounds(sketches: DataFrame, block: Block, most: int) -> DataFrame:
    """``item, row, bound``: for each item (its place in the block) the ``most`` documents of highest bound, if above 0."""
    shared = sketches.sparkSession.sparkContext.broadcast(block)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = bounds = None
        for new_rows, new in _bounds(batches, shared.value):
            rows = np.broadcast_to(new_rows[:, None], new.shape) if rows is None else np.concatenate([rows, np.broadcast_to(new_rows[:, None], new.shape)])
            bounds = new if bounds is None else np.concatenate([bounds, new])
            if len(bounds) > most:
                best = np.argpartition(-bounds, most - 1, axis=0)[:most]
                rows, bounds = np.take_along_axis(rows, best, 0), np.take_along_axis(bounds, best, 0)
        if bounds is not None:
            at, item = np.nonzero(bounds)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(rows[at, item]), pa.array(bounds[at, item])], ["item", "row", "bound"])

    found = sketches.mapInArrow(look, "item long, row long, bound long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "row"))
    return found.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def _marked(rows: DataFrame, flags: int) -> np.ndarray:
    """A map of so many flags, set where a row's hash falls. However many rows there are, it stays that small."""
    at = rows.select(F.pmod("row", F.lit(flags)).cast("int").alias("at")).distinct().toArrow()["at"].to_numpy()
    marked = np.zeros(flags, bool)
    marked[at] = True
    return marked


def rows_above(sketches: DataFrame, block: Block, floors: np.ndarray) -> DataFrame:
    """``row``: the documents whose bound for some item reaches the item's floor."""
    shared = sketches.sparkSession.sparkContext.broadcast((block, floors))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floors = shared.value
        for rows, bounds in _bounds(batches, block):
            yield pa.RecordBatch.from_arrays([pa.array(rows[(bounds >= floors).any(axis=1)])], ["row"])

    return sketches.mapInArrow(look, "row long")


def exact_top(docs: DataFrame, block: Block, flags: np.ndarray, documents: int, length: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item, doc_id, row, score, rank``: for each item the ``k`` best of the documents whose text is flagged, by their exact scores above 0."""
    shared = docs.sparkSession.sparkContext.broadcast((block, np.packbits(flags)))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).withColumn("row", row_hash("text"))
    rows = rows.withColumn("at", F.pmod("row", F.lit(len(flags))).cast("int")).withColumn("text", F.col("text").cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, packed = shared.value
        flags, places = np.unpackbits(packed), {t: i for i, t in enumerate(dict.fromkeys(block.terms))}
        slots = np.array([places[t] for t in block.terms], np.int64)
        items, most = np.array(block.items), max(k, (1 << 21) // len(block.items))
        for batch, a in ((b, a) for b in batches for a in range(0, len(b), most)):
            part = batch.slice(a, most)
            part = part.take(pa.array(np.flatnonzero(flags[part.column("at").to_numpy()])))
            scores = np.zeros((len(part), len(block.items)), np.int64)
            for i, text in enumerate(part.column("text")):
                own = Counter(terms_of(text.as_py()))
                known = [t for t in own if t in places]
                if known:
                    given = np.zeros(len(places), np.int64)
                    given[[places[t] for t in known]] = impacts(np.array([own[t] for t in known], np.int64), own.total(), documents, length)
                    scores[i] = np.add.reduceat(block.weights * given[slots], block.starts)
            # Of a part each item needs its best scores only, with all that tie with the last of them.
            last = np.partition(scores, len(part) - k, axis=0)[len(part) - k] if len(part) > k else 0
            at, item = np.nonzero((scores > 0) & (scores >= last))
            yield pa.RecordBatch.from_arrays([pa.array(items[item]), part.column("doc_id").take(pa.array(at)), part.column("row").take(pa.array(at)), pa.array(scores[at, item])], ["item", "doc_id", "row", "score"])

    found = rows.mapInArrow(score, f"item long, doc_id {kind}, row long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _item_terms(items: DataFrame) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(dict.fromkeys(terms_of(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(np.repeat(np.arange(len(terms)), [len(t) for t in terms]))), pa.array([t for own in terms for t in own], pa.binary())], ["item", "term"])

    return items.select("item", F.col("text").cast("binary").alias("text")).mapInArrow(split, "item long, term binary")


def search(docs: DataFrame, items: DataFrame, k: int = 10, first: int = 40, width: int = 1 << 16, flags: int = 1 << 20, block_terms: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents for each item.

    The terms of all documents are counted, and each document's impacts are folded into a stored sketch of coordinatewise maxima. Items
    are searched in blocks of some ``block_terms`` terms. A block's lookups give every document an upper bound; the ``first`` documents
    of highest bound are scored exactly, which gives each item a floor: its ``k``-th best score so far. Every document whose bound
    reaches the floor is scored next, so none that belongs to the result is missed, whatever the sketches are worth. A document's text is
    read again only if its hash is flagged in a map of ``flags`` bits. A crowded map and a small ``width`` (at most 65,536 coordinates) cost time, not results.

    Returns ``item_id, rank, doc_id, score``: ranks count from 1, highest score first, ties by ascending ``doc_id`` (null last), then by a hash of
    the text. Documents with score 0 are not listed. Null texts have no terms; an item without terms has no rows. Items that repeat
    in id and text count once; equal ids with other texts are ranked each for themselves. Repeated documents are listed each. Other
    columns are ignored, whatever their names; empty tables give no rows.
    """
    asked = items.select(F.col(item_col).alias("item_id"), whole_text(item_text_col).alias("text")).distinct()
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()), "search-items")
    statistics = term_statistics(docs, text_col)
    size = statistics.filter(F.col("term") == F.lit(b"")).first()
    documents, length = (size["df"], size["n"]) if size else (0, 0)
    wanted = written(_item_terms(asked).join(statistics.select("term", "df"), "term"), "search-asked")
    blocks = -(-wanted.count() // block_terms)
    sketches = build_sketches(docs, documents, length, width, text_col) if blocks else None
    results = []
    for b in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "term", "df").toArrow()
        if not rows.num_rows:
            continue
        block = Block.of(rows, documents, width)
        tops = exact_top(docs, block, _marked(highest_bounds(sketches, block, first), flags), documents, length, k, id_col, text_col)
        floors = np.ones(len(block.items), np.int64)
        for r in tops.filter(F.col("rank") == k).select("item", "score").collect():  # one row an item of the block
            floors[np.searchsorted(block.items, r["item"])] = r["score"]
        best = exact_top(docs, block, _marked(rows_above(sketches, block, floors), flags), documents, length, k, id_col, text_col)
        results.append(written(best.select("item", "rank", "doc_id", "score"), "search-best"))
    if not results:
        kind = docs.schema[id_col].dataType.simpleString()
        return asked.select("item_id").withColumns({"rank": F.lit(0), "doc_id": F.lit(None).cast(kind), "score": F.lit(0).cast("long")}).limit(0)
    return reduce(DataFrame.unionByName, results).join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
