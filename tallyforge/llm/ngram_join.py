"""Similarity join on word n-grams: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import carried, row_hash, whole_text, written

#: A byte table that lower-cases A-Z and turns every other ASCII byte but digits and letters into a blank.
_BLANKS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_HASHES: dict[bytes, int] = {}
_HELD = 1 << 16  # words a worker remembers the hash of; it outlives the stage
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams. A shorter text, if it has a word, is one n-gram."""
    found = text.translate(_BLANKS).split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.empty(len(found), np.uint64)
    for i, word in enumerate(found):
        known = _HASHES.get(word)
        if known is None:
            known = xxhash.xxh64_intdigest(word)
            if len(_HASHES) < _HELD:
                _HASHES[word] = known
        hashes[i] = known
    n = max(1, len(found) - words + 1)
    total = np.full(n, min(words, len(found)), np.uint64)
    for j in range(min(words, len(found))):
        total = (total ^ hashes[j : j + n]) * _MIX
        total ^= total >> np.uint64(32)
    return np.unique(total)


@cache
def _family(size: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(17)
    return draw.randint(0, 2**63, (size, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.randint(0, 2**63, (size, 1), dtype=np.uint64)


def min_hashes(grams: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` smallest values of a set under as many hash functions, 32 bits each."""
    a, b = _family(size)
    least = np.full(size, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(grams), 2048):
        least = np.minimum(least, ((a * grams[at : at + 2048] + b) >> np.uint64(32)).min(axis=1))
    return least.astype("<u4")


@cache
def least_matches(step: int, size: int, threshold: float, tolerance: float) -> tuple[int, ...]:
    """After each ``step`` compared values, the fewest matches with which a pair still may reach the threshold.

    With a flat prior, ``k`` matches of ``m`` make the similarity Beta(k + 1, m - k + 1); the chance that it is ``threshold``
    or more is that of at most ``k`` successes in ``m + 1`` draws at the threshold.
    """
    needed = []
    for m in range(step, size + 1, step):
        chance, k = 0.0, -1
        while chance < tolerance:
            k += 1
            chance += comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        needed.append(k)
    return tuple(needed)


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``size`` places the smallest one it is joined with by the pairs (a, b)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _tasks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each task, where a partition is sorted by the task's keys; a task may reach over batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and (held[-1][keys].to_numpy()[-1] != values[a]).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _in_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Deal each group's rows to tasks ``(group, i, j)`` that each hold two blocks of about ``block`` rows, or one with itself.

    Every pair of a group's rows meets in one task; a task is bounded whatever the group's size. ``m`` is the group's size.
    """
    blocks = F.ceil(F.col("m") / block)
    own = F.pmod(F.xxhash64("node", F.lit(3)), blocks)
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return dealt.drop("other", "m").repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "own", "node")


def _whole_tasks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The sorted rows of a partition in tables of whole tasks: what a batch cuts off waits for the next one."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        values = np.stack([rows[k].to_numpy() for k in keys])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        cut = int(cuts[-1]) if len(cuts) else 0
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None and len(held):
        yield held


def _pairs(bucket: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of all tasks of a table sorted by task and block: within a task's one block, or between its two."""
    place = np.arange(len(bucket))
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    task = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(bucket))[task]
    second = (first + np.bincount(task, weights=own == i).astype(int))[task]
    same = i == j
    low = np.where(same, place + 1, second)
    count = np.where(same | (own == i), np.maximum(end - low, 0), 0)
    a = np.repeat(place, count)
    return a, np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(a))


def connected(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of the edges ``(a, b)`` with the smallest node it is connected to.

    Large and small stars in turn: each step hangs a node's neighbours under the smallest of them. A step is a grouped
    minimum and a join, written to the shared folder; the rounds grow with the logarithm of the longest path.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = edges
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = written(small, "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    every = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return every.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _candidates(classes: DataFrame, bands: int, rows: int, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Edges ``a, b`` that join the classes whose pairs outlast the pruning: each bucket sends a tree, never its pairs."""
    size = bands * rows
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", 4 * rows * b + 1, 4 * rows)) for b in range(bands)])
    placed = classes.select("node", F.posexplode(keys).alias("band", "bucket"))
    full = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = placed.join(full, "bucket").join(classes.select("node", "signature"), "node")
    needed = least_matches(16, size, threshold, tolerance)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_tasks(batches, ["bucket", "i", "j"]):
            signatures = np.frombuffer(b"".join(rows["signature"].to_pylist()), "<u4").reshape(len(rows), size)
            a, b = _pairs(*(rows[c].to_numpy() for c in ("bucket", "own", "i", "j")))
            kept = [(a[:0], b[:0])]
            for at in range(0, len(a), 1 << 16):
                x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                matches = np.zeros(len(x), np.int32)
                for step, least in enumerate(needed):
                    cut = slice(16 * step, 16 * step + 16)
                    matches += (signatures[x, cut] == signatures[y, cut]).sum(1)
                    going = matches >= least
                    x, y, matches = x[going], y[going], matches[going]
                kept.append((x, y))
            x, y = (np.concatenate(side) for side in zip(*kept))
            node, root = rows["node"].to_numpy(), _roots(len(rows), x, y)
            apart = root != np.arange(len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(node[root[apart]])], ["a", "b"])

    dealt = _in_blocks(members.select("bucket", "node", "signature", "m"), "bucket", block)
    return dealt.mapInArrow(prune, "a long, b long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common members of each set on the left and each on the right, by products of incidence blocks."""
    every, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    wanted = np.bincount(place[owner < len(left)], minlength=len(every)).astype(bool) & np.bincount(place[owner >= len(left)], minlength=len(every)).astype(bool)
    number = np.cumsum(wanted) - 1
    use = wanted[place]
    owner, column = owner[use], number[place[use]]
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(wanted.sum()), 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        cells = np.zeros((len(left) + len(right), 4096), np.float32)
        cells[owner[a:b], column[a:b] - first] = 1
        total += cells[: len(left)] @ cells[len(left) :].T
    return total


def _verified(texts: DataFrame, words: int, threshold: float, block: int) -> DataFrame:
    """``node, links, near``: for every class its linked documents in one task, and a class it is linked with (a tree per task)."""
    hundredths = round(threshold * 100)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for task in _tasks(batches, ["root", "i", "j"]):
            sets = [shingles(t, words) for t in task["text"]]
            sizes, copies, node = np.array([len(s) for s in sets]), task["copies"].to_numpy(), task["node"].to_numpy()
            same = task["i"].iat[0] == task["j"].iat[0]
            mine = np.ones(len(task), bool) if same else task["own"].to_numpy() == task["i"].iat[0]
            a, b = np.flatnonzero(mine), np.flatnonzero(mine if same else ~mine)
            if not len(a) or not len(b):
                continue
            common = _overlaps([sets[k] for k in a], [sets[k] for k in b])
            linked = 100 * common >= hundredths * (sizes[a][:, None] + sizes[b][None, :] - common)
            if same:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(task), np.int64)
            links[a] += linked @ copies[b]
            if not same:
                links[b] += linked.T @ copies[a]
            x, y = np.nonzero(linked)
            root = _roots(len(task), a[x], b[y])
            hit = links > 0
            yield pd.DataFrame({"node": node[hit], "links": links[hit], "near": node[root[hit]]})

    return _in_blocks(texts, "root", block).mapInPandas(verify, "node long, links long, near long")


def ngram_links(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4, tolerance: float = 1e-6, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All links of Jaccard similarity ``threshold`` or more between the word n-gram sets of whole documents.

    Documents with equal sets are one class. Classes that share a band of MinHash values meet in tasks of two blocks at
    most, which compare their values 16 at a time and drop a pair once its chance to reach the threshold is below
    ``tolerance``. What is left joins classes into groups; all pairs of a group are then verified exactly on the sets, again
    in blocks. Tasks return counts and trees, never pairs, so the rows stay linear in the documents. A link at the threshold
    misses all bands with a chance of 3e-6 and is pruned with one of about 6 times the tolerance.

    Returns one row per input row: ``doc_id, row, class_id`` (the smallest id joined by links), ``copy_id`` (the smallest id with an
    equal set), ``n_links`` (other documents linked with this one) and ``group``, one number for all rows joined by links, null for a row alone. Documents without words have equal, empty sets.
    ``row`` hashes the text. Ids may repeat or be null; every row counts as a document; null texts are empty; other columns
    are ignored; an empty table gives no rows.
    """
    size = bands * rows
    own = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).select("doc_id", row_hash("text").alias("row"), F.col("text").cast("binary").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column("text")]
            named = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            signed = pa.array([min_hashes(s, size).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), named, signed], ["doc_id", "row", "set", "signature"])

    signed = written(own.mapInArrow(sign, f"doc_id {kind}, row long, set binary, signature binary").withColumn("node", F.monotonically_increasing_id()), "signatures")
    classes = signed.groupBy("set").agg(F.min("node").alias("node"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"))
    firsts = signed.select("node", "signature", F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    classes = written(classes.join(firsts, "node"), "classes")
    groups = written(connected(_candidates(classes, bands, rows, threshold, tolerance, block)), "groups")
    sized = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "root").join(classes.select("node", "copies", "_id", "_row"), "node")
    found = own.join(sized, own["doc_id"].eqNullSafe(sized["_id"]) & (own["row"] == sized["_row"])).select("root", "m", "node", "copies", "text")
    found = found.dropDuplicates(["node"])  # rows repeated in id and text
    linked = written(_verified(found, words, threshold, block), "links")
    joined = connected(linked.select(F.col("node").alias("a"), F.col("near").alias("b")))
    joined = joined.join(classes.select("node", "copy_id"), "node")
    named = joined.join(joined.groupBy("root").agg(F.min("copy_id").alias("class_id")), "root").select("node", "root", "class_id")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    marks = classes.filter("copies > 1").select("node").unionByName(links.select("node")).distinct().join(classes, "node")
    marks = marks.join(links, "node", "left").join(named, "node", "left").select("set", "copies", "copy_id", "links", "class_id", F.coalesce("root", "node").alias("group"))
    out = signed.select("doc_id", "row", "set").join(marks, "set", "left")
    alone: Column = F.col("copies").isNull()
    return out.select(
        "doc_id",
        "row",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("class_id", "copy_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.when(alone, 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        "group",
    )


def ngram_join(docs: DataFrame, words: int = 5, threshold: float = 0.8, **options) -> DataFrame:
    """``ngram_links`` without the groups' numbers: ``doc_id, row, class_id, copy_id, n_links``."""
    return ngram_links(docs, words, threshold, **options).drop("group")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of every group joined by links one row, that with the smallest id.

    A row without an id comes after all others, and rows of one id follow in order of a hash of their texts; one of rows repeated in both
    stays. A row that nothing is linked with stays, whatever ids other rows have.
    """
    verdict = ngram_links(docs, id_col=id_col, text_col=text_col, **options).filter(F.col("group").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "row")).alias("first")
    verdict = verdict.groupBy("group", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    stays = verdict.groupBy("group").agg(first)
    verdict = verdict.join(stays, "group").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")))
    marks = written(verdict.select(F.col("doc_id").alias("marked"), F.col("row").alias("marked_hash"), "stays", "n"), "group-marks")
    rows = carried(docs, id=F.col(id_col), hash=F.xxhash64(whole_text(text_col)))
    same = F.col("id").eqNullSafe(F.col("marked")) & (F.col("hash") == F.col("marked_hash"))
    found = rows.join(marks.filter("not stays or n > 1"), same, "left")
    once, again = found.filter(F.col("stays").isNull()), found.filter("stays").dropDuplicates(["id", "hash"])
    return once.select("whole.*").unionByName(again.select("whole.*"))
