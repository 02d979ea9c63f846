"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import whole_text, written

_LAST = 2**63 - 1
#: Segment bytes a task expands at a time.
_CHUNK = 1 << 23
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from every place on."""
    part, have, total, done = _mixed((data.astype(np.uint64) + np.uint64(1)) * _A), 1, None, 0
    while True:  # hashes of 1, 2, 4, ... bytes; those in the binary form of the size are joined
        if size & have:
            if total is None:
                total, done = part, have
            else:
                n = min(len(total), len(part) - done)
                total, done = _mixed(total[:n] * _A + part[done : done + n]), done + have
        have *= 2
        if have > size:
            return total
        half = have // 2
        part = _mixed(part[: len(part) - half] * _A + part[half:])


def _window_min(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every ``size`` neighbours."""
    have, part = 1, values
    while 2 * have <= size:
        part = np.minimum(part[: len(part) - have], part[have:])
        have *= 2
    n = len(values) - size + 1
    return np.minimum(part[:n], part[size - have : size - have + n])


def seeds(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``length`` bytes by the smallest gram hash they hold.

    Returns the hash of each run, the first window of each run (and the end), and the hashes of all places whose gram is the
    smallest of a window: one that comes twice may repeat within the text. Equal windows have equal hashes, wherever they stand.
    """
    if len(text) < length:
        return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64)
    hashes, width = gram_hashes(np.frombuffer(text, np.uint8), gram), length - gram + 1
    least = _window_min(hashes, width)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
    edge = np.full(width - 1, ~np.uint64(0))
    highest = ~_window_min(np.concatenate([edge, ~least, edge]), width)  # over the windows that hold a place
    return least[first[:-1]].view(np.int64), first, hashes[hashes == highest].view(np.int64)


def repeated_starts(data: np.ndarray, ends: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each place of the joined segments whether the ``length`` bytes from there on are also found at a smaller rank.

    ``ends`` gives each place the end of its segment, ``rank`` its order. An interval is the set of places that begin with one
    string. It starts from a block of ``length / 4`` bytes and grows to the left by a block a level: the places of an
    interval are split by the block before them, which is the last column of the Burrows-Wheeler order, and move there. So
    the levels hold common prefixes of one, two, three and four blocks, in this order; an interval of one place has no
    repeat and is dropped, and the minimum length ends the expansion.
    """
    block = length // 4
    codes = gram_hashes(data, block)
    place = np.flatnonzero(ends[: len(codes)] - np.arange(len(codes)) >= block)
    place = place[place + block <= len(data)]
    interval = np.zeros(len(place), np.uint64)
    for level in range(4):
        if level:
            place, interval = place - block, interval
            inside = place >= 0
            inside[inside] = ends[place[inside]] == ends[place[inside] + block]
            place, interval = place[inside], interval[inside]
        key = _mixed(codes[place] * _A + interval)
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        number = np.cumsum(new) - 1
        many = np.bincount(number, minlength=1)[number] > 1 if len(key) else np.zeros(0, bool)
        place, interval = place[many], number[many].astype(np.uint64)
    found = np.zeros(len(data), bool)
    if len(place):
        order = np.lexsort((rank[place], interval))
        place, interval = place[order], interval[order]
        found[place[1:][interval[1:] == interval[:-1]]] = True
    return found


def _joined(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges, sorted by their start, that touch or overlap become one."""
    top = np.maximum.accumulate(last)
    apart = np.concatenate([[True], first[1:] > top[:-1]])
    return first[apart], top[np.concatenate([np.flatnonzero(apart)[1:] - 1, [len(first) - 1]])]


def _expand(rows: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """Ranges ``(document, start, end)`` that repeat, of the segments ``(document, start, bytes)`` of whole seed groups."""
    own: dict[bytes, tuple[int, int]] = {}
    out = []
    for doc, start, segment in sorted(rows, key=lambda r: r[:2]):
        if segment in own:  # an equal segment stands earlier: all of this one repeats
            out.append((doc, start, start + len(segment)))
        else:
            own[segment] = (doc, start)
    sizes = np.array([len(s) for s in own])
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(own), np.uint8)
    at = np.repeat(np.arange(len(sizes)), sizes)  # segments stand in the order of their documents and starts
    found = repeated_starts(data, cuts[1:][at], np.arange(len(data)), length)
    hits = np.flatnonzero(found)
    if len(hits):
        docs, starts = (np.array(x, np.int64) for x in zip(*own.values()))
        segment = at[hits]
        run = np.concatenate([[True], (np.diff(hits) != 1) | (np.diff(segment) != 0)])
        a, b = hits[run], hits[np.concatenate([np.flatnonzero(run)[1:] - 1, [len(hits) - 1]])]
        shift = starts[segment[run]] - cuts[segment[run]]
        out += zip(docs[segment[run]].tolist(), (a + shift).tolist(), (b + shift + length).tolist())
    return out


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier, in a smaller id or before in the same text.

    All windows of ``length`` bytes are cut into runs by their smallest gram hash; equal windows share it. A seed found in
    one text only cannot repeat, and copies of a text add nothing, so most text stays where it is. The runs of the other
    seeds are sent, with the bytes of their windows, to the seed's task, which expands intervals to the left until
    ``length`` and marks all places of an interval but the earliest. Matches never cross documents; strings are judged on the input.

    Returns one row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes; null where nothing is removed) and
    ``text_sha256`` of the whole text. Null texts are empty. Ids are whole numbers; a null id comes last; rows
    that repeat in id and text are one document; of different texts with one id the one with the smaller hash comes first.
    Other columns are ignored; an empty table gives no rows.
    """
    if length % 4 or not 0 < gram <= length // 4:
        raise ValueError("length must be a multiple of 4, and a gram a quarter of it at most")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    own = own.withColumns({"t": F.xxhash64("text"), "at": F.coalesce("doc_id", F.lit(_LAST))})
    facts = own.select("doc_id", "at", "t", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    firsts = written(facts.filter(F.col("n_bytes") >= length).groupBy("t", "sha").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "first-copies")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, names, again, held = [], [], [], 0
            for t, text in zip(batch.column("t").to_pylist(), batch.column("text")):
                if t in seen:
                    continue
                seen.add(t)
                found, count = np.unique(seeds(text.as_py(), length, gram)[2], return_counts=True)
                keys.append(found)
                again.append(count > 1)
                names.append(np.full(len(found), t))
                held += len(found)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(names)), pa.array(np.concatenate(again))], ["seed", "t", "again"])

    planted = own.filter(F.octet_length("text") >= length).select("t", "text").mapInArrow(plant, "seed long, t long, again boolean")
    shared = planted.groupBy("seed").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.max("again").alias("again"))
    shared = written(shared.filter("low <> high or again").select("seed"), "shared-seeds")
    lists = planted.select("seed", "t").join(shared, "seed").groupBy("t").agg(F.collect_set("seed").alias("seeds"))
    asked = written(lists.join(firsts.drop("n"), "t"), "seed-lists").withColumnsRenamed({"t": "_t", "first": "_at"})
    suspects = own.join(asked, (own["t"] == asked["_t"]) & (own["at"] == asked["_at"])).filter(F.sha2("text", 256) == F.col("sha"))
    suspects = written(suspects.select("at", "t", "text", "seeds").dropDuplicates(["at", "t"]), "suspects")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for at, t, text, wanted in zip(batch.column("at").to_pylist(), batch.column("t").to_pylist(), batch.column("text"), batch.column("seeds")):
                data = text.as_py()
                hashes, first, _ = seeds(data, length, gram)
                use = np.flatnonzero(np.isin(hashes, wanted.values.to_numpy()))
                for k in use.tolist():
                    a, b = int(first[k]), int(first[k + 1]) + length - 1
                    rows.append((int(hashes[k]), at, t, a, data[a:b]))
                    size += b - a
                if size > _CHUNK:
                    yield _segments(rows)
                    rows, size = [], 0
            if rows:
                yield _segments(rows)

    def _segments(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["seed", "at", "t", "start", "bytes"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges(rows: list[tuple]) -> pa.RecordBatch:
            names = {pair: i for i, pair in enumerate(sorted({r[:2] for r in rows}))}
            back = list(names)
            found = _expand([(names[r[:2]], r[2], r[3]) for r in rows], length)
            at, t = zip(*(back[d] for d, _, _ in found)) if found else ((), ())
            _, a, b = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, t, a, b)], ["at", "t", "from", "to"])

        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for seed, at, t, start, data in zip(*(batch.column(c).to_pylist() for c in ("seed", "at", "t", "start", "bytes"))):
                if seed != last and size > _CHUNK:  # only between seeds
                    yield ranges(rows)
                    rows, size = [], 0
                rows.append((at, t, start, data))
                size, last = size + len(data), seed
        if rows:
            yield ranges(rows)

    segments = suspects.mapInArrow(cut, "seed long, at long, t long, start long, bytes binary")
    segments = segments.repartition("seed").sortWithinPartitions("seed")
    ranges = segments.mapInArrow(expand, "at long, t long, from long, to long")
    ranges = ranges.groupBy(F.col("at").alias("_at"), F.col("t").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("ranges"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, removed = [], [], []
            for text, found in zip(batch.column("text"), batch.column("ranges")):
                data, pairs = text.as_py(), found.values
                first, last = _joined(pairs.field("from").to_numpy(), pairs.field("to").to_numpy())
                cuts = [0, *np.stack([first, last], 1).reshape(-1).tolist(), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                spans.append(len(first))
                removed.append(len(data) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("t"), pa.array(spans, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["at", "t", "n_spans", "n_removed", "kept"])

    hit = suspects.drop("seeds").join(ranges, (suspects["at"] == ranges["_at"]) & (suspects["t"] == ranges["_t"])).select("at", "t", "text", "ranges")
    changed = hit.mapInArrow(drop, "at long, t long, n_spans long, n_removed long, kept binary")
    copies = firsts.filter("n > 1").select("t", "sha", "first")
    out = facts.join(copies, ["t", "sha"], "left").join(changed, ["at", "t"], "left")
    copy = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
