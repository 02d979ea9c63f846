"""Language-model scoring: word counts as a base, and prediction by partial matching over bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import whole_text, written

#: Codes of the byte model: 0 stands before a text, 1 ends it, a byte ``b`` is ``b + 2``. Nine bits each.
BEFORE, END, BITS = 0, 1, 9
SYMBOLS = 257
#: Text handled at a time, grams made at a time, and counts a task holds before it hands them on.
SLICE_BYTES, RUN, HELD_WORDS, HELD_GRAMS = 1 << 20, 1 << 18, 150_000, 1 << 19


def _codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one run of 16-bit codes, each after ``order`` codes BEFORE and ended by END; and where each one starts."""
    starts = np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], dtype=np.int64) + order + 1)])
    codes = np.zeros(starts[-1], dtype=np.int16)
    for text, start in zip(texts, starts + order):
        codes[start : start + len(text)] = np.frombuffer(text, dtype=np.uint8)
        codes[start : start + len(text)] += 2
    codes[starts[1:] - 1] = END
    return codes, starts


def _grams(codes: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """The packed grams of ``order`` + 1 codes, ``RUN`` at a time, each time with the place of the first."""
    for a in range(0, len(codes) - order, RUN):
        run = codes[a : a + RUN + order].astype(np.int64)
        grams = run[: len(run) - order].copy()
        for j in range(1, order + 1):
            grams <<= BITS
            grams |= run[j : len(run) - order + j]
        yield a, grams


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of keys and counts as one."""
    keys, n = np.concatenate([k for k, _ in runs]), np.concatenate([n for _, n in runs])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE_BYTES``."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= SLICE_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _tagged(tag: bytes, grams: np.ndarray) -> pa.Array:
    """Packed grams as binary keys: the tag and eight bytes."""
    cells = np.empty((len(grams), 9), dtype=np.uint8)
    cells[:, 0] = tag[0]
    cells[:, 1:] = grams.astype(">i8").view(np.uint8).reshape(-1, 8)
    offsets = np.arange(len(grams) + 1, dtype=np.int32) * 9
    return pa.Array.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer(offsets), pa.py_buffer(cells.tobytes())])


def count_corpus(docs: DataFrame, order: int, text_col: str = "text") -> DataFrame:
    """``kind, key, n`` over all documents: words (w), ends (e) and byte grams of ``order`` + 1 codes (g, packed), as a written table.

    Each task counts what it reads and sends one row a key; keys then meet once, with map-side combine before.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys: pa.Array, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64())], ["key", "n"])

        words: Counter = Counter()
        runs, waiting, ends = [], 0, 0
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            ends += len(texts)
            for a, b in _slices(texts):
                for text in texts[a:b]:
                    words.update(text.lower().split())
                if len(words) >= HELD_WORDS:
                    yield rows(pa.array([b"w" + w for w in words], pa.binary()), list(words.values()))
                    words = Counter()
                for _, grams in _grams(_codes(texts[a:b], order)[0], order):
                    runs.append(np.unique(grams[(grams & ((1 << BITS) - 1)) != BEFORE], return_counts=True))
                    waiting += len(runs[-1][0])
                    if waiting >= 2 * HELD_GRAMS:
                        runs = [_merged(runs)]
                        waiting = len(runs[0][0])
                        if waiting >= HELD_GRAMS:
                            yield rows(_tagged(b"g", runs[0][0]), runs[0][1])
                            runs, waiting = [], 0
        if words:
            yield rows(pa.array([b"w" + w for w in words], pa.binary()), list(words.values()))
        if waiting:
            keys, sums = _merged(runs)
            yield rows(_tagged(b"g", keys), sums)
        if ends:
            yield rows(pa.array([b"e"], pa.binary()), [ends])

    partial = docs.select(whole_text(text_col).cast("binary").alias("text")).mapInArrow(count, "key binary, n long")
    kind, rest = F.substring("key", 1, 1), F.expr("substring(key, 2)")
    return written(partial.groupBy("key").agg(F.sum("n").alias("n")).select(kind.cast("string").alias("kind"), rest.alias("key"), "n"), "lm-counts")


def _least_count(rows: DataFrame, column: str, most: int) -> int:
    """The smallest count from which on at most ``most`` rows are left. Only counts and how often they come reach the driver."""
    often = rows.groupBy(column).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc(column)).limit(most + 1).toPandas()
    beyond = np.flatnonzero(np.cumsum(often["m"].to_numpy()) > most)
    return int(often[column].iloc[beyond[0]]) + 1 if len(beyond) else 1


@dataclass
class GramTable:
    """Full grams with the log10 probability of their last symbol: an open-addressed hash table over packed grams."""

    slots: np.ndarray  # places in ``keys``, -1 where empty
    keys: np.ndarray  # grams, and one entry that equals none
    logs: np.ndarray

    @staticmethod
    def of(grams: np.ndarray, logs: np.ndarray) -> GramTable:
        slots = np.full(1 << max(4, (2 * len(grams)).bit_length()), -1, np.int32)
        left, at = np.arange(len(grams), dtype=np.int32), _home(grams, len(slots))
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]
            missed = slots[at] != left
            left, at = left[missed], (at[missed] + 1) & (len(slots) - 1)
        return GramTable(slots, np.append(grams, -1), np.append(logs, np.nan))

    def look_up(self, grams: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram; NaN for those the table lacks."""
        at = _home(grams, len(self.slots))
        place = self.slots[at]
        left = np.flatnonzero((self.keys[place] != grams) & (place >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            place[left] = self.slots[at[left]]
            left = left[(self.keys[place[left]] != grams[left]) & (place[left] >= 0)]
        return self.logs[place]


def _home(grams: np.ndarray, slots: int) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def count_trie(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """The whole trie as two written tables, with exact counts: ``depth, gram, n`` and ``depth, context, total, kinds, met``.

    A gram of a depth is a context of so many codes and the symbol after it, packed. ``met`` is the count that a context's symbols have
    after the context one shorter. No key of these joins and groups has more rows than there are symbols.
    """
    grams = counts.filter("kind = 'g'").select(F.conv(F.hex("key"), 16, 10).cast("long").alias("gram"), "n")
    trie = written(_all_depths(grams, order).groupBy("depth", "gram").agg(F.sum("n").alias("n")), "lm-trie")
    shorter = trie.select((F.col("depth") + 1).alias("depth"), F.col("gram").alias("shorter"), F.col("n").alias("n_up"))
    both = trie.withColumn("shorter", F.expr(f"gram & (shiftleft(1L, {BITS} * depth) - 1)")).join(shorter, ["depth", "shorter"], "left")
    contexts = both.groupBy("depth", F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("n_up").alias("met"))
    return trie, written(contexts, "lm-contexts")


def _all_depths(grams: DataFrame, order: int) -> DataFrame:
    """Each row of full grams once for every depth, with the gram's last ``depth`` + 1 codes."""
    cuts = [F.struct(F.lit(o).alias("depth"), F.col("gram").bitwiseAND(F.lit((1 << BITS * (o + 1)) - 1)).alias("gram")) for o in range(order + 1)]
    return grams.select(F.explode(F.array(*cuts)).alias("c"), *[x for x in grams.columns if x != "gram"]).select("c.*", *[x for x in grams.columns if x != "gram"])


def _discount(kinds: str) -> Column:
    """What each seen symbol gives to the escape: half a count, nothing once all symbols were seen."""
    return F.when(F.col(kinds) >= SYMBOLS, 0.0).otherwise(0.5)


def gram_chances(grams: DataFrame, trie: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """``gram, log``: the log10 probability of each distinct full gram, seen or not, by joins with the trie's tables from depth 0 up.

    ``chance`` holds where no longer context is known; ``rest`` is the share of a symbol in what its context's escape leaves. As
    in ``build_trie``, symbols that longer contexts saw are excluded below.
    """
    up = contexts.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("shorter"), F.col("total").alias("total_up"), F.col("kinds").alias("kinds_up"))
    linked = contexts.withColumn("shorter", F.expr(f"if(depth = 0, null, context & (shiftleft(1L, {BITS} * greatest(depth - 1, 0)) - 1))")).join(up, ["depth", "shorter"], "left").drop("shorter")
    wanted = _all_depths(grams.select("gram"), order).distinct()
    wanted = wanted.join(trie, ["depth", "gram"], "left").withColumn("context", F.shiftright("gram", BITS)).join(linked, ["depth", "context"], "left")
    wanted = written(wanted, "lm-wanted")
    seen = (F.col("n") - _discount("kinds")) / F.col("total")
    escape = _discount("kinds") * F.col("kinds") / F.col("total")
    mass, new, less = F.col("total_up") - F.col("met"), F.col("kinds_up") - F.col("kinds"), _discount("kinds_up")
    onward = F.when(mass > 0, less * new / mass).otherwise(1.0)
    level = None
    for o in range(order + 1):
        here = wanted.filter(F.col("depth") == o)
        if level is None:
            rest, unknown = 1.0 / F.greatest(F.lit(1), SYMBOLS - F.col("kinds")), F.lit(1.0 / SYMBOLS)
        else:
            below = level.select(F.col("gram").alias("shorter"), F.col("n").alias("n_up"), F.col("chance").alias("chance_up"), F.col("rest").alias("rest_up"))
            here = here.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << BITS * o) - 1))).join(below, "shorter")
            rest, unknown = F.when(F.col("n_up").isNotNull(), (F.col("n_up") - less) / mass).otherwise(onward * F.col("rest_up")), F.col("chance_up")
        here = here.withColumn("rest", F.when(F.col("n").isNull() & F.col("total").isNotNull(), rest))
        chance = F.when(F.col("total").isNull(), unknown).when(F.col("n").isNotNull(), seen).otherwise(escape * F.col("rest"))
        level = here.select("gram", "n", chance.alias("chance"), "rest")
    return level.select("gram", F.log10(F.greatest("chance", F.lit(1e-300))).alias("log"))


def frequent_grams(trie: DataFrame, contexts: DataFrame, order: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``most`` most frequent full grams of the trie and their log10 probabilities; only these reach the driver."""
    full = trie.filter(F.col("depth") == order)
    full = full.filter(F.col("n") >= _least_count(full, "n", most)).withColumn("context", F.shiftright("gram", BITS))
    rows = full.join(contexts.filter(F.col("depth") == order).select("context", "total", "kinds"), "context")
    rows = rows.select("gram", F.log10((F.col("n") - _discount("kinds")) / F.col("total")).alias("log")).toArrow()
    return rows["gram"].to_numpy(), rows["log"].to_numpy()


def look_up_texts(texts: list[bytes], order: int, table: GramTable) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each text and its end the sum over the grams in ``table``, and the distinct grams that are not, with how often they come."""
    codes, starts = _codes(texts, order)
    sums = np.zeros(len(texts))
    owners, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, grams in _grams(codes, order):
        found = table.look_up(grams)
        found[(grams & ((1 << BITS) - 1)) == BEFORE] = 0
        owner = np.searchsorted(starts, np.arange(a, a + len(grams)), "right") - 1
        lacking = np.flatnonzero(np.isnan(found))
        owners.append(owner[lacking])
        far.append(grams[lacking])
        found[lacking] = 0
        sums[owner[0] : owner[-1] + 1] += np.bincount(owner - owner[0], weights=found)
    far = np.concatenate(far)
    cuts = np.searchsorted(np.concatenate(owners), np.arange(len(texts) + 1))
    missed, times = zip(*[np.unique(far[a:b], return_counts=True) for a, b in zip(cuts, cuts[1:])])
    return sums, list(missed), list(times)


@dataclass
class ByteModel:
    """A context trie in memory: for each state and symbol column the log10 probability and the next state."""

    order: int
    columns: np.ndarray  # column of each code
    steps: np.ndarray  # states x columns: next state in the upper half of an int64, float32 bits in the lower
    width: int


def build_trie(depth: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, order: int) -> ByteModel:
    """The model in memory, for corpora of which all counts fit; the tests hold the joins against it.

    Probabilities with escapes (half a count for each distinct symbol of a context) and exclusion of what longer contexts saw.
    """
    seen = np.unique(symbol[symbol > BEFORE]).astype(np.int64)
    width = len(seen) + 2  # column 0: BEFORE; the last: any symbol the corpus lacks
    columns = np.full(SYMBOLS + 1, width - 1, dtype=np.int32)
    columns[BEFORE] = 0
    columns[seen] = np.arange(1, len(seen) + 1)
    lacking = SYMBOLS - len(seen)
    names = [np.unique(context[depth == o]) if o else np.zeros(1, np.int64) for o in range(order + 1)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int64)
    steps = np.zeros((int(first[-1]), width), np.int64)
    above = rest_above = None  # counts, and what is left after an escape, of the contexts one shorter
    for o in range(order + 1):
        pick = depth == o
        tally = np.zeros((len(names[o]), width), np.float32)
        np.add.at(tally, (np.searchsorted(names[o], context[pick]), columns[symbol[pick]]), n[pick])
        rest = np.zeros_like(tally)
        up = np.searchsorted(names[o - 1], names[o] & ((1 << BITS * (o - 1)) - 1)) if o else None
        for a in range(0, len(tally), 4096):
            count = tally[a : a + 4096].astype(np.float64)
            here = count > 0
            total, kinds = count.sum(1), here.sum(1)
            off = np.where(kinds >= SYMBOLS, 0.0, 0.5)  # a seen symbol gives half a count to the escape
            escape = np.where(total == 0, 1.0, off * kinds / np.maximum(total, 1))
            if o == 0:
                left = np.full((1, width), 1.0 / max(1, SYMBOLS - kinds[0]))
            else:
                own = up[a : a + 4096]
                fresh = np.where(here, 0, above[own])
                mass, new = fresh.sum(1), (fresh > 0).sum(1)
                less = np.where(new + kinds >= SYMBOLS, 0.0, 0.5)
                onward = np.where(mass > 0, less * new / np.maximum(mass, 1), 1.0)[:, None]
                left = np.where(above[own] > 0, np.maximum(fresh - less[:, None], 0) / np.maximum(mass, 1)[:, None], onward * rest_above[own])
            rest[a : a + 4096] = left
            chance = np.where(here, (count - off[:, None]) / np.maximum(total, 1)[:, None], escape[:, None] * left)
            chance[:, 0] = 1.0
            if lacking == 0:
                chance[:, -1] = 1.0
            logs = np.log10(np.maximum(chance, 1e-300)).astype(np.float32)
            steps[first[o] + a : first[o] + a + len(logs)] = logs.view(np.uint32)
        above, rest_above = tally, rest
    following = np.zeros((1, width), np.int64)  # of the contexts one shorter: the longest known suffix of context and symbol
    for o in range(order + 1):
        if o:
            following = following[np.searchsorted(names[o - 1], names[o] & ((1 << BITS * (o - 1)) - 1))]
        if o < order and len(names[o + 1]):
            prefix = np.searchsorted(names[o], names[o + 1] >> BITS)
            following[prefix, columns[names[o + 1] & ((1 << BITS) - 1)]] = first[o + 1] + np.arange(len(names[o + 1]))
        steps[first[o] : first[o + 1]] |= following << 32
    return ByteModel(order, columns, steps.reshape(-1), width)


def score_bytes(texts: list[bytes], model: ByteModel, lane: int = 512) -> np.ndarray:
    """The log10 probability of each text and its end. Lanes of codes walk the trie side by side, each from ``order`` codes ahead."""
    codes, starts = _codes(texts, model.order)
    columns = model.columns[codes]
    lanes = -(-len(columns) // lane)
    padded = np.zeros(model.order + lanes * lane, np.int32)
    padded[model.order : model.order + len(columns)] = columns
    state, logs = np.zeros(lanes, np.int64), np.empty((lane, lanes), np.float32)
    ahead = np.arange(lanes) * lane
    for t in range(-model.order, lane):
        step = model.steps[state * model.width + padded[ahead + t + model.order]]
        state = step >> 32
        if t >= 0:
            logs[t] = (step & 0xFFFFFFFF).astype(np.uint32).view(np.float32)
    flat = logs.T.reshape(-1)[: len(columns)]
    return np.add.reduceat(flat.astype(np.float64), starts[:-1]) if len(texts) else np.empty(0)


def adaptive_log10(text: bytes, order: int = 5) -> float:
    """The log10 probability of one text and its end by a trie that starts empty and learns each byte after coding it."""
    trie: dict[tuple[int, ...], Counter] = {}
    past: tuple[int, ...] = (BEFORE,) * order
    total = 0.0
    for symbol in [*(b + 2 for b in text), END]:
        excluded: set[int] = set()
        for o in range(order, -1, -1):
            counts = {s: c for s, c in trie.get(past[order - o :], {}).items() if s not in excluded}
            if not counts:
                continue
            size, off = sum(counts.values()), 0.5 if len(excluded) + len(counts) < SYMBOLS else 0.0
            if symbol in counts:
                total += np.log10((counts[symbol] - off) / size)
                break
            total += np.log10(off * len(counts) / size)
            excluded |= counts.keys()
        else:
            total += np.log10(1 / (SYMBOLS - len(excluded)))
        for o in range(order + 1):
            trie.setdefault(past[order - o :], Counter())[symbol] += 1
        past = (*past, symbol)[1:] if order else ()
    return float(total)


def adaptive_scores(docs: DataFrame, order: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: every document coded on its own by an adaptive trie. Null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [adaptive_log10(t.as_py(), order) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(logs, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def score_documents(docs: DataFrame, training: DataFrame, order: int = 5, contexts: int = 1 << 19, frequent: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole documents by a base of word counts and by a byte model, both counted over all of ``training``.

    Words are cut at ASCII white space, A-Z lower-cased, and each document adds one end. ``frequent`` words travel to every
    task; they take most tokens and all hot ones. The other tokens meet their counts in a join, where no word is hot, so
    the base is exact for any vocabulary. The byte model is the whole trie of all contexts of up to ``order`` bytes, as tables.
    Its ``contexts`` most frequent full contexts with their symbol travel in the same way; all other grams of the documents, seen or
    not, meet the tables in joins. Neither number changes a result.

    Returns one row per row of ``docs``: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``. Null texts count
    as empty: one end. With no training rows the base is 0 and every byte is as likely. Ids may be null or repeat; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = count_corpus(training, order, text_col)
    words = counts.filter("kind <> 'g'")
    size = words.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.sum(F.when(F.col("kind") == "e", F.col("n"))).alias("ends")).first()
    tokens, types, ends = size["tokens"] or 0, size["types"] or 0, size["ends"] or 0
    below = np.log10(tokens + 0.1 * (types + 1))
    plain = words.filter("kind = 'w'").select("key", "n")
    top = plain.filter(F.col("n") >= _least_count(plain, "n", frequent)).toArrow()  # at most ``frequent`` rows
    known = top["key"].combine_chunks(), np.log10(top["n"].to_numpy().astype(float) + 0.1) - below
    trie, totals = count_trie(counts, order)
    shared = spark.sparkContext.broadcast((known, frequent_grams(trie, totals, order, contexts), float(np.log10(ends + 0.1) - below)))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, key_logs), frequent_logs, end = shared.value
        table, grams = dict(zip(keys.to_pylist(), key_logs.tolist())), GramTable.of(*frequent_logs)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, ids = [t.as_py() for t in batch.column("text")], batch.column("doc_id")
            for a, b in _slices(texts):
                sums, n, tails = [], [], []
                for text in texts[a:b]:
                    own = text.lower().split()
                    logs = [table.get(w) for w in own]
                    tail = [w for w, x in zip(own, logs) if x is None]
                    sums.append(sum(x for x in logs if x is not None) + end if tail else sum(logs) + end)
                    n.append(len(own) + 1)
                    tails.append(tail)
                found, missed, times = look_up_texts(texts[a:b], order, grams)
                arrays = [ids.slice(a, b - a), pa.array(range(row, row + b - a), pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), pa.array(found, pa.float64()), pa.array(tails, pa.list_(pa.binary())), pa.array(missed, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "n_tokens", "sums", "found", "tail", "missed", "times"])
                row += b - a

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = written(rows.mapInArrow(score, f"doc_id {kind}, row long, n_tokens long, sums double, found double, tail array<binary>, missed array<long>, times array<long>"), "lm-scores")
    tail = scored.select("row", F.explode("tail").alias("key")).join(plain, "key", "left")
    tail = tail.select("row", (F.log10(F.coalesce("n", F.lit(0)) + 0.1) - F.lit(float(below))).alias("rest"), F.when(F.col("n").isNull(), 1).otherwise(0).alias("unknown"), F.lit(0.0).alias("far"))
    missed = scored.select("row", F.explode(F.arrays_zip("missed", "times")).alias("m")).select("row", F.col("m.missed").alias("gram"), F.col("m.times").alias("times"))
    chances = gram_chances(missed.select("gram").distinct(), trie, totals, order)
    far = missed.join(chances, "gram").select("row", F.lit(0.0).alias("rest"), F.lit(0).alias("unknown"), (F.col("times") * F.col("log")).alias("far"))
    rest = tail.unionByName(far).groupBy("row").agg(F.sum("rest").alias("rest"), F.sum("unknown").alias("unknown"), F.sum("far").alias("far"))
    out = scored.drop("tail", "missed", "times").join(rest, "row", "left")
    unknown = F.coalesce("unknown", F.lit(0)) + (0 if ends else 1)
    base, bytes_ = F.col("sums") + F.coalesce("rest", F.lit(0.0)), F.col("found") + F.coalesce("far", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_tokens") - unknown).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), bytes_.alias("score"))
