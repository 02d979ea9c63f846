"""Spelling variant grouping: a trie of letter-group counts, searched with a budget of one surplus and one deficit."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import whole_text, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words a task holds before it hands their counts on; words below which a node of the trie is not divided further.
HELD, LEAF = 400_000, 6


def count_words(docs: DataFrame, least_chars: int, least_n: int, modulus: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` as a written table: maximal runs of letters, A-Z lower-cased, of at least so many code points and occurrences.

    With ``modulus`` a run whose crc32 of ``<doc_id>:<run>`` it divides loses one code point (at that crc modulo the run's length) first. A
    null id counts as the empty text there.
    """
    least_run = least_chars

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text")):
                own = Counter(RUN.findall(text.as_py().lower().decode()))  # bytes: A-Z only
                prefix = zlib.crc32(key.as_py() + b":")
                for run, n in own.items():
                    if len(run) < least_run:
                        continue
                    if modulus and (h := zlib.crc32(run.encode(), prefix)) % modulus == 0:
                        cut = h % len(run)
                        run = run[:cut] + run[cut + 1 :]
                        if len(run) < least_chars:
                            continue
                    held[run] += n
                if len(held) >= HELD:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary").alias("key")
    partial = docs.select(key, whole_text(text_col).cast("binary").alias("text")).mapInArrow(count, "word string, n long")
    return written(partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n), "spelling-words")


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The letters of all words in ``groups`` groups of about equal weight, the heaviest group first. An alphabet's counts reach the driver, nothing else."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n")).collect()
    weights, members = [0] * groups, [""] * groups
    for r in sorted(letters, key=lambda r: (-r["n"], r["letter"])):
        at = weights.index(min(weights))
        weights[at] += r["n"]
        members[at] += r["letter"]
    return [members[i] for i in sorted(range(groups), key=lambda i: (-weights[i], members[i])) if members[i]]


def _counts(word: Column, groups: list[str]) -> list[Column]:
    """The levels of the trie: the word's length and its letters of each group."""
    return [F.char_length(word), *[F.char_length(word) - F.char_length(F.translate(word, g, "")) for g in groups]]


def _moves(depth: int) -> list[list[int]]:
    """All changes of a length and ``depth`` counts that a surplus and a deficit of at most one each allow. With each its opposite is one too."""
    moves = []
    for up in range(-1, depth):
        for down in range(-1, depth):
            if up == down >= 0:
                continue  # one letter for another of its group: no change
            counts = [(i == up) - (i == down) for i in range(depth)]
            for length in {more - less for more in ({1} if up >= 0 else {0, 1}) for less in ({1} if down >= 0 else {0, 1})}:
                moves.append([length, *counts])
    return moves


def near(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Trie:
    """Words by their successive letter-group counts, from one level on. A leaf holds its words by their first and last three letters."""

    def __init__(self, words: list[tuple[str, int, tuple[int, ...]]], level: int):
        self.children: dict[int, Trie] | None = None
        if len(words) > LEAF and level < len(words[0][2]):
            parts: dict[int, list] = {}
            for w in words:
                parts.setdefault(w[2][level], []).append(w)
            self.children = {count: Trie(part, level + 1) for count, part in parts.items()}
        else:
            self.ends: dict[tuple[bool, str], list[tuple[str, int]]] = {}
            for word, n, _ in words:
                self.ends.setdefault((True, word[:3]), []).append((word, n))
                self.ends.setdefault((False, word[-3:]), []).append((word, n))

    def search(self, word: str, counts: tuple[int, ...], level: int, surplus: bool, deficit: bool, found: list[tuple[str, int]]) -> None:
        """Adds the near words of ``word`` below this node, depth first, with what is left of the budget. One edit leaves the first or the last three letters."""
        if self.children is None:
            for other in self.ends.get((True, word[:3]), ()):
                if near(word, other[0]):
                    found.append(other)
            for other in self.ends.get((False, word[-3:]), ()):
                if other[0][:3] != word[:3] and near(word, other[0]):
                    found.append(other)
            return
        own = counts[level]
        if child := self.children.get(own):
            child.search(word, counts, level + 1, surplus, deficit, found)
        if surplus and (child := self.children.get(own + 1)):
            child.search(word, counts, level + 1, False, deficit, found)
        if deficit and (child := self.children.get(own - 1)):
            child.search(word, counts, level + 1, surplus, False, found)


def _depth(words: DataFrame, levels: int, most: int) -> int:
    """The fewest counts after the length that divide the words into parts of at most ``most``; all of them if none do."""
    for depth in range(1, levels):
        largest = words.groupBy("length", F.slice("counts", 1, depth)).count().agg(F.max("count")).first()[0] or 0
        if largest <= most:
            return depth
    return levels


def near_words(words: DataFrame, groups: int = 16, most: int = 4096) -> DataFrame:
    """``word, n_near, best, best_n``: for each word that has near words their number and the one of largest ``n`` (ties: the smallest in code-point order).

    The top of the trie divides the words: its first levels, as few as leave at most ``most`` words below a node, are the key by which
    words meet. Each word is sent to its own node and, of any two nodes that the budget links, from the lesser to the greater. A task holds the
    trie below one node at a time and walks it for each word sent there, which then counts for both sides; no pair leaves the task, only a
    word's sum and best. Words of at least six code points are expected.
    """
    letters = letter_groups(words, groups)
    levels = _counts(F.col("word"), letters)
    placed = written(words.select("word", "n", levels[0].alias("length"), F.array(*levels[1:]).alias("counts")), "spelling-levels")
    depth = _depth(placed, len(letters), most)
    top = F.concat(F.array("length"), F.slice("counts", 1, depth))
    moves = F.array(*[F.array(*map(F.lit, m)) for m in _moves(depth) if m >= [0] * (depth + 1)])
    path = lambda c: F.array_join(c.cast("array<string>"), ",")
    members = placed.select(path(top).alias("key"), F.lit(0).alias("asks"), "word", "n")
    moved = placed.select("word", "n", F.explode(F.transform(moves, lambda m: F.zip_with(top, m, lambda a, b: a + b))).alias("top"))
    asking = moved.filter(F.array_min("top") >= 0).select(path(F.col("top")).alias("key"), F.lit(1).alias("asks"), "word", "n")
    table = {ord(c): chr(i) for i, g in enumerate(letters) for c in g}
    marks = [chr(i) for i in range(len(letters))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(word: str) -> tuple[int, ...]:
            coded = word.translate(table)
            return tuple(coded.count(m) for m in marks)

        def rows(found: dict[str, list]) -> pa.RecordBatch:
            n_near, best_n, best = zip(*found.values())
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(n_near, pa.int64()), pa.array(best, pa.string()), pa.array([-n for n in best_n], pa.int64())], ["word", "n_near", "best", "best_n"])

        def tell(met: dict[str, list], word: str, other: str, n: int) -> None:
            if word not in met:
                met[word] = [1, -n, other]
            else:
                so_far = met[word]
                so_far[0] += 1
                if (-n, other) < (so_far[1], so_far[2]):
                    so_far[1:] = -n, other

        key, held, trie, there, met = None, [], None, (), {}
        for batch in batches:
            for k, asks, word, n in zip(*[batch.column(c).to_pylist() for c in ("key", "asks", "word", "n")]):
                if k != key:
                    if len(met) >= HELD // 8:
                        yield rows(met)
                        met = {}
                    key, held, trie, there = k, [], None, tuple(map(int, k.split(",")))
                if not asks:
                    held.append((word, n, counts(word)))
                    continue
                if not held:
                    continue
                trie, own, found = trie or Trie(held, depth), counts(word), []
                trie.search(word, own, depth, all(a <= b for a, b in zip(there[1:], own)), all(a >= b for a, b in zip(there[1:], own)), found)
                away = there[1:] != own[:depth] or there[0] != len(word)
                for other, other_n in found:
                    tell(met, word, other, other_n)
                    if away:
                        tell(met, other, word, n)
                if len(met) >= HELD:
                    yield rows(met)
                    met = {}
        if met:
            yield rows(met)

    dealt = members.unionByName(asking).repartition("key").sortWithinPartitions("key", "asks")
    parts = dealt.mapInArrow(walk, "word string, n_near long, best string, best_n long")
    best = F.min_by(F.struct("best", "best_n"), F.struct((-F.col("best_n")).alias("most"), "best"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select("word", "n_near", "top.best", "top.best_n")


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: the last word reached by following forms. Each round doubles the steps taken; forms never turn in a circle."""
    at = written(forms.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        at = written(at.join(step, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "spelling-roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_variants(docs: DataFrame, least_chars: int = 6, least_n: int = 5, ratio: int = 5, modulus: int | None = None, groups: int = 16, most: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the spellings of words that differ by one code point.

    Words are counted over whole texts (``count_words``). A word's form is its near word of largest ``n`` (ties: the smallest in code-point
    order) if that is at least ``ratio`` times the word's own; its root is the last word that forms lead to. ``groups`` and ``most``
    shape the trie and change no result.

    Returns ``word, form, root, n, n_near, form_n``, one row a word. Null texts have no words; null and repeated ids are allowed, and every row
    counts; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    if least_chars < 6:
        raise ValueError("words of fewer than six code points may share neither their first nor their last three")
    words = count_words(docs, least_chars, least_n, modulus, id_col, text_col)
    joined = words.join(near_words(words, groups, most), "word", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    forms = joined.select("word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n"))
    forms = written(forms, "spelling-forms")
    return forms.join(follow(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
