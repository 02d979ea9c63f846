"""Packing token windows by multiway Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import json
from bisect import insort
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import whole_text

PIECES = "doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_LOADED: dict[tuple[str, bool], Callable[[str], np.ndarray]] = {}


def encoder(path: str, added_tokens: bool = False) -> Callable[[str], np.ndarray]:
    """Text to token ids for a byte-level BPE file of the ``tokenizers`` library; no special tokens are added.

    The file's own vocabulary and split pattern are run by the faster ``tiktoken``, whose pattern engine gives up on very long runs of white
    space; such a text goes to ``tokenizers``. With ``added_tokens``, the string of an added token
    of the file is that token's one id, as in the library's default call; without, it is ordinary text. The tests hold the ids against the ``tokenizers`` library.
    """
    if (path, added_tokens) not in _LOADED:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, added = content["model"]["vocab"], {t["content"]: t["id"] for t in content["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items() if all(c in byte_of for c in token) and token not in added}
        coding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        encode = partial(coding.encode, allowed_special="all") if added_tokens else coding.encode_ordinary
        slow = []

        def ids(text: str) -> np.ndarray:
            try:
                return np.array(encode(text), dtype="<u4")
            except ValueError:  # the pattern engine's stack is full
                if not slow:
                    slow.append(Tokenizer.from_file(path))
                    slow[0].encode_special_tokens = not added_tokens
                return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

        _LOADED[path, added_tokens] = ids
    return _LOADED[path, added_tokens]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal items into ``windows`` groups of nearly equal sums; the groups hold the items' places.

    Every item starts as a partial partition with one filled window. The two partials with the largest imbalance merge, the
    fullest windows of one meeting the emptiest of the other, until one is left. Empty windows are not stored.
    """
    heap: list[tuple[int, int, list]] = [(-s, i, [(s, i, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - windows  # both lists run from the emptiest stored window to the fullest
        if over > 0:
            met = [(x[0] + y[0], min(x[1], y[1]), x[2] + y[2]) for x, y in zip(a[:over], reversed(b[:over]))]
            merged = sorted(met + a[over:] + b[over:], key=lambda w: w[:2])
        elif len(b) == 1:
            merged = a
            insort(merged, b[0], key=lambda w: w[:2])
        else:
            merged = sorted(a + b, key=lambda w: w[:2])
        spread = merged[-1][0] - (merged[0][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, tie, merged))
    return [w[2] for w in heap[0][2]] if heap else []


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``: as many as the total needs, and more whenever one would be too full."""
    total = sum(sizes)
    windows = -(-total // capacity)
    while True:
        dealt = difference(sizes, windows)
        top = max((sum(sizes[i] for i in w) for w in dealt), default=0)
        if top <= capacity:
            return dealt
        windows = max(windows + 1, -(-total // max(1, capacity - (top - total // windows))) if top - total // windows < capacity else windows * 2)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, grain: int = 256, end_id: int = 0, group_tokens: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Tokenize whole documents and pack them into sequences of at most ``capacity`` tokens.

    A document is its ids (see ``encoder`` for ``added_tokens``) and ``end_id``. Its full windows of ``capacity`` ids are sequences of their own. The rest is cut
    into parts of ``grain`` ids and one of what is left, and the parts of some ``group_tokens`` of neighbouring documents are dealt by
    differencing into near-equal windows; the window count rises whenever one would exceed the capacity. A task holds one
    group at a time, so memory is bounded whatever the size of the table, and no row is shuffled. Sequence ids are
    ``partition << 33`` plus a count, like ``monotonically_increasing_id``.

    Returns one row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ``ids`` are little-endian
    32-bit. Each id lies in one piece. Null and empty texts are the end id alone; ids may be null or repeat; other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, next_id = encoder(tokenizer, added_tokens), TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held, waiting
            out: list[tuple] = []
            parts: list[tuple] = []
            for doc, ids in held:
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    out.append((doc, start, capacity, ids[start : start + capacity], len(ids), next_id, 0))
                    next_id += 1
                parts += [(doc, at, len(ids[at : at + grain]), ids[at : at + grain], len(ids)) for at in range(whole, len(ids), grain)]
            for window in near_equal([p[2] for p in parts], capacity):
                offset = 0
                for i in sorted(window):
                    out.append((*parts[i], next_id, offset))
                    offset += parts[i][2]
                next_id += 1
            held, waiting = [], 0
            for at in range(0, len(out), 4096):
                doc, start, length, ids, tokens, sequence, offset = zip(*out[at : at + 4096])
                numbers = [pa.array(x, pa.int64()) for x in (start, length, tokens, sequence, offset)]
                binary = pa.array([x.tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc, id_arrow), numbers[0], numbers[1], binary, *numbers[2:]], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                held.append((doc, ids))
                waiting += len(ids)
                if waiting >= group_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(pack, PIECES.format(id_type=kind.simpleString()))
