"""Best-fit packing of token sequences, in bulk-synchronous steps.

Rows are documents (``doc_id``, ``text``); other columns are ignored. A NULL or
empty text is the end mark alone. Added tokens of the vocabulary file that stand in a text are its
own ids, as ``tokenizers`` codes them; very long texts are coded whole. Every row is packed, repeated rows each on their
own; a NULL ``doc_id`` is packed like any other. No rows give no rows.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import staged
from .common import batch, ddl, slices, worker_state

CAPACITY = 2048
#: Words a worker remembers with their ids, and the longest word it remembers.
_MEMO, _MEMO_LENGTH = 400_000, 64

_PIECE = {
    "doc_id": pa.int64(),
    "piece": pa.int32(),
    "start": pa.int64(),
    "length": pa.int64(),
    "ids_crc32": pa.int64(),
    "piece_key": pa.int64(),
}
_IDS = {"ids": pa.list_(pa.int32())}

# A blank with another one beside it, or at an end of the text.
_IRREGULAR = re.compile(r" \s|\s |^ | $")
_WORD_START = re.compile(r"(?<=\S)(?= \S)")


class _Memo(dict):
    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, word: str) -> bytes:
        found = self.compute(word)
        if len(word) <= _MEMO_LENGTH:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = found
        return found


def _byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class WordEncoder:
    """Ids of a byte-level BPE vocabulary file, as little-endian unsigned 32-bit numbers.

    No token reaches over a single blank between two other characters except as its
    first character, so texts are cut there and equal words are encoded once.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in token): rank
            for token, rank in content["model"]["vocab"].items()
            if token not in special
        }
        coder = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        plain = coder.encode_ordinary
        self.first = _Memo(lambda word: np.array(plain(word), "<u4").tobytes())
        self.later = _Memo(lambda word: np.array(plain(" " + word), "<u4").tobytes())
        # The file's added tokens are one id wherever they stand; what is between them is coded on its own.
        longest = sorted(special, key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, longest))})") if special else None
        self.special = {name: np.array([number], "<u4").tobytes() for name, number in special.items()}

    def encode(self, text: str) -> bytes:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        parts = self.added.split(text)
        return b"".join(self.special[p] if n % 2 else self._plain(p) for n, p in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        if _IRREGULAR.search(text):
            return b"".join(map(self.first.__getitem__, _WORD_START.split(text)))
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))


def cut_pieces(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, keep_ids: bool = True
) -> DataFrame:
    """Token pieces of every document, its ids followed by id 0.

    Only a document longer than ``capacity`` is cut: its first piece takes the
    remainder, the others are full. ``tokenizer`` names a public vocabulary file.
    ``piece_key`` numbers the pieces once they are written.
    """
    fields = _PIECE | (_IDS if keep_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = public_tokenizers.path(tokenizer)
        encoder = worker_state(("words", path), lambda: WordEncoder(path))
        key = TaskContext.get().partitionId() << 40
        for part in slices(batches):
            rows = {name: [] for name in fields}
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = encoder.encode(text or "") + b"\0\0\0\0"
                total = len(ids) // 4
                bounds = [0, *range(total % capacity or min(total, capacity), total, capacity), total]
                for piece, (start, end) in enumerate(zip(bounds, bounds[1:])):
                    own = ids[4 * start : 4 * end]
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(piece)
                    rows["start"].append(start)
                    rows["length"].append(end - start)
                    rows["ids_crc32"].append(zlib.crc32(own))
                    rows["piece_key"].append(key)
                    key += 1
                    if keep_ids:
                        rows["ids"].append(np.frombuffer(own, "<u4").astype(np.int32))
            yield batch(fields, rows)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ddl(fields))


def plan_runs(counts: np.ndarray, capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """Where the documents of each length go, by rank among those of equal length.

    ``counts[n]`` is the number of documents of length n. Documents of one length and
    sequences with one gap are interchangeable, so both range-sorted sides are kept
    as runs. In each step the documents, longest first, take the smallest gap
    that is not shorter; those that want the same gap are served by rank; the gaps left
    over are put back, and the step is repeated. When nothing fits any more, the
    longest documents open as many sequences as the remaining tokens need at least.

    Returns per length rows of (first rank, first sequence, offset), by first rank. The number
    of runs depends on the lengths and steps, not on the number of documents.
    """
    left = counts.astype(np.int64).copy()
    served = np.zeros(len(left), np.int64)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    gaps: dict[int, list[tuple[int, int]]] = {}
    sequences = 0
    sizes = np.arange(len(left))

    def place(length: int, count: int, sequence: int, gap: int, into: dict) -> None:
        runs[length].append((served[length], sequence, capacity - gap))
        served[length] += count
        left[length] -= count
        if gap > length:
            into.setdefault(gap - length, []).append((sequence, count))

    while left.any():
        updated: dict[int, list[tuple[int, int]]] = {}
        order = sorted(gaps)
        matched = False
        for length in np.flatnonzero(left)[::-1].tolist():
            at = bisect.bisect_left(order, length)
            while left[length] and at < len(order):
                gap = order[at]
                sequence, free = gaps[gap].pop()
                count = int(min(free, left[length]))
                place(length, count, sequence, gap, updated)
                matched = True
                if free > count:
                    gaps[gap].append((sequence + count, free - count))
                elif not gaps[gap]:
                    del gaps[gap], order[at]
        for gap, free in updated.items():
            gaps.setdefault(gap, []).extend(free)
        if matched:
            continue
        wanted = max(int(left[capacity // 2 + 1 :].sum()), -(-int((left * sizes).sum()) // capacity))
        for length in np.flatnonzero(left)[::-1].tolist():
            count = int(min(left[length], wanted))
            if count:
                place(length, count, sequences, capacity, gaps)
                sequences += count
                wanted -= count
    return {length: np.array(found, np.int64) for length, found in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``piece_key``, ``doc_id``, ``piece``, ``length`` and others) with ``sequence_id`` and ``offset``.

    The pieces are written first, which fixes their keys. Keys alone are range-sorted by
    length in the cluster and ranked among equal lengths by task; to the driver come a
    count per length and task, at most one for each task and one for each length. The runs go
    back to the tasks, which place each key; a join brings the places to the pieces.
    """
    ranked_fields = {"length": pa.int64(), "piece_key": pa.int64(), "task": pa.int32(), "rank": pa.int64()}

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for part in batches:
            length = part.column(0).to_numpy()
            if not len(length):
                continue
            starts = np.flatnonzero(np.append(True, length[1:] != length[:-1]))
            own = np.arange(len(length)) - np.repeat(starts, np.diff(np.append(starts, len(length))))
            own[: starts[1] if len(starts) > 1 else len(own)] += seen if length[0] == last else 0
            last, seen = length[-1], int(own[-1]) + 1
            yield batch(ranked_fields, {
                "length": length, "piece_key": part.column(1), "task": np.full(len(own), task), "rank": own,
            })

    written = staged(pieces, "pieces")
    order = ["length", "doc_id", "piece", "piece_key"]
    keys = written.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = staged(keys.select("length", "piece_key").mapInArrow(rank, ddl(ranked_fields)), "ranked")

    counts, first = np.zeros(capacity + 1, np.int64), {}
    for length, task, count in sorted(tuple(r) for r in ranked.groupBy("length", "task").count().collect()):
        first[length, task] = int(counts[length])
        counts[length] += count
    runs = plan_runs(counts, capacity)
    placed_fields = {"piece_key": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            length, key, task, local = (c.to_numpy() for c in part.columns)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n, t in set(zip(length.tolist(), task.tolist())):
                here = np.flatnonzero((length == n) & (task == t))
                ranks = first[n, t] + local[here]
                run = runs[n][np.searchsorted(runs[n][:, 0], ranks, "right") - 1]
                sequence[here] = run[:, 1] + ranks - run[:, 0]
                offset[here] = run[:, 2]
            yield batch(placed_fields, {"piece_key": key, "sequence_id": sequence, "offset": offset})

    placed = ranked.mapInArrow(place, ddl(placed_fields))
    return written.join(placed, "piece_key").drop("piece_key")
