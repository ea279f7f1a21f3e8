"""SimHash near-duplicates, searched with a Gray-order hierarchical index.

Rows are documents (``doc_id``, ``text``); other columns are ignored. NULL and
blank texts have fingerprint zero and are linked like any other. A group of equal
fingerprints is one point of the index however many rows it has. Repeated rows
share a fingerprint and so a component; a NULL ``doc_id`` never names a component
unless the component has no other id. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .common import batch, ddl, slices
from .components import by_root, components

_SEED = 42
_FINGERPRINT = {"doc_id": pa.int64(), "text_hash": pa.int64(), "fingerprint": pa.int64()}
_EDGE = {"u": pa.int64(), "v": pa.int64()}

#: Rows of a leaf of the index, and children of an inner node.
LEAF, FANOUT = 32, 8
#: Largest number of (query, node) pairs examined at once by a task.
_FRONTIER = 2_000_000
#: A bucket with more fingerprints is dealt to several tasks as pairs of parts.
PART = 8192


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Majority bits of the hashes of all word shingles, repeats included, as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), seed=_SEED)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    end = (start + size)[width - 1 :]
    count, ones = len(end), np.zeros(64, np.int64)
    for low in range(0, count, 1 << 16):
        spans = zip(start[low : low + (1 << 16)].tolist(), end[low : low + (1 << 16)].tolist())
        hashes = np.array([digest(joined[a:b], seed=_SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id``, a hash of the text, and the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(2).cast(pa.binary()).to_pylist()
            marks = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield batch(_FINGERPRINT, {"doc_id": part.column(0), "text_hash": part.column(1), "fingerprint": marks})

    columns = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    return columns.mapInArrow(run, ddl(_FINGERPRINT))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence, where neighbours differ in one bit."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Tree over fingerprints in Gray order.

    A node's pattern holds the bits on which everything below it agrees; what its
    parent already holds is left out. Going down, differences from a query add up,
    and a node is given up with all below it when they exceed the limit.
    """

    def __init__(self, codes: np.ndarray):
        order = np.argsort(gray_rank(codes), kind="stable")
        self.members = order
        self.codes = codes[order]
        #: From the leaves up: (common ones, common bits, first child, end of children).
        levels = []
        low, high = self.codes, self.codes
        width = LEAF
        while True:
            first = np.arange(0, len(low), width)
            low = np.bitwise_and.reduceat(low, first)
            high = np.bitwise_or.reduceat(high, first)
            levels.append((low, ~(low ^ high), first, np.append(first[1:], -1)))
            if len(low) == 1:
                break
            width = FANOUT
        self.levels = levels[::-1]

    def near(self, queries: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) positions at ``limit`` or fewer differing bits, block by block."""
        block = max(1, _FRONTIER // max(1, len(self.codes)))
        for start in range(0, len(queries), block):
            asked = queries[start : start + block]
            row = np.arange(len(asked))
            pattern, bits, _, _ = self.levels[0]
            apart = np.bitwise_count((asked ^ pattern[0]) & bits[0]).astype(np.int64)
            row, apart = row[apart <= limit], apart[apart <= limit]
            node, held = np.zeros(len(row), np.int64), np.broadcast_to(bits[0], len(row))
            for depth, (_, _, first, end) in enumerate(self.levels):
                inner = depth + 1 < len(self.levels)
                codes, below = self.levels[depth + 1][:2] if inner else (self.codes, None)
                ends = np.where(end < 0, len(codes), end)
                count = (ends - first)[node]
                at = np.repeat(np.arange(len(row)), count)
                child = first[node][at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                rest = ~held[at] & (below[child] if inner else ~np.uint64(0))
                apart = apart[at] + np.bitwise_count((asked[row[at]] ^ codes[child]) & rest)
                keep = apart <= limit
                row, node, apart = row[at][keep], child[keep], apart[keep]
                if inner:
                    held = below[node]
            yield row + start, self.members[node]


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each pair; a set is named by its smallest position."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _links(key: np.ndarray, codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each bucket; rows of a bucket stand together."""
    parent = np.arange(len(codes))
    first = np.flatnonzero(np.append(True, np.any(key[1:] != key[:-1], axis=1)))
    size = np.diff(np.append(first, len(codes)))
    small = np.repeat(size <= LEAF, size)
    group = np.repeat(np.arange(len(first)), size)
    for step in range(1, int(min(LEAF, size.max(initial=1)))):  # one leaf without nodes above it
        here = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        close = here[np.bitwise_count(codes[here] ^ codes[here + step]) <= limit]
        _merge(parent, close, close + step)
    for at, rows in zip(first[size > LEAF], size[size > LEAF]):
        own = codes[at : at + rows]
        for asked, found in GrayIndex(own).near(own, limit):
            _merge(parent, at + asked, at + found)
    joined = np.flatnonzero(parent != np.arange(len(parent)))
    return codes[joined].view(np.int64), codes[parent[joined]].view(np.int64)


def _bucket_keys(code: Column, limit: int) -> Column:
    """Keys of which two fingerprints within ``limit`` share one at least.

    The bits are cut in ``limit + 2`` blocks. So many differences leave two blocks
    equal, and there is a key for each pair of blocks.
    """
    blocks = limit + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    cuts = []
    for low, high in zip(edges, edges[1:]):
        cuts.append(F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << (high - low)) - 1)))
    keys = []
    for n, (i, j) in enumerate(combinations(range(blocks), 2)):
        wide = edges[j + 1] - edges[j]
        joined = F.shiftleft(cuts[i], wide).bitwiseOR(cuts[j])
        keys.append(joined.bitwiseOR(F.lit(n << 32)))
    return F.array(*keys)


def links(codes: DataFrame, limit: int = 4) -> DataFrame:
    """Edges (``u``, ``v``) that connect all distinct fingerprints within ``limit`` bits.

    ``codes`` has one column ``fingerprint`` of distinct values. A bucket yields a
    spanning forest, never its pairs. A bucket of more than ``PART`` fingerprints is
    cut in parts by hash, and every two parts meet in a task of their own.
    """
    keyed = codes.select("fingerprint", F.explode(_bucket_keys(F.col("fingerprint"), limit)).alias("bucket"))
    large = keyed.groupBy("bucket").count().where(F.col("count") > PART)
    parts = large.select("bucket", F.ceil(F.col("count") / PART).cast("bigint").alias("parts"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts"))
    meets = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1),
        lambda other: F.least(own, other) * F.col("parts") + F.greatest(own, other),
    )
    dealt = keyed.join(parts, "bucket", "left").select(
        "bucket",
        F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(meets)).alias("part"),
        "fingerprint",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0, 3), np.int64)
        for part in batches:
            rows = np.stack([part.column(i).to_numpy() for i in range(3)], axis=1)
            rows = np.concatenate([kept, rows])
            starts = np.flatnonzero(np.append(True, np.any(rows[1:, :2] != rows[:-1, :2], axis=1)))
            rows, kept = rows[: starts[-1]], rows[starts[-1] :]
            if len(rows):
                u, v = _links(rows[:, :2], np.ascontiguousarray(rows[:, 2]).view(np.uint64), limit)
                yield batch(_EDGE, {"u": u, "v": v})
        if len(kept):
            u, v = _links(kept[:, :2], np.ascontiguousarray(kept[:, 2]).view(np.uint64), limit)
            yield batch(_EDGE, {"u": u, "v": v})

    grouped = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return grouped.mapInArrow(run, ddl(_EDGE)).distinct()


def near_groups(marks: DataFrame, limit: int = 4) -> DataFrame:
    """Per distinct fingerprint the fingerprint that names its group (``fingerprint``, ``root``)."""
    codes = staged(marks.select("fingerprint").distinct(), "codes")
    joined = components(links(codes, limit))
    return codes.join(joined, codes["fingerprint"] == joined["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root")
    )


def near_duplicates(docs: DataFrame, limit: int = 4, width: int = 4) -> DataFrame:
    """Per document its fingerprint in hexadecimal and the smallest ``doc_id`` it is linked with."""
    marks = staged(fingerprints(docs, width), "fingerprints")
    groups = staged(near_groups(marks, limit), "groups")
    least = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).join(groups, "fingerprint")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    members = by_root(groups, named, "fingerprint").select("fingerprint", "component_id")
    return marks.join(members, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, limit: int = 4, width: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay when each group keeps the document with the smallest id.

    All columns are returned. Of repeated rows one stays.
    """
    marks = staged(fingerprints(docs, width), "fingerprints")
    groups = near_groups(marks, limit)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    least = marks.groupBy("fingerprint").agg(F.min(rank).alias("least")).join(groups, "fingerprint")
    stays = least.groupBy("root").agg(F.min("least").alias("least")).select(
        _key(F.col("least.doc_id")).alias("__key"), F.col("least.text_hash").alias("__hash")
    )
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row"),
        _key(F.col("doc_id")).alias("__key"),
        F.xxhash64("text").alias("__hash"),
    )
    kept = rows.join(staged(stays, "stays"), ["__key", "__hash"], "left_semi").dropDuplicates(["__key", "__hash"])
    return kept.select("__row.*")


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))
