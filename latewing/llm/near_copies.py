"""Near copies by the exact Jaccard similarity of five-word shingle sets, searched with MinHash bands.

Rows are documents (``doc_id``, ``text``); other columns are ignored. Texts with equal sets
are one point however many rows have them; a text without a word has the empty set. Two
points that agree in all ``ROWS`` hashes of one of ``BANDS`` bands share a bucket: at a
similarity of 0.8 all but 2 in 10,000 pairs do. Sets in one bucket are compared exactly.
No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .common import batch, ddl, slices
from .components import components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: A bucket with more sets is dealt to several tasks as pairs of parts.
PART = 512

_SEED = 42
_RANDOM = np.random.default_rng(_SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_MASK, _FACTOR = _RANDOM[0], _RANDOM[1] * np.uint64(2) + np.uint64(1)
_MARK = {"doc_id": pa.int64(), "text_hash": pa.int64(), "code": pa.int64(), "bands": pa.list_(pa.int64())}
_SET = {"code": pa.int64(), "shingles": pa.binary()}
_EDGE = {"u": pa.int64(), "v": pa.int64()}


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the distinct runs of ``WIDTH`` words, ascending; a shorter text is one run."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    end = (start + size)[min(WIDTH, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    spans = zip(start.tolist(), end.tolist())
    return np.unique(np.fromiter((digest(joined[a:b], seed=_SEED) for a, b in spans), "<u8", len(end)))


def code(own: np.ndarray) -> int:
    """A hash of the whole set."""
    return xxhash.xxh64_intdigest(own.tobytes(), seed=_SEED)


def bands(own: np.ndarray) -> np.ndarray:
    """A number for each band, from the least of each of its hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(own), 1 << 12):
        np.minimum(least, ((own[low : low + (1 << 12), None] ^ _MASK) * _FACTOR).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), seed=n) for n, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _marks(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash of the text, the code of its set and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(t) for t in part.column(2).cast(pa.binary()).to_pylist()]
            yield batch(_MARK, {
                "doc_id": part.column(0), "text_hash": part.column(1),
                "code": np.array([code(s) for s in sets], np.uint64).view(np.int64),
                "bands": [bands(s).view(np.int64) for s in sets],
            })

    columns = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    return columns.mapInArrow(run, ddl(_MARK))


def _sets(docs: DataFrame) -> DataFrame:
    """The sets of ``docs`` (``text``, ``code``) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            yield batch(_SET, {"code": part.column(0), "shingles": [shingles(t).tobytes() for t in texts]})

    return docs.select("code", "text").mapInArrow(run, ddl(_SET))


def similar_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is ``similarity`` or more."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    root, found = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        others = np.arange(i + 1, len(sets))
        fits = np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i])
        others = others[fits & (root[others] != root[i]) & (size[others] > 0)]
        if not len(others) or not size[i]:
            continue
        values = np.concatenate([sets[j] for j in others])
        place = np.minimum(np.searchsorted(sets[i], values), size[i] - 1)
        shared = np.add.reduceat((sets[i][place] == values).astype(np.int64), np.cumsum(size[others]) - size[others])
        for j in others[shared >= similarity * (size[others] + size[i] - shared) - 1e-9].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                found.append((i, j))
    return found


def _buckets(points: DataFrame) -> DataFrame:
    """(``bucket``, ``part``, ``code``) of all buckets with two or more points; equal buckets stay once."""
    keyed = points.select("code", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "code"
    )
    number = F.count("*").alias("count")
    same = ("count", "least", "most", "mixed")
    held = keyed.groupBy("bucket").agg(
        number, F.min("code").alias("least"), F.max("code").alias("most"), F.bit_xor(F.xxhash64("code")).alias("mixed")
    )
    once = held.where("count > 1").groupBy(*same).agg(F.min("bucket").alias("bucket"))
    parts = once.select("bucket", F.ceil(F.col("count") / PART).cast("bigint").alias("parts"))
    own = F.pmod(F.xxhash64("code"), F.col("parts"))
    meets = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1),
        lambda other: F.least(own, other) * F.col("parts") + F.greatest(own, other),
    )
    return keyed.join(parts, "bucket").select("bucket", F.explode(meets).alias("part"), "code")


def links(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges (``u``, ``v``) between codes that connect all near copies found; sets travel only to shared buckets."""
    points = marks.groupBy("code").agg(
        F.any_value("bands").alias("bands"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one")
    )
    buckets = staged(_buckets(points), "buckets")
    wanted = points.join(buckets.select("code").distinct(), "code", "left_semi").select(
        "code", _key(F.col("one.doc_id")).alias("__key"), F.col("one.text_hash").alias("__hash")
    )
    texts = docs.select(_key(F.col("doc_id")).alias("__key"), F.xxhash64("text").alias("__hash"), "text")
    chosen = texts.join(staged(wanted, "wanted"), ["__key", "__hash"]).select("code", "text")
    sets = staged(_sets(chosen).dropDuplicates(["code"]), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, codes, own = None, [], []

        def close() -> pa.RecordBatch:
            pairs = similar_links(own)
            return batch(_EDGE, {"u": [codes[i] for i, _ in pairs], "v": [codes[j] for _, j in pairs]})

        for part in batches:
            columns = [part.column(i).to_pylist() for i in range(4)]
            for bucket, piece, member, stored in zip(*columns):
                if (bucket, piece) != at:
                    yield close()
                    at, codes, own = (bucket, piece), [], []
                codes.append(member)
                own.append(np.frombuffer(stored, "<u8"))
        yield close()

    dealt = buckets.join(sets, "code").select("bucket", "part", "code", "shingles")
    grouped = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "code")
    return grouped.mapInArrow(run, ddl(_EDGE)).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when each group keeps the document with the smallest id.

    All columns are returned. Of repeated rows one stays.
    """
    marks = staged(_marks(docs), "marks")
    joined = components(staged(links(docs, marks), "links"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    least = marks.groupBy("code").agg(F.min(rank).alias("least"))
    named = least.join(joined, least["code"] == joined["node"], "left").select(F.coalesce("root", "code").alias("root"), "least")
    stays = named.groupBy("root").agg(F.min("least").alias("least")).select(
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
