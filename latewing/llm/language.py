"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of lower-cased text, weighted by TF-IDF. Weights
are learned by follow-the-regularised-leader with elastic-net penalties, and
probabilities are calibrated by one temperature. Rows are documents (``doc_id``, ``text``,
``lang``); other columns are ignored. A text that is NULL or has no letter is ``und``
with score 0, as is every text when there is nothing to learn from. Rows without an
id teach nothing. Ties go to the language first in order. Repeated rows are predicted alike and counted
as often as they occur. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import staged
from .common import batch, ddl, held_out, share_kept, slices

#: Slots of the hashed n-grams of 1 to LONGEST characters.
SLOTS, LONGEST = 1 << 15, 3
#: About so many rows of each language are learned from, a quarter of them for the temperature.
SAMPLE = 1600
SHARDS, EPOCHS = 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
#: Most languages that one model holds; more raise an error.
MOST_LANGUAGES = 1000

_CHUNK = 1024


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of the whole text, ascending, and how often each occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    own, found = codes * np.uint32(2654435761), []
    for n in range(1, LONGEST + 1):
        if n > 1:
            own = (own[:-1] ^ (own[:-1] >> np.uint32(15))) * np.uint32(2246822519) + codes[n - 1 :]
        mixed = own * np.uint32(3266489917)
        found.append((mixed ^ (mixed >> np.uint32(13))) & np.uint32(SLOTS - 1))
    count = np.bincount(np.concatenate(found), minlength=SLOTS)
    slots = np.flatnonzero(count)
    return slots, count[slots]


def weigh(slots: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic counts, of length one."""
    values = np.log1p(count) * idf[slots]
    return values / max(float(np.sqrt(values @ values)), 1e-12)


def document_counts(docs: DataFrame) -> np.ndarray:
    """In how many of all ``docs`` each slot occurs; the last value is the number of documents.

    Tasks add up their documents, and sums are merged by slices of the slots.
    """
    fields = {"chunk": pa.int32(), "counts": pa.binary()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + _CHUNK, np.int64)
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                total[ngrams(text)[0]] += 1
                total[-1] += 1
        if total[-1]:
            chunks = range(len(total) // _CHUNK)
            yield batch(fields, {
                "chunk": list(chunks),
                "counts": [total[c * _CHUNK : (c + 1) * _CHUNK].tobytes() for c in chunks],
            })

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CHUNK, np.int64)
        for part in parts:
            for counts in part.column(1).to_pylist():
                total += np.frombuffer(counts, np.int64)
        yield batch(fields, {"chunk": [key[0].as_py()], "counts": [total.tobytes()]})

    merged = docs.select("text").mapInArrow(count, ddl(fields)).groupBy("chunk").applyInArrow(merge, ddl(fields))
    total = np.zeros(SLOTS + _CHUNK, np.int64)
    for row in merged.collect():  # SLOTS / _CHUNK + 1 rows
        total[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["counts"], np.int64)
    return np.append(total[:SLOTS], total[-1])


class Leader:
    """Follow-the-regularised-leader for a softmax over languages, per-coordinate rates."""

    def __init__(self, languages: int):
        self.z = np.zeros((SLOTS + 1, languages))
        self.n = np.zeros((SLOTS + 1, languages))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = (BETA + np.sqrt(n)) / ALPHA + L2
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / step

    def learn(self, slots: np.ndarray, values: np.ndarray, target: int) -> None:
        at, x = np.append(slots, SLOTS), np.append(values, 1.0)
        own = self.weights(at)
        slope = np.outer(x, softmax(x @ own))
        slope[:, target] -= x
        squares = slope**2
        self.z[at] += slope - (np.sqrt(self.n[at] + squares) - np.sqrt(self.n[at])) / ALPHA * own
        self.n[at] += squares


def softmax(logits: np.ndarray) -> np.ndarray:
    top = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return top / top.sum(axis=-1, keepdims=True)


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def logits(self, text: str) -> np.ndarray:
        slots, count = ngrams(text)
        return weigh(slots, count, self.idf) @ self.weights[slots] + self.weights[SLOTS]

    def predict(self, text: str) -> tuple[str, float]:
        chance = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(chance))
        return self.languages[best], float(chance[best])


_TAUGHT = {"shard": pa.int32(), "target": pa.int32(), "slots": pa.list_(pa.int32()), "counts": pa.list_(pa.int32())}


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Learn from documents outside the held-out fold; document counts cover all of those.

    Weights are learned from about ``sample`` documents of each language, in shards
    whose models are averaged. The driver gets weights that are not zero, at most one per slot
    and language.
    """
    taught = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in taught.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    languages = sorted(sizes)
    counts = document_counts(taught)
    idf = np.log((1 + counts[SLOTS]) / (1 + counts[:SLOTS])) + 1

    # Literals, not a join: a join on the language would shuffle whole texts by a few hot keys.
    shares = F.create_map(*(
        part
        for i, lang in enumerate(languages)
        for part in (F.lit(lang), F.struct(F.lit(i).alias("target"), F.lit(min(1.0, sample / sizes[lang])).alias("share")))
    ))
    known = taught.select("doc_id", "text", F.element_at(shares, F.col("lang")).alias("known"))
    chosen = known.where(share_kept(F.col("doc_id"), F.col("known.share"))).select(
        "doc_id", "text", F.col("known.target").alias("target")
    )
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(4 * SHARDS)).cast("int")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [ngrams(t) for t in part.column(2).to_pylist()]
            yield batch(_TAUGHT, {
                "shard": part.column(0), "target": part.column(1),
                "slots": [s.astype(np.int32) for s, _ in found], "counts": [c.astype(np.int32) for _, c in found],
            })

    rows = staged(chosen.select(shard.alias("shard"), "target", "text").mapInArrow(count, ddl(_TAUGHT)), "taught")
    model = LanguageModel(languages, idf, _averaged(rows, idf, len(languages)))
    model.temperature = _temperature(rows, model)
    return model


def _averaged(rows: DataFrame, idf: np.ndarray, languages: int) -> np.ndarray:
    """Weights learned by each shard on its own, averaged in the cluster."""
    fields = {"slot": pa.int32(), "target": pa.int32(), "weight": pa.float64()}

    def learn(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = Leader(languages)
        own = [
            (target, np.array(slots), np.array(counts))
            for part in parts
            for target, slots, counts in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)))
        ]
        own.sort(key=lambda row: (len(row[1]), row[0], row[1].tobytes(), row[2].tobytes()))
        order = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for at in order.permutation(len(own)):
                target, slots, counts = own[at]
                leader.learn(slots, weigh(slots, counts, idf), target)
        weights = leader.weights(slice(None))
        slot, target = np.nonzero(weights)
        yield batch(fields, {"slot": slot, "target": target, "weight": weights[slot, target]})

    training = rows.where(f"shard < {3 * SHARDS}").withColumn("shard", F.col("shard") % SHARDS)
    learned = training.groupBy("shard").applyInArrow(learn, ddl(fields))
    mean = learned.groupBy("slot", "target").agg((F.sum("weight") / SHARDS).alias("weight")).toPandas()
    weights = np.zeros((SLOTS + 1, languages))
    weights[mean["slot"].to_numpy(int), mean["target"].to_numpy(int)] = mean["weight"]
    return weights


def _temperature(rows: DataFrame, model: LanguageModel) -> float:
    """The temperature with the smallest loss on sampled rows that taught no weights."""
    grid = np.logspace(-2, 1, 61)
    fields = {"at": pa.int32(), "loss": pa.float64()}

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grid))
        for part in slices(batches):
            for target, slots, counts in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                at = np.array(slots, int)
                logits = weigh(at, np.array(counts), model.idf) @ model.weights[at] + model.weights[SLOTS]
                total -= np.log(np.maximum(softmax(logits / grid[:, None])[:, target], 1e-12))
        yield batch(fields, {"at": np.arange(len(grid)), "loss": total})

    summed = rows.where(f"shard >= {3 * SHARDS}").mapInArrow(losses, ddl(fields)).groupBy("at").agg(F.sum("loss").alias("loss"))
    found = {r["at"]: r["loss"] for r in summed.collect()}
    return float(grid[min(found, key=lambda at: (round(found[at], 9), at))]) if any(found.values()) else 1.0


def predict(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for every document."""
    model = fit(docs, sample)
    fields = {"doc_id": pa.int64(), "held_out": pa.bool_(), "lang_pred": pa.string(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [
                model.predict(t) if model and has_letter else ("und", 0.0)
                for t, has_letter in zip(part.column(2).to_pylist(), part.column(3).to_pylist())
            ]
            yield batch(fields, {
                "doc_id": part.column(0), "held_out": part.column(1),
                "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
            })

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), "text", letters.alias("letters"))
    return rows.mapInArrow(run, ddl(fields))
