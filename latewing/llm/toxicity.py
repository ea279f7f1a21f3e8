"""Toxicity by class-conditional Kneser-Ney models of words.

The class is the context of a word: P(w | class) = (c(class, w) - D) / c(class) + rest(class) * shared(w),
where c counts texts that hold w, D is the discount of words in one text (all of it), two or more, and rest
is all that was discounted. The shared backoff is Kneser and Ney's: it does not count how often a
word occurs, but after how many contexts, here in how many of the two classes, it occurs at all. So an
expression that only toxic texts hold stays unlikely for the ordinary model, however frequent it
is, while rare words of either class fall back to the same small share. Both models sum to one
over the words of the labelled texts.

A word's evidence is the log-ratio of the two models, of either sign, as against a word that both know from
backoff alone, which is none. A text's evidence is the log of its mean likelihood ratio: how much likelier the text is if one of its words, it
does not matter which, comes from the toxic model. It is normalised by length. A logistic
line turns it into a score; that line is fitted on texts of each fold judged by models that
were counted without that fold. The final model counts all labelled texts outside the held-out fold.

Rows are documents (``doc_id``, ``text``) and labels (``doc_id``, ``toxic``); other columns
are ignored. Words are what stands between blanks, in lower case, without punctuation at their ends; a text counts a
word once, however often it holds it. NULL and blank texts, and texts of punctuation, get the
share of toxic rows as score. Labels other than 0 and 1, and rows without an id, teach nothing; a ``doc_id``
labelled twice counts twice. Without both classes every score is that share, smoothed. A score of
exactly 0.5 counts as toxic. Texts are read whole, very long ones in time that grows with their words. No rows give no rows.

The model is a table with one row for each word of two texts of a class or more (by 64-bit hash). It grows with the corpus: tasks
hold it in blocks of at most ``BLOCK`` words, and texts are read once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .common import batch, ddl, fold, held_out, slices

#: Folds that teach; the fold 0 is held out.
FOLDS = (1, 2, 3, 4)
#: Words of the model that a task holds at once, of 28 bytes each.
BLOCK = 4_000_000
#: Counts from here on have one discount.
_TOP = 3
_ENDS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), 171, 187, 191, 8230]))
_MEMO = 300_000
#: Bins of the calibration over evidence from ``-LIMIT`` to ``LIMIT``; what lies outside counts as at the end.
CELLS, LIMIT = 4000, 20.0


class _Words:
    """Clean words of raw ones, by a memo of bounded size."""

    def __init__(self, value: Callable[[list[str]], list]):
        self.value, self.known = value, {}

    def learn(self, raw: set[str]) -> None:
        if len(self.known) + len(raw) > _MEMO:
            self.known.clear()
        new = list(raw.difference(self.known))
        self.known.update(zip(new, self.value([w.strip(_ENDS) for w in new])))


def _hashes(words: list[str]) -> list[int]:
    """Signed 64-bit hashes; 0 for no word."""
    return [xxhash.xxh64_intdigest(w.encode(), 42) - (1 << 63) if w else 0 for w in words]


def split_words(texts: list[str | None]) -> list[list[str]]:
    return [(t or "").lower().split() for t in texts]


_CELLS = [f"c{k}{f}" for k in (0, 1) for f in FOLDS]
_COUNT = {"word": pa.int64(), **{c: pa.int64() for c in _CELLS}}


def count_words(taught: DataFrame) -> DataFrame:
    """Per word the texts that hold it, by class and fold: columns ``c01`` to ``c14``.

    ``taught`` has ``text``, ``toxic`` and ``fold``. Tasks sum before the shuffle.
    """

    def emit(seen: dict[int, list[int]]) -> pa.RecordBatch:
        words = np.fromiter(seen, np.int64, len(seen))
        counts = np.array(list(seen.values()), np.int64).reshape(-1, len(_CELLS))
        return batch(_COUNT, {"word": words, **{c: counts[:, i] for i, c in enumerate(_CELLS)}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(_hashes), {}
        for part in slices(batches):
            split = split_words(part.column(0).to_pylist())
            words.learn(set().union(*split))
            cells = [len(FOLDS) * k + f - FOLDS[0] for k, f in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            for own, cell in zip(split, cells):
                for word in {words.known[w] for w in own} - {0}:
                    seen.setdefault(word, [0] * len(_CELLS))[cell] += 1
            if len(seen) > _MEMO:
                yield emit(seen)
                seen = {}
        yield emit(seen)

    held = taught.where("text IS NOT NULL").select("text", F.col("toxic").cast("int"), F.col("fold").cast("int"))
    return held.mapInArrow(run, ddl(_COUNT)).groupBy("word").agg(*(F.sum(c).alias(c) for c in _CELLS))


def _count_without(k: int, left_out: int | None) -> Column:
    return sum((F.col(f"c{k}{f}") for f in FOLDS if f != left_out), F.lit(0).cast("bigint"))


def discounts(twice: int, thrice: int, more: int) -> list[float]:
    """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of words with counts 2, 3 and 4.

    A word of one text loses all of its count: it is as likely as the shared backoff says.
    """
    share = twice / (twice + 3 * thrice) if twice and thrice else 0.5
    found, numbers = [0.0, 1.0], (twice, thrice, more)
    for n in (2, 3):
        left = n - (n + 1) * share * numbers[n - 1] / numbers[n - 2] if numbers[n - 2] else n / 2
        found.append(min(max(left, 1.0), n - 0.05))
    return found


def ratios(counts: DataFrame) -> DataFrame:
    """``word`` and its log-ratio, ``r0`` from all folds, ``r1`` to ``r4`` without one fold each.

    They are taken less the log-ratio of the two backoffs, which all words have in common that no class
    has in two texts. Those words, known or not, have the ratio 0 and no row.
    """
    models = (None, *FOLDS)
    sums = []
    for m, left_out in enumerate(models):
        for k in (0, 1):
            own = _count_without(k, left_out)
            sums += [F.sum(own).alias(f"n{m}{k}"), F.count_if(own > 0).alias(f"t{m}{k}")]
            sums += [F.count_if(own == n).alias(f"o{m}{k}{n}") for n in range(1, _TOP + 2)]
    figures = counts.agg(*sums).first().asDict()
    columns = []
    for m, left_out in enumerate(models):
        chance, own, left = [], [_count_without(k, left_out) for k in (0, 1)], []
        types = max(sum(figures[f"t{m}{k}"] for k in (0, 1)), 1)
        shared = sum(((c > 0).cast("int") for c in own), F.lit(0)) / types
        for k, count in enumerate(own):
            numbers = [figures[f"o{m}{k}{n}"] for n in range(1, _TOP + 2)]
            cut, total = discounts(*numbers[1:]), max(figures[f"n{m}{k}"] or 0, 1)
            beyond = figures[f"t{m}{k}"] - sum(numbers[: _TOP - 1])
            left.append((sum(cut[n] * numbers[n - 1] for n in range(1, _TOP)) + cut[_TOP] * beyond) / total)
            taken = F.element_at(F.array(*map(F.lit, cut)), (F.least(count, F.lit(_TOP)) + 1).cast("int"))
            chance.append(F.greatest(count - taken, F.lit(0.0)) / total + left[k] * shared)
        alike = float(np.log(left[1] / left[0])) if min(left) > 0 else 0.0
        both = (F.greatest(*own) >= 2) & (chance[0] > 0) & (chance[1] > 0)
        columns.append(F.when(both, F.log(chance[1] / chance[0]) - alike).otherwise(0.0).cast("float").alias(f"r{m}"))
    often = F.greatest(*(_count_without(k, None) for k in (0, 1))) >= 2
    return counts.where(often).select("word", *columns)


def _block(model: DataFrame, number: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """One block's words, in order, and their ratios. Blocks are cut by hash, so they are of about one size."""
    rows = model.where(F.pmod("word", F.lit(blocks)) == number).toArrow()
    words = rows["word"].to_numpy()
    order = np.argsort(words)
    values = np.stack([rows[f"r{m}"].to_numpy() for m in range(len(FOLDS) + 1)], axis=1)
    return words[order], values[order]


_SUMS = {"doc_id": pa.int64(), "words": pa.int64(), "own": pa.float64(), "crossed": pa.float64()}
_RATED = {"doc_id": pa.int64(), "text": pa.string(), "fold": pa.int32(), **_SUMS}


def _rate_block(docs: DataFrame, words: np.ndarray, values: np.ndarray, last: bool) -> DataFrame:
    """Adds one block's words to the sums of likelihood ratios, less 1 each, and counts a text's words.

    The last block's rows are without their texts.
    """
    fields = _SUMS if last else _RATED
    shared = docs.sparkSession.sparkContext.broadcast((words, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratio = shared.value
        gain = np.vstack([np.expm1(np.clip(ratio, -50, 50)), np.zeros((2, ratio.shape[1]), np.float32)])

        def places(clean: list[str]) -> list[int]:
            """A word's row; the row after the last for others, one more for no word at all."""
            wanted = np.array(_hashes(clean), np.int64)
            at = np.searchsorted(known, wanted)
            held = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == wanted) if len(known) else np.zeros(len(at), bool)
            return np.where(wanted == 0, len(known) + 1, np.where(held, at, len(known))).tolist()

        memo = _Words(places)
        for part in slices(batches):
            split = split_words(part.column(1).to_pylist())
            memo.learn(set().union(*split))
            folds = [f or 0 for f in part.column(2).to_pylist()]
            found = []
            for own, f in zip(split, folds):
                at = np.fromiter(map(memo.known.__getitem__, own), np.int64, len(own))
                found.append((int((at <= len(known)).sum()), float(gain[at, 0].sum(dtype=float)), float(gain[at, f].sum(dtype=float))))
            counts, sums, crossed = zip(*found)
            before = [np.asarray(part.column(i).to_numpy(zero_copy_only=False)) for i in (4, 5)]
            yield batch(fields, {
                "doc_id": part.column(0), "text": part.column(1), "fold": part.column(2), "words": list(counts),
                "own": before[0] + np.array(sums), "crossed": before[1] + np.array(crossed),
            })

    return docs.mapInArrow(run, ddl(fields))


def rate(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``doc_id``, ``evidence`` and ``crossed``, the evidence of the model without the text's fold; NULL without a word."""
    zero = F.lit(0.0)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", fold(F.col("doc_id")).cast("int").alias("fold"),
        F.lit(0).cast("bigint").alias("words"), zero.alias("own"), zero.alias("crossed"),
    )
    blocks = max(1, -(-model.count() // BLOCK))
    for number in range(blocks):
        rows = staged(rows, "rated") if number else rows  # one block in a worker's memory at a time
        rows = _rate_block(rows, *_block(model, number, blocks), last=number == blocks - 1)
    # Likelihood ratios are above 0, but their sum may come out at 0 by rounding.
    mean = lambda c: F.log(F.greatest(F.col(c) / F.col("words") + 1, F.lit(1e-9)))
    some = F.col("words") > 0
    return rows.select("doc_id", F.when(some, mean("own")).alias("evidence"), F.when(some, mean("crossed")).alias("crossed"))


def fit_logistic(value: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the chance of class 1, from counts of both classes by value."""
    x = np.stack([value, np.ones_like(value)], axis=1)
    total, beta, ridge = toxic + ordinary, np.zeros(2), np.diag([1e-6, 1e-6])
    scale = max(float(np.sqrt(np.average(value**2, weights=total))), 1e-9)
    x[:, 0] /= scale
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (toxic - total * chance) - ridge @ beta
        step = np.linalg.solve((x * (total * chance * (1 - chance))[:, None]).T @ x + ridge, slope)
        beta = beta + step * min(1.0, 4 / max(float(np.abs(step).max()), 1e-9))
        if float(np.abs(step).max()) < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _calibrate(rated: DataFrame, known: DataFrame) -> tuple[float, float] | None:
    """Slope and intercept from labelled rows of ``rated``, by evidence from models that did not count them."""
    place = (F.col("crossed") + LIMIT) / (2 * LIMIT) * CELLS
    cell = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    counted = rated.where("crossed IS NOT NULL").join(known, "doc_id").groupBy(cell.alias("cell"))
    summed = counted.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows")).toPandas()
    toxic, total = summed["toxic"].to_numpy(float), summed["rows"].to_numpy(float)
    if not 0 < toxic.sum() < total.sum():
        return None
    middle = (summed["cell"].to_numpy(float) + 0.5) / CELLS * 2 * LIMIT - LIMIT
    return fit_logistic(middle, toxic, total - toxic)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every document.

    Texts meet labels once, to be counted; calibration joins the stored evidence,
    two numbers for each document.
    """
    # Labels grow with the documents, so their join is planned alike at every size.
    known = labels.where("toxic IN (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int")).hint("merge")
    labelled = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .where(~held_out(F.col("doc_id")))
        .join(known, "doc_id")
    )
    taught = labelled.select("text", "toxic", fold(F.col("doc_id")).alias("fold"))
    number = {r["toxic"]: r["count"] for r in known.where(~held_out(F.col("doc_id"))).join(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id").groupBy("toxic").count().collect()}  # two rows
    share = (number.get(1, 0) + 1) / (sum(number.values()) + 2)
    rated, line = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), None
    if len(number) == 2:
        counts = staged(count_words(taught), "toxic-words")
        rated = staged(rate(docs, staged(ratios(counts), "toxic-ratios")), "toxicity")
        line = _calibrate(rated.where(~held_out(F.col("doc_id"))), known)
    score = F.lit(share)
    if line:
        logit = F.col("evidence") * line[0] + line[1]
        score = F.coalesce(1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-700.0)), F.lit(700.0)))), F.lit(share))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
